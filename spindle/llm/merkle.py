"""Document fingerprints (operator 2): a Merkle tree over sections and paragraphs.

A paragraph is a line with its line end; a section is a run of paragraphs that
ends at a blank line or at a paragraph whose digest says so, so a document
without blank lines still has sections and an edit moves only the borders next
to it. Long paragraphs are cut at content-defined places into leaves of about
64 code points. A leaf's digest is over its exact text, an inner node's over
its children's digests and leaf counts, so equal roots mean equal texts.

The fingerprint's text is ``root:section;section;...`` with ``/`` between the
paragraphs of a section and eight hex digits a leaf. Inner digests follow from
it, so two fingerprints are compared from the root down: equal subtrees match
whole, differing ones are opened, and the leaves left over locate the edits.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindle.llm.common import partitions, whole_text

LEAF = 64          # code points of a leaf on average
WINDOW = 8         # code points that decide a cut
SECTION = 8        # paragraphs of a section on average, where no blank line ends it


def cuts(chars: np.ndarray) -> np.ndarray:
    """Ends of the leaves inside one text: line ends, and places where a hash of the
    last ``WINDOW`` code points says so."""
    h = np.zeros(len(chars), np.uint32)
    for k in range(min(WINDOW, len(chars))):
        h[k:] += chars[:len(chars) - k] * np.uint32(pow(0x01000193, k + 1, 1 << 32))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    at = ((h >> np.uint32(16)) % np.uint32(LEAF) == 0) | (chars == 10)
    at[-1] = True
    return np.flatnonzero(at) + 1


def digest(data: bytes, size: int = 4) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def fingerprint(text: str) -> str:
    if not text:
        return digest(b"", 16).hex() + ":"
    ends = cuts(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")).tolist()
    sections: list[str] = []
    section: list[str] = []
    tops: list[bytes] = []
    leaves: list[str] = []
    at = 0
    for end in ends:
        leaf = text[at:end]
        leaves.append(digest(leaf.encode("utf-8", "surrogatepass")).hex())
        at = end
        if leaf[-1] == "\n" or end == len(text):
            paragraph = "".join(leaves)
            section.append(paragraph)
            if len(leaves) == 1 and not leaf.strip() or digest(paragraph.encode())[0] % SECTION == 0 or end == len(text):
                sections.append("/".join(section))
                tops.append(digest(sections[-1].encode(), 16))
                section = []
            leaves = []
    # the root also covers the exact text, so that short leaf digests cannot make two texts equal
    root = digest(b"".join(tops) + digest(text.encode("utf-8", "surrogatepass"), 16), 16)
    return root.hex() + ":" + ";".join(sections)


def likeness(a: str, b: str) -> float:
    """Share of leaves that two fingerprints have in common (Dice, 0 to 1)."""
    if a == b:
        return 1.0
    a, b = a.partition(":")[2], b.partition(":")[2]
    total = (len(a) - a.count(";") - a.count("/") + len(b) - b.count(";") - b.count("/")) // 8
    same = 0
    for mark in (";", "/"):  # equal sections, then equal paragraphs of the others
        x, y = Counter(a.split(mark)), Counter(b.split(mark))
        both = x & y
        same += sum(n * (len(k) - k.count("/")) // 8 for k, n in both.items())
        a, b = "/".join((x - both).elements()), "/".join((y - both).elements())
    leaf = lambda t: Counter(p[i:i + 8] for p in t.split("/") for i in range(0, len(p), 8))
    same += sum((leaf(a) & leaf(b)).values())
    return 2 * same / total if total else 0.0


def differing_leaves(a: str, b: str) -> list[tuple[int, int]]:
    """(paragraph, leaf) places in ``a`` whose leaf ``b`` has not: where ``a`` was edited."""
    have = Counter(p[i:i + 8] for p in b.partition(":")[2].replace(";", "/").split("/") for i in range(0, len(p), 8))
    out = []
    for n, p in enumerate(a.partition(":")[2].replace(";", "/").split("/")):
        for i in range(0, len(p), 8):
            if have[p[i:i + 8]] > 0:
                have[p[i:i + 8]] -= 1
            else:
                out.append((n, i // 8))
    return out


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the next text's first."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``b, ghost, id, text``, sorted in partitions so that a row's successor in
    descending id (nulls last, ties by text; after the last the first) stands below it.

    Ids are cut into ranges; the first row of a range is also sent, as a ghost,
    to the end of the range before it, so one shuffle of the texts is enough.
    """
    spark = df.sparkSession
    n = partitions(spark)
    src = df.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    marks = src.agg(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], 10_000).alias("q")).first()["q"]
    splitters = np.unique(np.asarray(marks or [], np.int64))  # at most one a partition

    @F.pandas_udf(T.LongType())
    def bucket(ids):
        import pandas as pd
        none = ids.isna()
        return pd.Series(np.where(none, -1, np.searchsorted(splitters, ids.fillna(0).astype("int64"), side="right")))

    b = src.select("id").withColumn("b", bucket("id"))
    tops = [(r["b"], r["top"]) for r in b.groupBy("b").agg(F.max("id").alias("top")).orderBy(F.desc("b")).collect()]
    # the first of each range follows the last of the range before it, the very first the very last
    ghosts = {top: tops[i - 1][0] for i, (_, top) in enumerate(tops)}
    firsts = np.array(sorted(t for t in ghosts if t is not None), np.int64)  # one a range at most
    targets = np.array([ghosts[t] for t in firsts.tolist()], np.int64)
    of_null = ghosts.get(None)

    @F.pandas_udf(T.LongType())
    def ghost(ids):
        import pandas as pd
        none = ids.isna()
        at = np.minimum(np.searchsorted(firsts, ids.fillna(0).astype("int64")), max(len(firsts) - 1, 0))
        hit = (firsts[at] == ids.fillna(0).astype("int64")) & ~none if len(firsts) else np.zeros(len(ids), bool)
        out = pd.Series(np.where(hit, targets[at] if len(firsts) else 0, 0), dtype="Int64").where(pd.Series(np.asarray(hit)))
        return out if of_null is None else out.mask(pd.Series(np.asarray(none)), of_null)

    placed = src.withColumn("b", bucket("id")).withColumn("g", ghost("id"))
    both = placed.select(F.explode(F.when(F.col("g").isNull(), F.array(F.struct("b", F.lit(False).alias("ghost")))).otherwise(
        F.array(F.struct("b", F.lit(False).alias("ghost")), F.struct(F.col("g").alias("b"), F.lit(True).alias("ghost"))))).alias("p"),
        "id", "text").select("p.b", "p.ghost", "id", "text")
    # range b is partition b + 1 (0: no id): hashing the numbers would put several ranges into one task
    return both.repartitionById(n + 1, (F.col("b") + 1).cast("int")).sortWithinPartitions("b", "ghost", F.col("id").desc_nulls_last(), "text")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``.

    A null text is empty. The only row of a table is its own next. Rows without
    an id come last; rows that repeat an id follow one another by text. An empty
    table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (range, ghost, id, text, fingerprint) above the row at hand
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part, out = batch.slice(k, 256), []
                for b, ghost, doc, text in zip(part["b"].to_pylist(), part["ghost"].to_pylist(), part["id"].to_pylist(), part["text"], strict=True):
                    text = text.as_py()
                    own = None
                    if held and held[0] == b and not held[1]:
                        _, _, above, before, fp = held
                        own = fingerprint(text)
                        new = edited(before, text)
                        efp = fingerprint(new)
                        out.append((above, len(before), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), fp, efp,
                                    likeness(fp, efp), likeness(fp, own)))
                    if not ghost:
                        held = (b, ghost, doc, text, own or fingerprint(text))
                    else:
                        held = None  # the range ends; further ghosts are rows that repeat the first id
                cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return with_next(df, id_col, text_col).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
