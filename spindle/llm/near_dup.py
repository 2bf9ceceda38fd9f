"""MinHash near-duplicates with DartMinHash signatures (operator 9).

A text's elements are its five-word shingles. Darts fall on an element's weight
region as a Poisson process whose arrivals (rank, depth, coordinate) are hashed
from the element alone; an arrival hits if its depth lies within the element's
weight. Every signature coordinate keeps its earliest dart. Two signatures
agree in a coordinate with the probability of the weighted Jaccard similarity,
and one throw of about ``k ln k`` darts serves all coordinates, whatever the
number of elements. By default every distinct shingle weighs 1, so that the
weighted similarity is the Jaccard similarity of the shingle sets.

Candidates come from a banded join (24 bands of 5 coordinates: a pair of
similarity 0.8 shares a band with probability 0.9999). Equal word sequences are
one node from the start. In each bucket a few centres are compared with all
other members, exactly, on the shingle sets, which settles small buckets and
connects most of a large one. Where members of a bucket still belong to
different components, all of these are compared in blocks; a block returns only
links that join components, so no bucket emits its pairs and no link between
different texts is lost. Components are found by large-star/small-star
contraction; nothing is collected but counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindle.llm.common import partitions, stash, tidy, whole_text
from spindle.session import cut_lineage

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
CENTRES = 4            # members compared with all others, per bucket
BLOCK = 512            # members of a larger bucket that a task holds of either side
MEMO = 12 << 20        # bytes of word hashes kept in a task
TEXTS, BYTES = 256, 2_000_000   # texts, and their bytes, whose darts are thrown at once

U64 = np.uint64


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """64-bit finaliser of ``x`` under a salt."""
    x = x + U64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordHashes(dict):
    held = 0  # bytes, about

    def __missing__(self, word: str) -> int:
        import xxhash
        if self.held >= MEMO:
            self.forget()
        h = self[word] = xxhash.xxh64_intdigest(word)
        self.held += 200 + 2 * len(word)
        return h

    def forget(self) -> None:
        self.clear()
        self.held = 0


_WORDS = WordHashes()


def forget_words() -> None:
    _WORDS.forget()


def shingles(words: list[str], size: int = WORDS) -> np.ndarray:
    """Hashes of the runs of ``size`` words (a shorter text is one run), with repeats."""
    if not words:
        return np.empty(0, U64)
    w = np.fromiter(map(_WORDS.__getitem__, words), U64, len(words))
    size = min(size, len(words))
    h = np.zeros(len(words) - size + 1, U64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = h * U64(0x9E3779B97F4A7C15) + w[k:len(words) - size + 1 + k]
        return mix(h, 1)


def dart_signatures(elements: list[np.ndarray], weights: list[np.ndarray] | None = None, k: int = BANDS * ROWS) -> np.ndarray:
    """Array (sets, k) of 64-bit dart ids; a set without elements has zeros.

    A weight above 1 is cut into unit cells, the last one partly filled: a dart
    hits it if its hashed depth lies below the filled part.
    """
    sig = np.zeros((len(elements), k), U64)
    if weights is None:
        cell, fill = elements, None
    else:
        cell, fill = [], []
        for e, w in zip(elements, weights, strict=True):
            n = np.ceil(w).astype(np.int64)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            with np.errstate(over="ignore"):
                cell.append(mix(np.repeat(e, n) + nth.astype(U64) * U64(0xD1342543DE82EF95), 2))
            fill.append(np.minimum(np.repeat(w, n) - nth, 1.0))
    todo = np.array([i for i, c in enumerate(cell) if len(c)], np.int64)
    darts = k * np.log(max(k, 2)) + 2.0 * k  # expected hits that fill all coordinates
    while len(todo):
        of = np.repeat(todo, [len(cell[i]) for i in todo])
        key = np.concatenate([cell[i] for i in todo])
        depth = None if fill is None else np.concatenate([fill[i] for i in todo])
        mass = np.bincount(of, depth, minlength=len(cell))
        horizon = np.divide(darts, mass, out=np.zeros(len(cell)), where=mass > 0)
        rank, found, j = np.zeros(len(key)), [], 0
        with np.errstate(over="ignore"):
            while len(key):
                j += 1
                u = mix(key, 3 * j)
                rank = rank - np.log(((u >> U64(11)).astype(np.float64) + 1) * 2.0 ** -53)
                in_time = rank <= horizon[of]
                key, of, rank, u = key[in_time], of[in_time], rank[in_time], u[in_time]
                if depth is not None:
                    depth = depth[in_time]
                dart = mix(u, 3 * j + 1)
                hit = slice(None) if depth is None else (mix(u, 3 * j + 2) >> U64(11)).astype(np.float64) * 2.0 ** -53 < depth
                coordinate = ((dart >> U64(32)) * U64(k) >> U64(32)).astype(np.int64)
                found.append((of[hit] * k + coordinate[hit], rank[hit], dart[hit]))
        place, rank, dart = (np.concatenate(x) for x in zip(*found, strict=True))
        late = np.argsort(-rank, kind="stable")
        flat = sig.reshape(-1)
        flat[place[late]] = dart[late] | U64(1)  # the earliest is written last; never zero
        todo = todo[(sig[todo] == 0).any(1)]     # throw again, for longer, where a coordinate is empty
        darts *= 2
    return sig


def bands(sig: np.ndarray, n_bands: int = BANDS) -> np.ndarray:
    """Array (sets, bands) of 64-bit band keys."""
    rows = sig.shape[1] // n_bands
    out = np.empty((len(sig), n_bands), np.int64)
    with np.errstate(over="ignore"):
        for b in range(n_bands):
            h = np.full(len(sig), b + 1, U64)
            for r in range(rows):
                h = mix(h ^ sig[:, b * rows + r], 7)
            out[:, b] = h.view(np.int64)
    return out


def text_key(text_col: str) -> Column:
    return F.unhex(F.md5(whole_text(text_col).cast("binary")))


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Stored table, one row per input row: ``id, key`` (digest of the text), ``node``
    (of its words), ``n`` (distinct shingles), ``shingles`` (sorted 32-bit hashes), ``bands``."""
    src = df.select(F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("key"), whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            sizes = np.frombuffer(b["text"].buffers()[1], np.int32)[b["text"].offset:b["text"].offset + b.num_rows + 1] \
                if pa.types.is_string(b["text"].type) else np.arange(b.num_rows + 1) * 4096
            while at < b.num_rows:
                end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + BYTES, side="right")) - 1)
                end = min(end, at + TEXTS)  # a text takes about 57 KB of darts, whatever its length
                yield block(b.slice(at, end - at))
                at = end

    def block(b: pa.RecordBatch) -> pa.RecordBatch:
        nodes, sets = [], []
        for t in b["text"]:
            words = t.as_py().lower().split()
            nodes.append(hashlib.blake2b("\n".join(words).encode(), digest_size=16).digest())
            sets.append(np.unique(shingles(words)))
        keys = bands(dart_signatures(sets, k=n_bands * rows), n_bands)
        small = [np.unique((s >> U64(32)).astype("<u4")) for s in sets]
        offsets = np.arange(len(sets) + 1, dtype=np.int32) * n_bands
        return pa.RecordBatch.from_arrays(
            [b["id"], b["key"], pa.array(nodes, pa.binary()), pa.array([len(s) for s in small], pa.int32()),
             pa.array([s.tobytes() for s in small], pa.binary()),
             pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.reshape(-1), pa.int64()))],
            names=["id", "key", "node", "n", "shingles", "bands"])

    shape = "id long, key binary, node binary, n int, shingles binary, bands array<bigint>"
    return stash(src.mapInArrow(tidy(run, forget_words), shape), "near-features")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs ``u, v`` whose shingle sets reach the similarity."""
    a = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = []
            for p, q in zip(x["a"], x["b"], strict=True):
                p, q = np.frombuffer(p.as_buffer(), "<u4"), np.frombuffer(q.as_buffer(), "<u4")
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
            yield x.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(tidy(run), "u binary, v binary")


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of each linked set, for nodes with a link.

    Alternating large-star and small-star steps; every step moves each link at
    most twice, a fixed point is reached in a few steps for star-like sets.
    """
    edges, state = cut_lineage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = cut_lineage(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                                 .unionByName(low.select("u", F.col("m").alias("v")))
                                 .filter(F.col("u") != F.col("v")).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
                 centres: int = CENTRES, block: int = BLOCK) -> DataFrame:
    """One row per input row: ``doc_id, class_id`` (smallest id of its class),
    ``class_size`` (its rows).

    Words are runs of non-space characters, lower-cased. Texts without words
    (null, empty) form one class; texts of fewer than five words are near only
    to equal ones. Null ids count as larger than any other. An empty table
    gives no rows.
    """
    feats = features(df, id_col, text_col)
    base = (feats.select("id", "node").join(_roots(feats, similarity, centres, block), "node", "left")
                 .withColumn("root", F.coalesce("root", "node")))
    classes = base.groupBy("root").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return base.join(classes, "root").select(F.col("id").alias(id_col), "class_id", "class_size")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The input's rows and columns without all but one row of each class: the one of
    the smallest id (then of the smallest text digest; null ids last)."""
    feats = features(df, id_col, text_col)
    own = feats.select("id", "key", "node").join(_roots(feats, similarity), "node", "left")
    kept = (own.groupBy(F.coalesce("root", "node").alias("root"))
               .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("k"))
               .select(F.col("k.id").alias("__id"), F.col("k.key").alias("__key")))
    rows = df.select(F.struct(*df.columns).alias("__row"), F.col(id_col).cast("long").alias("__id"), text_key(text_col).alias("__key"))
    rows = rows.join(kept.withColumnRenamed("__id", "__kept"), ["__key"]).filter(F.col("__id").eqNullSafe(F.col("__kept")))
    # rows that repeat an id and a text
    one = Window.partitionBy("__key").orderBy("__id")
    return rows.withColumn("__rn", F.row_number().over(one)).filter("__rn = 1").select("__row.*")


def _roots(feats: DataFrame, similarity: float, centres: int = CENTRES, block: int = BLOCK) -> DataFrame:
    keyed = (feats.filter("n > 0").select("node", "n", F.explode("bands").alias("band"))
                  .groupBy("band", "node").agg(F.first("n").alias("n")))
    # buckets of one node have nothing to compare
    shared = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("band")
    members = stash(keyed.join(shared, "band"), "near-buckets")
    wanted = members.select("node").distinct()
    sets = stash(feats.select("node", "shingles").join(wanted, "node", "left_semi")
                      .groupBy("node").agg(F.first("shingles").alias("shingles")), "near-sets")
    # the smallest node of each hash class of a bucket meets all members; a partial aggregate finds it
    share = F.pmod(F.xxhash64("node"), F.lit(centres))
    chosen = stash(members.groupBy("band", share.alias("class")).agg(F.min(F.struct("node", "n")).alias("c"))
                          .select("band", "c.*"), "near-centres")
    c = chosen.select("band", F.col("node").alias("c"), F.col("n").alias("c_n"))
    pairs = (members.join(c, "band")
                    .filter((F.col("node") != F.col("c")) & (F.least("n", "c_n") >= similarity * F.greatest("n", "c_n") - 1e-9))
                    .select(F.greatest("node", "c").alias("u"), F.least("node", "c").alias("v")).distinct())
    roots = components(similar(pairs, sets, similarity))

    # members that are no centres, in buckets where they still belong to more than one component
    rest = (members.join(chosen.select("band", "node"), ["band", "node"], "left_anti").select("band", "node")
                   .join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    open_ = (rest.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m"))
                 .filter("lo < hi").select("band", F.ceil(F.col("m") / block).cast("int").alias("blocks")))
    rest = stash(rest.join(open_, "band").join(sets, "node"), "near-open")
    if rest.isEmpty():
        return roots
    links = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
    return components(links.unionByName(_block_links(rest, similarity)))


def _block_links(rest: DataFrame, similarity: float) -> DataFrame:
    """Links ``u, v`` that join the components of a bucket: every member is compared
    exactly with every member of another component, block against block, and only
    a link that joins two components is returned.

    A bucket's members are dealt by hash into blocks; a task holds two of them.
    """
    n = partitions(rest.sparkSession)
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    dealt = (rest.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                 .select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "shingles"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_joining(frame, similarity), columns=["u", "v"])

    return dealt.repartition(n, "band", "i", "j").groupBy("band", "i", "j").applyInPandas(compare, "u binary, v binary")


def _joining(frame: pd.DataFrame, similarity: float) -> list[tuple[bytes, bytes]]:
    nodes, own = frame["node"].tolist(), frame["own"].to_numpy()
    sets = [np.frombuffer(x, "<u4") for x in frame["shingles"]]
    size = np.array([len(x) for x in sets])
    _, label = np.unique(frame["root"].map(bytes.hex), return_inverse=True)
    words, code = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.cumsum(size) - size
    has = np.zeros(len(words), bool)
    across = frame["i"].iat[0] != frame["j"].iat[0]
    out = []
    for u in range(len(nodes)):
        far = label != label[u]
        if across:
            far &= own != own[u]
        if not far.any():
            continue
        mine = code[start[u]:start[u] + size[u]]
        has[mine] = True
        both = np.add.reduceat(has[code].astype(np.int32), start)
        has[mine] = False
        for v in np.flatnonzero(far & (both >= similarity * (size + size[u] - both) - 1e-9)):
            if label[v] != label[u]:
                label[label == label[v]] = label[u]
                out.append((nodes[u], nodes[v]))
    return out
