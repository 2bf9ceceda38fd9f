"""Product codes of vectors, trained with norm-of-sum bounds (operator 11).

Vectors of integers are cut into parts; each part position has a codebook that
Lloyd rounds improve: every part goes to its nearest entry, every entry becomes
the floor of its parts' mean. A round does not compare each part with each entry.
For groups of entries a part keeps a lower bound of its distance to all entries
of the group but its own, with the round in which it was measured (the bound's
stamp). The codebooks of all rounds are retained, so at a later round the bound
falls by the largest *net* displacement ``|c_now - c_stamp|`` in the group -- the
norm of the sum of the entry's moves, which is tighter than the sum of their norms
that drifting bounds add up. Only a group whose bound is not above the distance to
the own entry is compared exactly again.

Distances are exact integers and bounds are rounded down, so the codes are those
of the plain method, ties to the lower index included. The state of a part (code,
bounds, stamps) travels with its vector in a stored table per round; each task also
stores its sums by entry, which Spark adds up. The driver holds codebooks only:
256 entries of a vector's size a round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import delete_tables, stash, tidy, working_tables

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
GROUPS = 16              # groups of entries with a bound of their own
ROWS = 2048              # vectors a task holds at once
BOUND = 1 << 40          # components are held inside -2^40 to 2^40


@dataclass
class Codebooks:
    """The codebooks of all rounds so far, ``(parts, entries, width)`` each."""

    rounds: list[np.ndarray]
    _moves: dict = field(default_factory=dict, repr=False)

    @property
    def now(self) -> np.ndarray:
        return self.rounds[-1]

    def moved(self, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Net displacement since each stamp, by group: the largest (rounds, groups), the entry
        that has it, and the second largest."""
        if part not in self._moves:
            now = self.now[part].astype(np.float64)
            far = np.stack([np.sqrt(((now - c[part]) ** 2).sum(1)) for c in self.rounds]) * (1 + 1e-9) + 1e-6
            of = groups(far.shape[1])
            top, which, second = (np.zeros((len(far), GROUPS), t) for t in (np.float64, np.int64, np.float64))
            for g in range(GROUPS):
                at = np.flatnonzero(of == g)
                if len(at):
                    order = np.argsort(-far[:, at], axis=1, kind="stable")
                    which[:, g] = at[order[:, 0]]
                    top[:, g] = np.take_along_axis(far[:, at], order[:, :1], 1)[:, 0]
                    if len(at) > 1:
                        second[:, g] = np.take_along_axis(far[:, at], order[:, 1:2], 1)[:, 0]
            self._moves[part] = top, which, second
        return self._moves[part]


def groups(entries: int) -> np.ndarray:
    """Group of each entry."""
    return np.arange(entries) * GROUPS // max(entries, 1)


def exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries, in exact integers (Python's where 64 bits could not hold them)."""
    top = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    width = max(x.shape[1], 1)
    if 4 * top * top * width < 1 << 53:  # exact in floating point, too
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        return ((xf * xf).sum(1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(1)).astype(np.int64)
    kind = np.int64 if 4 * top * top * width < 1 << 62 else object
    out = np.zeros((len(x), len(c)), kind)
    for k in range(x.shape[1]):
        d = x[:, k].astype(kind)[:, None] - c[:, k].astype(kind)
        out += d * d
    return out


def own_distance(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row to the entry beside it."""
    top = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    kind = np.int64 if 4 * top * top * max(x.shape[1], 1) < 1 << 62 else object
    d = x.astype(kind) - c.astype(kind)
    return (d * d).sum(1) if len(d) else np.zeros(0, kind)


def root(d: np.ndarray) -> np.ndarray:
    """Square roots of squared distances, a little low."""
    return np.sqrt(d.astype(np.float64)) * (1 - 1e-9)


@dataclass
class State:
    """Of one part position: codes, and per group the lower bounds and their stamps."""

    code: np.ndarray
    low: np.ndarray
    stamp: np.ndarray

    @classmethod
    def empty(cls, n: int) -> State:
        return cls(np.zeros(n, np.int64), np.full((n, GROUPS), -np.inf, np.float32), np.zeros((n, GROUPS), np.uint8))


def assign(x: np.ndarray, part: int, books: Codebooks, s: State) -> tuple[np.ndarray, int]:
    """Moves the state of the parts ``x`` to the codebook at hand; returns the squared distances
    to the new entries and how many distances were measured."""
    book, t = books.now[part], len(books.rounds) - 1
    entries, of = len(book), groups(len(book))
    top, which, second = books.moved(part)
    col = np.arange(GROUPS)
    own = own_distance(x, book[s.code])
    # the bounds as of now: less the net displacement since their stamp, the own entry's aside
    shift = np.where(which[s.stamp, col] == s.code[:, None], second[s.stamp, col], top[s.stamp, col])
    low = s.low - shift
    reach = np.sqrt(own.astype(np.float64)) * (1 + 1e-9)
    open_ = low <= reach[:, None]
    best, code, first = own.copy(), s.code.copy(), s.code
    measured = len(x)
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    for g in range(GROUPS):
        at = np.flatnonzero(of == g)
        rows = np.flatnonzero(open_[:, g])
        if not len(at) or not len(rows):
            continue
        d = exact(x[rows], book[at])
        measured += d.size
        found.append((g, rows, d))
        k = d.argmin(1)  # the lowest index of equal ones
        near, idx = np.take_along_axis(d, k[:, None], 1)[:, 0], at[k]
        better = (near < best[rows]) | (near == best[rows]) & (idx < code[rows])
        best[rows[better]], code[rows[better]] = near[better], idx[better]
    s.code = code
    for g, rows, d in found:  # measured groups: the nearest entry that is not the own one
        at = np.flatnonzero(of == g)
        others = root(d)
        others[at[None, :] == code[rows][:, None]] = np.inf
        s.low[rows, g] = np.nextafter(others.min(1).astype(np.float32), np.float32(-np.inf))
        s.stamp[rows, g] = t
    # an entry that is no longer the own one joins the others of its group
    left = np.flatnonzero(code != first)
    left = left[~open_[left, of[first[left]]]] if entries else left
    if len(left):
        g = of[first[left]]
        kept = np.minimum(low[left, g], root(own[left]))
        s.low[left, g] = np.nextafter(kept.astype(np.float32), np.float32(-np.inf))
        s.stamp[left, g] = t
    return best, measured


def kept(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, label, vec`` (integers) of the rows whose vector has finite components only."""
    v = F.col(vec_col).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    floor = lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(float(BOUND))), F.lit(-float(BOUND))))
    return df.filter(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.transform(v, floor).alias("vec"))


def first_codebook(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> tuple[np.ndarray | None, int]:
    """Parts of the vectors of the smallest identifiers (null ones last, ties by the vector), and
    the vectors' length: that of the first."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("vec")]
    top = rows.orderBy(*order).select("vec").first()
    if top is None:
        return None, 0
    dim = len(top["vec"])
    top = rows.filter(F.size("vec") == dim).orderBy(*order).select("vec").limit(entries).collect()  # 256 vectors
    width = max(1, -(-dim // parts))
    out = np.zeros((len(top), parts * width), np.int64)
    out[:, :dim] = np.array([r["vec"] for r in top], np.int64).reshape(len(top), dim)
    return np.ascontiguousarray(out.reshape(len(top), parts, width).transpose(1, 0, 2)), dim


def _round(table: DataFrame, books: Codebooks, kind: str) -> DataFrame:
    """One assignment of all vectors: their new state, and a row per task with its sums by entry."""
    parts, entries, width = books.now.shape
    shape = f"vec_id long, label {kind}, vec binary, code binary, low binary, stamp binary, error long, sums array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)  # components and counts
        measured = rows = 0
        schema = None
        for b in batches:
            schema = schema or pa.schema([("vec_id", pa.int64()), ("label", b.schema.field("label").type), ("vec", pa.binary()), ("code", pa.binary()),
                                          ("low", pa.binary()), ("stamp", pa.binary()), ("error", pa.int64()), ("sums", pa.list_(pa.int64()))])
            for k in range(0, b.num_rows, ROWS):
                p = b.slice(k, ROWS)
                n = p.num_rows
                x = np.frombuffer(b"".join(p["vec"].to_pylist()), "<i8").reshape(n, parts, width)
                first = p["code"].null_count == n
                code = None if first else np.frombuffer(b"".join(p["code"].to_pylist()), "<u1").reshape(n, parts)
                low = None if first else np.frombuffer(b"".join(p["low"].to_pylist()), "<f4").reshape(n, parts, GROUPS)
                stamp = None if first else np.frombuffer(b"".join(p["stamp"].to_pylist()), "<u1").reshape(n, parts, GROUPS)
                new, error = [], np.zeros(n, object)
                for q in range(parts):
                    s = State.empty(n) if first else State(code[:, q].astype(np.int64), low[:, q].copy(), stamp[:, q].copy())
                    best, m = assign(x[:, q], q, books, s)
                    measured += m
                    error += best.astype(object)
                    new.append(s)
                    np.add.at(total[q, :, :width], s.code, x[:, q])
                    total[q, :, width] += np.bincount(s.code, minlength=entries)
                rows += n
                pack = lambda arrays, t: pa.array([r.tobytes() for r in np.stack(arrays, 1).astype(t)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [p["vec_id"], p["label"], p["vec"], pack([s.code for s in new], "<u1"), pack([s.low for s in new], "<f4"),
                     pack([s.stamp for s in new], "<u1"), pa.array([min(int(e), (1 << 63) - 1) for e in error], pa.int64()), pa.nulls(n, pa.list_(pa.int64()))],
                    schema=schema)
        if rows:
            flat = [*total.reshape(-1).tolist(), measured, rows]
            yield pa.RecordBatch.from_pylist([{"sums": flat}], schema)

    return stash(table.mapInArrow(tidy(run), shape), "vector-codes")


def train(df: DataFrame, rounds: int = ROUNDS, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
          parts: int = PARTS, entries: int = ENTRIES) -> tuple[DataFrame, Codebooks | None, int, list[tuple[int, int]]]:
    """The coded vectors (``vec_id, label, code, error``), the codebooks of all rounds, the vectors'
    length, and for each assignment the distances measured and those that the plain method measures.

    Dropped: rows whose vector is null or empty, holds a null or non-finite component, or has
    another length than that of the smallest identifier. A length that the parts do not divide is
    filled up with zeros, a component beyond 2^40 is held there. Rows that repeat an identifier
    are vectors of their own.
    """
    spark = df.sparkSession
    rows = kept(df, id_col, vec_col, label_col)
    book, dim = first_codebook(rows, parts, entries)
    kind = dict(rows.dtypes)["label"]
    if book is None:
        none = spark.createDataFrame([], f"vec_id long, label {kind}, code string, error long")
        return none, None, 0, []
    width = book.shape[2]
    fits = rows.filter(F.size("vec") == dim)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.zeros((b.num_rows, parts * width), "<i8")
            x[:, :dim] = b["vec"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)
            none = pa.nulls(b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], pa.array([r.tobytes() for r in x], pa.binary()), none, none, none],
                                             names=["vec_id", "label", "vec", "code", "low", "stamp"])

    table = fits.mapInArrow(pack, f"vec_id long, label {kind}, vec binary, code binary, low binary, stamp binary")
    books, work, before = Codebooks([book]), [], []
    for t in range(rounds + 1):
        with working_tables() as made:
            out = _round(table, books, kind)
        delete_tables(spark, before)
        before = list(made)
        sums = out.filter(F.col("sums").isNotNull()).select(F.posexplode("sums").alias("at", "v"))
        sums = {r["at"]: r["v"] for r in sums.groupBy("at").agg(F.sum("v").alias("v")).collect()}  # one number a component
        size = books.now.shape[0] * books.now.shape[1] * (width + 1)
        work.append((sums[size], sums[size + 1] * (len(book) * books.now.shape[1])))
        table = out.filter(F.col("sums").isNull())
        if t < rounds:
            total = np.array([sums[i] for i in range(size)], np.int64).reshape(parts, -1, width + 1)
            count = total[:, :, width:]
            books = Codebooks([*books.rounds, np.where(count > 0, total[:, :, :width] // np.maximum(count, 1), books.now)])
    coded = table.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error")
    return coded, books, dim, work


def digest(books: Codebooks, dim: int) -> str:
    """SHA-256 of the final entries' components by part, entry and place, ``,``-joined (no filling zeros)."""
    parts, _, width = books.now.shape
    real = [max(0, min(width, dim - p * width)) for p in range(parts)]
    flat = [str(v) for p in range(parts) for e in books.now[p] for v in e[:real[p]].tolist()]
    return hashlib.sha256(",".join(flat).encode()).hexdigest()


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per kept row: ``vec_id, code, error, label_error, codebooks_sha256``; an empty table, or one
    without a usable vector, gives no rows. Sums beyond 64 bits are held at 2^63 - 1."""
    coded, books, dim, _ = train(df, ROUNDS, id_col, vec_col, label_col)
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    by = coded.groupBy(F.col("label").alias("__label")).agg(  # summed before the join
        F.least(F.sum(F.col("error").cast("decimal(19,0)")).cast("decimal(38,0)"), most).cast("long").alias("label_error"))
    return coded.join(by, F.col("label").eqNullSafe(F.col("__label"))).select(
        F.col("vec_id").alias(id_col), "code", "error", "label_error", F.lit(digest(books, dim) if books else "").alias("codebooks_sha256"))


def decode(coded: DataFrame, books: Codebooks, dim: int) -> DataFrame:
    """``vec_id`` and the vector that a code stands for, in the original scale."""
    book = books.now

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = np.array([list(bytes.fromhex(c)) for c in b["code"].to_pylist()], np.int64).reshape(b.num_rows, book.shape[0])
            x = np.concatenate([book[p][code[:, p]] for p in range(book.shape[0])], 1)[:, :dim] / SCALE
            yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(x.tolist(), pa.list_(pa.float64()))], names=["vec_id", "vec"])

    return coded.select("vec_id", "code").mapInArrow(run, "vec_id long, vec array<double>")
