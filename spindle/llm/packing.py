"""Mixture-controlled packing (operator 3).

Deficit round-robin over one queue per source: every window of 2048 tokens
credits each source its quantum (its target proportion of the window); a source
sends the whole tokens that its credit has begun and carries the overdraft to
the next window, the widest source lends the window's few tokens.
The credit after window ``w`` has the closed form ``fluid(w) - sent(w)``, so a
task knows every queue's deficit at any window without replaying the windows
before it: deficits are carried across windows and partitions by arithmetic.

Documents are tokenised once into a table with each document's place in its
source's queue (place in its partition's part of the queue, plus the sums of
the partitions before); pieces are then cut where a window's share of the
queue ends. Only ``sources x partitions`` sums are shuffled.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindle.llm.common import stash, tidy, whole_text
from spindle.llm.tokens import encoder, id_type

LENGTH = 2048
CELLS = 1 << 20  # entries (rounds x sources) of the table that a task computes at once


class RoundRobin:
    """Tokens that each source has sent after ``r`` rounds.

    ``totals``: tokens by source; ``weights``: target proportions (default: the
    totals, so every window has the corpus' own mixture). A source that runs
    dry hands its quantum to the others. A round is one window. Where there are so
    many sources that the widest could not lend the window's tokens, tokens go in
    the order in which the fluid model ends them, each source shifted by a phase of
    its own so that few fall due at once.
    """

    def __init__(self, totals: list[int], weights: list[float] | None = None, length: int = LENGTH):
        self.totals = np.asarray(totals, np.int64)
        w = np.asarray(totals if weights is None else weights, np.float64)
        if (w[self.totals > 0] <= 0).any():
            raise ValueError("a source with tokens needs a positive weight")
        n, total = len(totals), int(self.totals.sum())
        life = np.divide(self.totals, w, out=np.zeros(n), where=w > 0)  # ends in this order
        order = np.lexsort((self.totals, life))
        self.lender = int(order[-1]) if n else 0                        # ends last; the widest of those
        # fluid model: sent tokens of a source, linear between the total at which each source ends
        at, left, t, sent = [0.0], w.copy(), 0.0, [np.zeros(n)]
        for s in order:
            if self.totals[s] <= 0 or left[s] <= 0:
                continue
            t = max(t, float(np.minimum(life[s] * w, self.totals).sum()))
            at.append(t)
            sent.append(np.minimum(life[s] * w, self.totals))
        at[-1] = float(total) if len(at) > 1 else 0.0
        sent[-1] = self.totals.astype(np.float64)
        self.at, self.sent = np.asarray(at), np.asarray(sent)
        legs = np.diff(self.at)[:, None]
        self.slope = np.divide(np.diff(self.sent, axis=0), legs, out=np.zeros((len(legs), n)), where=legs > 0)
        share = w[self.lender] / w[self.totals > 0].sum() if total else 1.0
        self.lends = 2 * n <= share * length   # the lender never runs negative
        self.phase = (np.arange(n) * 0.6180339887498949 + 0.5) % 1
        self.round = length
        self.rounds = -(-total // self.round)
        self.total = total

    def after(self, rounds: np.ndarray) -> np.ndarray:
        """Array (rounds, sources): whole tokens sent after so many rounds."""
        x = np.minimum(np.asarray(rounds, np.int64) * self.round, self.total)
        if not self.lends:
            return self._by_due(x)
        fluid = self._fluid(x)
        out = np.minimum(np.ceil(fluid - 1e-6).astype(np.int64), self.totals)
        out[x == self.total] = self.totals
        out[:, self.lender] = 0
        out[:, self.lender] = x - out.sum(1)
        return out

    def _fluid(self, x: np.ndarray) -> np.ndarray:
        leg = np.minimum(np.searchsorted(self.at, x, side="right") - 1, len(self.slope) - 1)
        return self.sent[leg] + (x - self.at[leg])[:, None] * self.slope[leg]

    def _due(self, t: np.ndarray) -> np.ndarray:
        return np.minimum(np.floor(self._fluid(t) + self.phase).astype(np.int64), self.totals)

    def _by_due(self, x: np.ndarray) -> np.ndarray:
        """The first ``x`` tokens of all by the fluid time at which they fall due."""
        lo, hi = np.zeros(len(x)), np.full(len(x), float(self.total))
        while ((mid := (lo + hi) / 2) > lo).any() and (hi - lo).max() > 1e-7:
            early = self._due(mid).sum(1) <= x
            lo, hi = np.where(early, mid, lo), np.where(early, hi, mid)
        out = self._due(lo)
        tied = np.where((x < self.total)[:, None], self._due(hi) - out, 0)  # due at one time: in the order of sources
        before = np.cumsum(tied, 1) - tied
        out += np.clip((x - out.sum(1))[:, None] - before, 0, tied)
        out[x == self.total] = self.totals
        return out

    def spans(self, s: np.ndarray, token: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, list[int], list[int]]]:
        """For each entry: the first round, and from it on the tokens sent by source ``s`` and
        by the sources before it, up to where ``s`` has sent its ``n`` tokens from number ``token`` on."""
        lo, hi = np.empty(len(s), np.int64), np.empty(len(s), np.int64)
        for u in np.unique(s):
            own = s == u
            lo[own] = np.interp(token[own], self.sent[:, u], self.at) // self.round
            hi[own] = np.interp((token + n)[own], self.sent[:, u], self.at) // self.round
        lo, hi = np.maximum(lo - 2, 0), hi + 4
        cells, at = np.cumsum((hi - lo) * len(self.totals)), 0
        while at < len(s):
            end = max(at + 1, int(np.searchsorted(cells, (cells[at - 1] if at else 0) + CELLS, side="right")))
            states = self._states(s[at:end], lo[at:end], hi[at:end])
            for i, (mine, ahead) in zip(range(at, end), states, strict=True):
                first, until = int(token[i]), int(token[i] + n[i])
                while (lo[i] > 0 and mine[0] > first) or mine[-1] < until:  # the estimate was short
                    lo[i], hi[i] = max(0, lo[i] - 4), hi[i] + 4
                    (mine, ahead), = self._states(s[i:i + 1], lo[i:i + 1], hi[i:i + 1])
                a, e = bisect_right(mine, first) - 1, bisect_left(mine, until) + 1
                yield int(lo[i]) + a, mine[a:e], ahead[a:e]
            at = end

    def _states(self, s: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[list[int], list[int]]]:
        """For each entry, after the rounds ``lo`` to ``hi`` (exclusive): sent by source ``s``, by those before it."""
        rows = hi - lo
        ends = np.cumsum(rows)
        state = self.after(np.arange(ends[-1]) + np.repeat(lo - (ends - rows), rows))
        row, col = np.arange(len(state)), np.repeat(s, rows)
        mine = state[row, col]
        ahead = (np.cumsum(state, 1)[row, col] - mine).tolist()
        mine = mine.tolist()
        for start, end in zip((ends - rows).tolist(), ends.tolist(), strict=True):
            yield mine[start:end], ahead[start:end]


def tokenised(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
              source_col: str = "source") -> DataFrame:
    """Stored table ``__id, __source, pid, place, n, ids``: every document's ids and
    its place in its source's queue of partition ``pid``."""
    src = df.select(F.col(id_col).cast("long").alias("__id"), F.col(source_col).cast("string").alias("__source"),
                    whole_text(text_col).alias("__text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        kind, pid, place = id_type(enc.vocab), TaskContext.get().partitionId(), {}
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids, n, start = [], [], []
                for source, text in zip(part["__source"].to_pylist(), part["__text"], strict=True):
                    x = np.frombuffer(enc.document(text.as_py()), "<u4").astype(kind)
                    ids.append(x.tobytes())
                    n.append(len(x))
                    start.append(place.get(source, 0))
                    place[source] = start[-1] + len(x)
                yield pa.RecordBatch.from_arrays(
                    [part["__id"], part["__source"], pa.array([pid] * len(n), pa.int64()), pa.array(start, pa.int64()),
                     pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                    names=["__id", "__source", "pid", "place", "n", "ids"])

    return stash(src.mapInArrow(tidy(encode, lambda: encoder(tokenizer).forget()), "__id long, __source string, pid long, place long, n long, ids binary"), "tokens")


def pack(df: DataFrame, tokenizer: str, weights: dict[str | None, float] | None = None, length: int = LENGTH,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset`` and the piece's ``source``.

    Every sequence but the last is full, so padding is at most one sequence's.
    A null text is empty (its end id alone), a null source a queue of its own;
    rows that repeat an identifier are documents of their own. An empty table
    gives no rows. Queues hold documents in the order the table is read.
    """
    spark = df.sparkSession
    docs = tokenised(df, tokenizer, id_col, text_col, source_col)
    sums = docs.groupBy("__source", "pid").agg(F.sum("n").alias("z"))
    w = Window.partitionBy("__source").orderBy("pid")  # one row per source and partition
    before = stash(sums.withColumn("before", F.sum("z").over(w) - F.col("z")), "queues")
    totals = {r["__source"]: r["z"] for r in before.groupBy("__source").agg(F.sum("z").alias("z")).collect()}
    names = sorted(totals, key=lambda s: (s is None, s or ""))  # one entry a source
    rr = RoundRobin([totals[s] for s in names], weights and [weights[s] for s in names], length)
    d, q = docs.alias("d"), before.alias("q")
    placed = (d.join(q, F.col("d.__source").eqNullSafe(F.col("q.__source")) & (F.col("d.pid") == F.col("q.pid")))
               .select("d.__id", "d.__source", (F.col("q.before") + F.col("d.place")).alias("queue"), "d.n", "d.ids"))
    index = {s: i for i, s in enumerate(names)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                yield from _pieces(b.slice(at, 256), rr, index, length)

    return placed.mapInArrow(
        cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")


def _pieces(b: pa.RecordBatch, rr: RoundRobin, index: dict, length: int) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    docs, sources, raws = (b[c].to_pylist() for c in ("__id", "__source", "ids"))
    queues, sizes = (b[c].to_numpy() for c in ("queue", "n"))
    spans = rr.spans(np.fromiter(map(index.__getitem__, sources), np.int64, len(sources)), queues, sizes)
    for doc, source, queue, n, raw, (first, ends, ahead) in zip(
            docs, sources, queues.tolist(), sizes.tolist(), raws, spans, strict=True):
        ids = memoryview(np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes())
        for k in range(len(ends) - 1):
            a, e = max(queue, ends[k]), min(queue + n, ends[k + 1])
            place = (first + k) * rr.round + ahead[k + 1] - ahead[k] + a - ends[k]  # in the packed stream
            while a < e:
                step = min(e - a, length - place % length)
                x = a - queue
                out.append((doc, x, step, zlib.crc32(ids[4 * x:4 * (x + step)]), n, place // length, place % length, source))
                a, place = a + step, place + step
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
    cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
    kinds = [pa.int64()] * 7 + [pa.string()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

