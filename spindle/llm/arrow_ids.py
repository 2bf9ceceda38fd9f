"""Token-id output in Arrow files (operator 6).

Documents are range-partitioned and sorted by identifier; each partition writes
one shard: an Arrow file whose batches hold two fixed-size-list columns, ``ids``
and ``mask``, so sequence ``i`` lies at a computable place and is read without a
copy from a memory map, and beside it an index file with each document's first
token and length in the shard. A shard's documents follow one another without
gaps; only its last sequence is padded (mask 0).

Shards go to the shared folder through the file system its URI names. A task
writes under a name of its own attempt and reports it; only reported shards are
read, so the leftovers of a lost executor never count.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindle.llm.common import partitions, shared_path, tidy, whole_text
from spindle.llm.tokens import encoder, id_type
from spindle.session import cut_lineage

LENGTH = 2048
BATCH = 64            # sequences a record batch
INDEX_BATCH = 8192    # documents a record batch of the index


def open_fs(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def shard_schema(kind: str, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(np.dtype(kind)), length)), ("mask", pa.list_(pa.bool_(), length))])


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class ShardWriter:
    """Streams documents' ids into one shard and its index; holds one batch."""

    def __init__(self, root: str, name: str, kind: str, length: int):
        self.fs, base = open_fs(root)
        self.fs.create_dir(base, recursive=True)
        self.schema, self.kind, self.length = shard_schema(kind, length), kind, length
        self.sinks = [self.fs.open_output_stream(f"{base}/{name}.{x}") for x in ("arrow", "index.arrow")]
        self.ids = pa.ipc.new_file(self.sinks[0], self.schema)
        self.index = pa.ipc.new_file(self.sinks[1], INDEX)
        self.held: list[np.ndarray] = []
        self.rows: list[tuple[int | None, int, int]] = []
        self.n_held = self.total = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.rows.append((doc_id, self.total, len(ids)))
        self.total += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BATCH * self.length:
            self._flush(False)
        if len(self.rows) >= INDEX_BATCH:
            self._flush_index()

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.empty(0, self.kind)
        # only full batches before the end: readers compute a token's batch from its place
        unit = self.length if last else BATCH * self.length
        whole = len(flat) // unit * unit
        rest, mask = flat[whole:], np.ones(whole, bool)
        flat = flat[:whole]
        if last and len(rest):
            pad = self.length - len(rest)
            flat = np.concatenate([flat, rest, np.zeros(pad, self.kind)])
            mask = np.concatenate([mask, np.ones(len(rest), bool), np.zeros(pad, bool)])
            rest = rest[:0]
        step = BATCH * self.length
        for at in range(0, len(flat), step):
            cols = [pa.FixedSizeListArray.from_arrays(pa.array(x[at:at + step]), self.length) for x in (flat, mask)]
            self.ids.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))
        self.held, self.n_held = [rest], len(rest)

    def _flush_index(self) -> None:
        cols = list(zip(*self.rows, strict=True)) or [[], [], []]
        self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=INDEX))
        self.rows = []

    def close(self) -> None:
        self._flush(True)
        self._flush_index()
        for x in (self.ids, self.index, *self.sinks):
            x.close()


def write_shards(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 root: str | None = None, length: int = LENGTH) -> DataFrame:
    """Writes the shards; returns the manifest ``shard, root, name, n_docs, n_tokens``.

    Order: ascending identifier, null identifiers first, equal ones by text. A
    null text is empty (its end id alone). An empty table gives no shard.
    """
    spark = df.sparkSession
    n = partitions(spark)
    root = root or shared_path(spark, "token-shards")
    src = (df.select(F.col(id_col).cast("long").alias("__id"), whole_text(text_col).alias("__text"))
             .repartitionByRange(n, F.col("__id").asc_nulls_first(), F.substring("__text", 1, 32))
             .sortWithinPartitions(F.col("__id").asc_nulls_first(), "__text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        kind, pid, out, docs = id_type(enc.vocab), TaskContext.get().partitionId(), None, 0
        name = f"shard-{pid:06d}-{uuid.uuid4().hex[:12]}"
        for b in batches:
            for doc, text in zip(b["__id"].to_pylist(), b["__text"], strict=True):
                out = out or ShardWriter(root, name, kind, length)
                out.add(doc, np.frombuffer(enc.document(text.as_py()), "<u4").astype(kind))
                docs += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist([{"shard": pid, "root": root, "name": name, "n_docs": docs, "n_tokens": out.total}],
                                             pa.schema([("shard", pa.int64()), ("root", pa.string()), ("name", pa.string()),
                                                        ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    # reliable checkpoint: one row a shard; shards are written once and never again
    return cut_lineage(src.mapInArrow(tidy(write, lambda: encoder(tokenizer).forget()), "shard long, root string, name string, n_docs long, n_tokens long"))


def open_shard(root: str, name: str):
    """Readers of a shard's sequences and of its index."""
    fs, base = open_fs(root)
    return tuple(pa.ipc.open_file(fs.open_input_file(f"{base}/{name}.{x}")) for x in ("arrow", "index.arrow"))


def shard_documents(root: str, name: str) -> Iterator[tuple[int | None, int, np.ndarray | list[np.ndarray]]]:
    """Per document: id, first token in the shard, and its ids as slices of the batches."""
    ids, index = open_shard(root, name)
    flat: dict[int, np.ndarray] = {}
    per = None
    for i in range(index.num_record_batches):
        for doc, start, n in zip(*(c.to_pylist() for c in index.get_batch(i)), strict=True):
            if per is None:
                per = len(_flat(ids, 0))  # every batch but the last holds as many ids
            parts, at = [], start
            while at < start + n:
                k = at // per
                if k not in flat:
                    flat = {j: x for j, x in flat.items() if j >= k - 1} | {k: _flat(ids, k)}
                take = min(start + n, (k + 1) * per) - at
                parts.append(flat[k][at - k * per:at - k * per + take])
                at += take
            yield doc, start, parts


def _flat(ids, k: int) -> np.ndarray:
    col = ids.get_batch(k).column(0)
    return col.values.to_numpy(zero_copy_only=True)


def read_documents(manifest: DataFrame) -> DataFrame:
    """From the shards' files: ``doc_id, start, n_tokens, ids_crc32`` of every document."""
    before = Window.orderBy("shard")  # one row a shard
    offsets = manifest.select("shard", (F.sum("n_tokens").over(before) - F.col("n_tokens")).alias("before"))
    # dealt out again, as the sum above leaves the shards' names in one task
    shards = manifest.select("shard", "root", "name").join(offsets, "shard").repartitionByRange(partitions(manifest.sparkSession), "shard")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                rows: list[tuple] = []
                for doc, start, parts in shard_documents(r["root"], r["name"]):
                    crc = 0
                    for x in parts:
                        crc = zlib.crc32(x.astype("<u4"), crc)
                    rows.append((doc, r["before"] + start, sum(map(len, parts)), crc))
                    if len(rows) >= INDEX_BATCH:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)
