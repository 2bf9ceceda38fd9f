"""Corpus pipeline: toxicity, exact de-duplication, near-duplicates, mixing, packing.

``run(spark, sf_dir)`` applies the stages to ``documents``; each stage's rows are
written as Parquet into the shared folder and read back as the next one's docs.
All but the last keep the columns of ``documents``; the last returns the packed
pieces. ``run`` deletes a stage's table and working tables as soon as the next
one is stored. A stage called by itself returns rows that read its working
tables; they are deleted when the same thread calls the next stage on the same
folder, so a stage's rows must be stored before that (two pipelines at once
belong into two threads, or on two folders). No SQL expresses the learned first
stage, so ``ORACLE_SQL`` is None and the stages are tested against plain Python.
"""

from __future__ import annotations

import threading
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spindle.llm import content_sort, mixing, near_dup, packing, toxicity
from spindle.llm.common import delete_tables, read_table, stash, working_tables

_THREAD = threading.local()  # .left: working tables of the thread's last stage, by folder


def stage(fn):
    """A stage's result reads its working tables; they go when the next stage starts."""
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _THREAD.__dict__.setdefault("left", {})
        delete_tables(spark, left.pop(sf_dir, []))
        with working_tables() as paths:
            out = fn(spark, docs, sf_dir)
        left[sf_dir] = paths
        return out
    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


@stage
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return content_sort.drop_exact_copies(docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_near_copies(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


@stage
def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), []
    for name, step in STAGES[:-1]:
        with working_tables() as made:
            docs = stash(step.__wrapped__(spark, docs, sf_dir), f"pipeline-{name}")
        delete_tables(spark, before + made[:-1])  # all but the rows just stored
        before = made[-1:]
    return STAGES[-1][1].__wrapped__(spark, docs, sf_dir)
