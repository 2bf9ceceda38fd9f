"""The pipeline's stages, each judged on its own input."""

import corpus_pipeline
import public_tokenizers
from brute import ids_of, near_classes
from test_dedup_mixing import lower
from test_tokens_packing import check_packing, library

from spindle.llm import mixing
from spindle.llm.common import stash

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    step = lambda name, d: stash(stages[name](spark, d, SF), f"test-{name}")
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}

    clean = step("toxicity", docs)
    assert clean.columns == docs.columns
    kept = {r.doc_id for r in clean.collect()}
    assert len(toxic & kept) <= 0.1 * len(toxic) and len(kept) > 0.75 * docs.count()

    single = step("exact_dedup", clean)
    want = {}
    for r in clean.collect():
        want[lower(r.text)] = max(want.get(lower(r.text), r.doc_id), r.doc_id)
    assert single.columns == docs.columns and sorted(r.doc_id for r in single.collect()) == sorted(want.values())

    far = step("near_dedup", single)
    rows = sorted((r.doc_id, r.text) for r in single.collect())
    classes = near_classes(rows)
    assert far.columns == docs.columns and sorted(r.doc_id for r in far.collect()) == sorted({rows[c][0] for c in classes.values()})

    mixed = step("mixing", far)
    copies = {r["__id"]: r.copies for r in mixing.mix(far).collect()}
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert mixed.columns == docs.columns and got == {d: n for d, n in copies.items() if n}

    tok = library(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {}
    for r in mixed.collect():
        expected.setdefault(r.doc_id, []).append(ids_of(tok, r.text))
    check_packing(stages["packing"](spark, mixed, SF).collect(), expected)


def test_stage_edges(spark, edge, nothing, tmp_path):
    labels = spark.createDataFrame([(i, 1, int(i == 11)) for i in range(1, 13)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, edge, str(tmp_path))
        assert out.count() > 0 and (name == "packing" or out.columns == edge.columns)
        assert stage(spark, nothing, str(tmp_path)).count() == 0
    near = corpus_pipeline.drop_near_copies(spark, edge, "")
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert near.count() == len(set(near_classes(rows).values()))


def test_run(spark):
    small = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, small)
    rows = out.collect()
    assert len(rows) > 0 and all(0 <= r.offset < 2048 and r.offset + r.length <= 2048 for r in rows)
