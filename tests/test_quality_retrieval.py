"""Quality rules, reconciliation, retrieval and forest evaluation."""

import numpy as np
from pyspark.sql import functions as F

from shapes import SF_SMALL
from spindle.operators import forest as M
from spindle.operators import quality as q
from spindle.operators import retrieval as R
from spindle.plans import bindings as b


def ticket_frame(spark):
    """Six rows; row i lacks step j where (i + j) is a multiple of 3, owners equal steps in even rows."""
    rows = []
    for i in range(6):
        steps = [None if (i + j) % 3 == 0 else f"s{j}" for j in range(1, 4)]
        owners = steps if i % 2 == 0 else ["boss"] * 3
        rows.append((i, "open" if i < 4 else "shut", *steps, *owners, None if i == 5 else "note"))
    return spark.createDataFrame(rows, "id int, state string, step1 string, step2 string, step3 string, "
                                       "owner1 string, owner2 string, owner3 string, memo1 string")


def test_rules_on_own_frame(spark):
    df = ticket_frame(spark)
    steps = q.family(df, "step")
    rules = [q.Rule("filled", "not_null", steps), q.Rule("state", "in_list", ("state",), ("open", "held")),
             q.Rule("pair", "pair_match", steps, other=tuple(c.replace("step", "owner") for c in steps)),
             q.Rule("when", "cond_not_null", ("step2",), when=(F.col("state") == "open") & (F.col("owner1") == "boss"))]
    got = {r["rule"]: (r["pass_count"], r["fail_count"]) for r in q.check(df, rules).collect()}
    # each row lacks one step; even rows match their two present steps; rows 1 and 3 meet the condition, row 1 lacks step2
    assert got == {"filled": (12, 6), "state": (4, 2), "pair": (6, 12), "when": (1, 1)}
    assert q.fill_missing(df, "memo").filter(F.col("memo1") == "Not Applicable").count() == 1
    assert df.na.drop().count() == 0 and df.select("id", "state", "memo1").na.drop().count() == 5


def test_first_match_and_reconcile(spark):
    df = spark.createDataFrame([(1, "red", "oak"), (2, "blue", "elm"), (3, "lime", "oak"), (4, "grey", "fir")], "id int, hue string, wood string")
    wanted = ["blue", "oak", "teal", "red"]
    vals = spark.createDataFrame([(v,) for v in wanted], "v string")
    flags = [r["match_src"] for r in q.first_match(df, ["hue", "wood"], vals).orderBy("id").collect()]
    assert flags == ["hue", "hue", "wood", None]
    assert flags == [r["match_src"] for r in q.first_match(df, ["hue", "wood"], wanted).orderBy("id").collect()]
    _, summary = q.reconcile(df, ["hue", "wood"], vals)
    got = {r["metric"]: r["n"] for r in summary.collect()}
    assert got == {"matches_hue": 2, "matches_wood": 1, "matched_inputs": 3, "unmatched_inputs": 1}


def test_element_metadata_flags(spark):
    st = spark.createDataFrame([(f"in{i}", i, f"out{i}", 10 * i) for i in range(4)], "a string, na int, z string, nz int")
    meta = q.element_metadata(st, [{"a": "elem", "na": "size"}, {"z": "elem", "nz": "size"}])
    flagged = q.flag_member(meta, "elem", ["in1", "out3", "out9"])
    assert flagged.count() == 8 and sorted(r["elem"] for r in flagged.filter(F.col("matched_or_not") == "Yes").collect()) == ["in1", "out3"]


def test_mask_round_trip(spark):
    import hashlib
    df = spark.createDataFrame([("Grüße an alle: 42 %",)], "s string")
    r = q.mask(q.mask(df, {"s": "sha256"}), {"s": "sha512"})
    r = q.mask(r, {"s": "base64"}).withColumn("back", q.unmask_base64("s_b64")).collect()[0]
    assert r["s_sha256"] == hashlib.sha256("Grüße an alle: 42 %".encode()).hexdigest()
    assert r["s_sha512"] == hashlib.sha512("Grüße an alle: 42 %".encode()).hexdigest()
    assert r["back"] == "Grüße an alle: 42 %"


def test_knn_matches_brute_force(spark):
    corpus = b.vectors(spark, SF_SMALL)
    pdf = corpus.toPandas()
    X = np.stack(pdf["vec"].map(lambda v: np.asarray(v, dtype=np.float64)))
    queries = spark.createDataFrame([(int(i), [float(x) for x in X[i]]) for i in (0, 7, 42)], "qid long, qvec array<double>")
    got = R.knn(queries, corpus, k=4).orderBy("qid", "rank").collect()
    for qid in (0, 7, 42):
        d = np.sqrt(((X - X[qid]) ** 2).sum(axis=1))
        order = sorted(range(len(d)), key=lambda i: (d[i], pdf["id"][i]))[:4]
        mine = [r for r in got if r["qid"] == qid]
        assert [r["id"] for r in mine] == [int(pdf["id"][i]) for i in order]
        assert mine[0]["id"] == qid and abs(mine[0]["distance"]) < 1e-12  # a corpus vector finds itself first
    # blocked path (tiny byte budget) gives the same answer
    blocked = R.knn(queries, corpus, k=4, max_query_bytes=600).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["id"]) for r in blocked] == [(r["qid"], r["id"]) for r in got]
    one = R.top_k_one(corpus, X[7].tolist(), 4).collect()
    assert [r["id"] for r in one] == [r["id"] for r in got if r["qid"] == 7]


def test_best_match_default_and_grade(spark):
    qs = spark.createDataFrame([(1, [0.0, 0.0]), (2, [5.0, 5.0])], "qid int, qvec array<double>")
    corpus = spark.createDataFrame([(10, [0.0, 0.5]), (11, [4.0, 4.0])], "id int, vec array<double>")
    texts = spark.createDataFrame([(10, "near text")], "id int, content string")
    m = R.knn(qs, corpus.join(texts.select("id"), "id", "left_semi"), 1)
    best = {r["qid"]: (r["context"], r["distance"]) for r in R.grade(R.best_match(qs, m, texts)).collect()}
    assert best[1] == ("near text", 0.5)
    g = {r["qid"]: r["grade"] for r in R.grade(R.best_match(qs, m, texts)).collect()}
    assert g == {1: "useful", 2: "not_useful"}
    empty_texts = texts.limit(0)
    none = R.best_match(qs, R.knn(qs, corpus.limit(0), 1), empty_texts).collect()
    assert {(r["context"], r["distance"]) for r in none} == {("No match found", 99.0)}


def test_forest_invariants(spark):
    v = b.vectors(spark, SF_SMALL)
    data = M.features(v, array_col="vec").select("id", "features", F.col("label").cast("double").alias("label"))
    train, test = M.split(data, "id")
    assert train.join(test, "id").count() == 0 and train.count() + test.count() == data.count()
    model = M.fit_forest(train, "label", num_trees=10, seed=42)
    pred = model.transform(test)
    acc = M.accuracy(pred, "label")
    assert 0.0 <= acc <= 1.0
    cm = M.confusion(pred, "label")
    assert cm.agg(F.sum("n")).first()[0] == test.count()
    rep = M.classification_report(pred, "label")
    assert rep.agg(F.sum("support")).first()[0] == test.count()


def test_knn_cosine_matches_numpy(spark):
    corpus = b.vectors(spark, SF_SMALL)
    pdf = corpus.toPandas()
    X = np.stack(pdf["vec"].map(lambda v: np.asarray(v, dtype=np.float64)))
    q = X[3] + X[5]
    queries = spark.createDataFrame([(1, [float(x) for x in q])], "qid int, qvec array<double>")
    got = [r["id"] for r in R.knn(queries, corpus, k=3, metric="cosine").orderBy("rank").collect()]
    d = 1.0 - (X @ q) / (np.linalg.norm(X, axis=1) * np.linalg.norm(q))
    ref = [int(pdf["id"][i]) for i in sorted(range(len(d)), key=lambda i: (d[i], pdf["id"][i]))[:3]]
    assert got == ref


def test_knn_join_visits_few_cells_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(R, "CELL_ROWS", 50)  # several blocks a cell
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 3)) * 50
    X = np.concatenate([c + rng.normal(size=(80, 3)) for c in centres] + [np.repeat(centres[:1], 150, axis=0)])  # and many equal ones
    corpus = spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(X)] + [(5000, None, 0)], "id long, vec array<double>, qid int")
    queries = spark.createDataFrame([(f"q{i}", X[i].tolist()) for i in range(0, len(X), 50)] + [("none", None)], "qid string, qvec array<double>")
    got = {}
    for r in R.knn(queries, corpus, k=5, max_query_bytes=400).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["id"], round(r["distance"], 9)))
    for i in range(0, len(X), 50):
        d = np.sqrt(((X - X[i]) ** 2).sum(axis=1))
        assert got[f"q{i}"] == [(j, round(d[j], 9)) for j in sorted(range(len(X)), key=lambda j: (d[j], j))[:5]]
    assert "none" not in got
    seen = R.cells_visited(queries, corpus, k=5).collect()
    assert all(r["visited"] < 0.5 * r["cells"] and r["vectors"] < 0.5 * len(X) for r in seen) and len(seen) == len(got)
    assert R.knn(queries, corpus.limit(0), 2).collect() == [] and R.knn(queries.limit(0), corpus, 2).collect() == []
    assert R.knn(queries, corpus.limit(3), 9).filter("qid = 'q0'").count() == 3
