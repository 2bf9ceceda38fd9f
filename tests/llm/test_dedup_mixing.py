"""Operators 4, 5, 9 on edge rows and against plain Python."""

import numpy as np
import pytest
from brute import near_classes

from spindle.llm import content_sort, mixing, near_dup


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_exact_groups_edges(edge, nothing):
    rows = edge.collect()
    groups = {}
    for r in rows:
        groups.setdefault(lower(r.text), []).append(r.doc_id)
    got = content_sort.exact_groups(edge).collect()
    want = sorted((str(d), str(max((x for x in g if x is not None), default=None)), len(g)) for g in groups.values() for d in g)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert content_sort.exact_groups(nothing).collect() == []
    kept = content_sort.drop_exact_copies(edge)
    assert kept.columns == edge.columns and kept.count() == len(groups)


def test_a_hot_text_is_salted_and_merged(spark):
    rows = [(i, "Same TEXT" if i % 3 else f"own {i}") for i in range(3000)] + [(2999, "same text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = content_sort.exact_groups(df).collect()
    hot = [r for r in got if r.group_size > 1]
    assert len(hot) == 2001 and {(r.keep_id, r.group_size) for r in hot} == {(2999, 2001)}
    assert sum(r.kept for r in hot) == 1 and [r.doc_id for r in hot if r.kept] == [2999]


def test_mix_edges(edge, nothing):
    rows = mixing.mixed_sizes(edge).collect()
    size = {}
    for r in edge.collect():
        size[r.source] = size.get(r.source, 0) + len([w for w in (r.text or "").replace("\t", " ").replace("\n", " ").split(" ") if w])
    target = mixing.targets(size, mixing.cycled_weights(list(size)))
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6 and all(target[s] <= 3 * size[s] + 1e-9 for s in size)
    assert len(rows) == edge.count() and all(0 <= r.taken <= 3 * r.size for r in rows)
    by = {}
    for r in mixing.mix(edge, carry=["source"]).collect():
        by[r["__row"].source] = by.get(r["__row"].source, 0) + r.taken
    assert all(abs(by[s] - target[s]) <= 3 for s in size)
    assert mixing.mixed_sizes(nothing).collect() == []
    assert mixing.mixed_rows(edge).columns == edge.columns and mixing.mixed_rows(nothing).collect() == []


def test_targets_reshare_the_excess():
    sizes, weights = {"a": 10, "b": 1000, "c": 500, None: 0}, {"a": 5, "b": 2, "c": 1, None: 5}
    t = mixing.targets(sizes, weights)
    assert t["a"] == 30 and t[None] == 0 and abs(t["b"] - 2 * t["c"]) < 1e-9 and abs(sum(t.values()) - 1510) < 1e-9


def test_dart_signatures_estimate_the_weighted_similarity():
    rng = np.random.default_rng(5)
    keys = rng.integers(1, 1 << 62, 400).astype(np.uint64)
    w1, w2 = rng.uniform(0.2, 3.5, 400), rng.uniform(0.2, 3.5, 400)
    w2[:300] = w1[:300]
    want = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    s = near_dup.dart_signatures([keys, keys], [w1, w2], k=4000)
    assert abs((s[0] == s[1]).mean() - want) < 0.03 and (s != 0).all()
    a, b = keys[:300], keys[100:]
    s = near_dup.dart_signatures([a, b, keys[:1]], k=4000)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.03 and (s[2] != 0).all()


def classes_of(df):
    out = {}
    for r in near_dup.near_classes(df).collect():
        out[r.doc_id] = (r.class_id, r.class_size)
    return out


def test_near_classes_against_all_pairs(docs, texts):
    rows = sorted((r.doc_id, r.text) for r in texts.values())
    want = near_classes(rows)
    sizes = {}
    for c in want.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert classes_of(docs) == {rows[i][0]: (rows[c][0], sizes[c]) for i, c in want.items()}


@pytest.mark.parametrize("block", [512, 7])
def test_near_copies_that_only_meet_in_a_chain(spark, block):
    import random
    rng = random.Random(7)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(400)]
    rows, words = [], list(base)
    for i in range(40):  # each differs from the one before in a few words, the ends in many
        rows.append((i, " ".join(words)))
        words = list(words)
        words[(i * 10) % 400] = f"n{i}"
    star = [f"v{rng.randrange(10 ** 6)}" for _ in range(300)]
    for i in range(300):
        words = list(star)
        for k in rng.sample(range(300), 4):
            words[k] = f"s{i}x{k}"
        rows.append((1000 + i, " ".join(words)))
    rows.append((999, " ".join(star)))
    rows.sort()
    want = near_classes(rows)
    got = {r.doc_id: r.class_id for r in near_dup.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
    assert got == {rows[i][0]: rows[c][0] for i, c in want.items()}


def test_near_edges(edge, nothing):
    rows = edge.collect()
    want = near_classes([(r.doc_id, r.text) for r in rows])
    groups = {}
    for i, c in want.items():
        groups.setdefault(c, []).append(rows[i].doc_id)
    expect = sorted((str(d), str(min((x for x in g if x is not None), default=None)), len(g)) for g in groups.values() for d in g)
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in near_dup.near_classes(edge).collect()) == expect
    assert near_dup.near_classes(nothing).collect() == []
