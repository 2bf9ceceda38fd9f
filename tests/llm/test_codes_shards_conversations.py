"""Operators 11, 12, 13 against plain Python."""

import hashlib
import math
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
from brute import sha
from llm_rows import SF
from pyspark.sql import functions as F

from spindle.llm import conversation, shard_tree, vector_codes

SHAPE = "vec_id long, embedding array<double>, label string, code string, error long, vec string, __label string"


def plain_codes(rows, rounds=4, parts=4, entries=256):
    """``rows``: (vec_id, vector, label), all of one length that ``parts`` divides."""
    usable = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    usable.sort(key=lambda r: (r[0] is None, r[0] or 0, [math.floor(1024 * x) for x in r[1]]))
    v = [[math.floor(1024 * x) for x in r[1]] for r in usable]
    w = len(v[0]) // parts
    cut = [[x[p * w:(p + 1) * w] for x in v] for p in range(parts)]
    books = [cut[p][:entries] for p in range(parts)]
    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = [nearest(x, books[p])[1] for x in cut[p]]
            new = []
            for e, c in enumerate(books[p]):
                mine = [x for x, k in zip(cut[p], of) if k == e]
                new.append([math.floor(sum(col) / len(mine)) if abs(sum(col)) < 2 ** 50 else sum(col) // len(mine) for col in zip(*mine)] if mine else c)
            books[p] = new
    final = [[nearest(cut[p][i], books[p]) for p in range(parts)] for i in range(len(v))]
    error = [sum(d for d, _ in f) for f in final]
    by = {}
    for r, e in zip(usable, error):
        by[r[2]] = by.get(r[2], 0) + e
    digest = sha(",".join(str(x) for b in books for c in b for x in c))
    return sorted((str(r[0]), "".join(f"{e:02x}" for _, e in f), err, by[r[2]], digest) for r, f, err in zip(usable, final, error))


def coded(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SHAPE)
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compress(df).collect())


@pytest.mark.parametrize("dim", [8])
def test_codes_are_those_of_the_plain_method(spark, dim):
    rng = random.Random(dim)
    centres = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(20)]
    rows = [(i * 3, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)], rng.choice("abc") if i % 7 else None) for i in range(700)]
    rows += [(5000 + i, [round(x, 1) for x in rows[0][1]], "tie") for i in range(40)]  # copies and ties
    rows += [(3, rows[5][1], "again"), (None, rows[6][1], "a"), (1, None, "n"), (2, [], "n"), (4, [math.nan] * dim, "n"), (5, [math.inf] + [0.0] * (dim - 1), "n"),
             (7, [None] + [0.0] * (dim - 1), "n"), (8, [-math.inf] * dim, "n"), (10, [1.0] * (dim + 4), "other length")]
    assert coded(spark, rows) == plain_codes([r for r in rows if r[0] != 10])


def test_few_equal_large_and_odd_vectors(spark):
    assert coded(spark, [(1, [0.5, -0.5, 1 / 3, 2.0], "a")]) == plain_codes([(1, [0.5, -0.5, 1 / 3, 2.0], "a")])
    same = [(i, [0.25, -0.7, 0.1, 0.0], "a") for i in range(50)]
    assert coded(spark, same) == plain_codes(same)
    rng = random.Random(1)
    large = [(i, [rng.uniform(-1, 1) * 10 ** rng.randint(0, 8) for _ in range(4)], "a") for i in range(300)]
    assert coded(spark, large) == [(*r[:2], min(r[2], 2 ** 63 - 1), min(r[3], 2 ** 63 - 1), r[4]) for r in plain_codes(large)]
    odd = [(i, [rng.uniform(-1, 1) for _ in range(6)], "a") for i in range(20)]  # filled up with zeros
    assert [r[1:3] for r in coded(spark, odd)] == [r[1:3] for r in plain_codes([(i, v + [0.0, 0.0], c) for i, v, c in odd])]
    beyond = coded(spark, [(i, [1e300, -1e300, 0.0, 1e-300], "a") for i in range(3)])
    assert [r[2] for r in beyond] == [0, 0, 0]
    assert coded(spark, [(1, None, "a")]) == [] and coded(spark, []) == []


def test_bounds_save_distances_and_lose_nothing(spark):
    from llm_rows import SF
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    out, books, dim, work = vector_codes.train(df, rounds=8)
    assert work[0][0] >= work[0][1] and work[-1][0] < 0.6 * work[-1][1] and [b for _, b in work] == [work[0][1]] * 9
    x = {r.vec_id: np.floor(1024 * np.asarray(r.embedding, np.float64)).astype(np.int64) for r in df.collect()}
    got = {r.vec_id: r.code for r in out.collect()}
    for i, v in x.items():
        d = ((v.reshape(4, 1, -1) - books.now) ** 2).sum(2)
        assert got[i] == bytes(d.argmin(1).tolist()).hex()
    for r in vector_codes.decode(out, books, dim).collect():
        assert np.abs(np.asarray(r.vec) * 1024 - x[r.vec_id]).max() < 1024


def plain_shard(key, tree):
    while tree.children:
        def draw(c):
            h = int(hashlib.md5(f"{key}:{c.name}".encode()).hexdigest()[:13], 16)
            return -math.log((h + 0.5) / 16 ** 13) / c.weight
        tree = min((c for c in tree.children if c.weight > 0), key=draw)
    return tree.shard


def place(spark, tree, n=4000):
    df = shard_tree.with_shards(spark.range(n).select(F.col("id").alias("doc_id")), tree)
    return {r.doc_id: r.shard for r in df.collect()}


def check_shards(rows, found):
    tree = shard_tree.even_tree()
    more, slots = shard_tree.grown(tree, 40), {}
    want = sorted((str(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "key", plain_shard("null" if d is None else d, tree),
                   plain_shard("null" if d is None else d, more)) for d, t in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in found) == want
    for r in found:
        assert r.grown_shard in (r.shard, 40)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards(docs, texts, edge, nothing):
    check_shards([(d, r.text) for d, r in texts.items()], shard_tree.shards(docs).collect())
    check_shards([(r.doc_id, r.text) for r in edge.collect()], shard_tree.shards(edge).collect())
    assert shard_tree.shards(nothing).collect() == []


def test_one_more_shard_takes_rows_only_into_itself(spark):
    tree = shard_tree.even_tree(7, 4, 2)
    before = place(spark, tree)
    for new in range(7, 11):
        tree = shard_tree.grown(tree, new, 1.5)
        after = place(spark, tree)
        moved = [d for d in before if before[d] != after[d]]
        assert {after[d] for d in moved} == {new} and 0.6 < len(moved) / len(before) / (1.5 / tree.weight) < 1.4
        before = after


def test_weights_and_confined_movement(spark):
    tree = shard_tree.even_tree(12, 6, 3)  # regions 0-5, 6-11; racks of three
    a = place(spark, tree)
    heavy = shard_tree.reweighted(tree, {0: 4.0})
    b = place(spark, heavy)
    size = lambda p, s: sum(x == s for x in p.values())
    assert 0.7 < size(b, 0) / (len(b) * 4 / 15) < 1.3
    for d in a:
        if a[d] != b[d]:
            assert b[d] < 6              # into the region that grew, or inside it
        if a[d] >= 6 and b[d] >= 6 or 3 <= a[d] < 6 and 3 <= b[d] < 6:
            assert a[d] == b[d]          # other subtrees keep their keys in place
    assert size(place(spark, shard_tree.reweighted(tree, {4: 0.0})), 4) == 0
    with pytest.raises(ValueError):
        shard_tree.placed(F.lit("x"), shard_tree.reweighted(shard_tree.even_tree(1), {0: 0.0}))


SPACES = " \t\n\x0b\x0c\r"


def plain_repair(rows, damage=True):
    """Operator 13 by whole strings: of each state the cheapest least audit of all that follows."""
    convs = {}
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k = zlib.crc32(key.encode()) % 20 if damage else 5
        if k == 0:
            continue
        row = (turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        mine.extend([row] * (2 if k == 3 else 1))
    out = {}
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, fault = set(), []
        for _, role, text in mine:
            last = text.rstrip(SPACES)[-1:]
            fault.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None)
            seen.add((role, text))
        steps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
        names = {"u": "user", "a": "assistant"}

        @lru_cache(maxsize=None)
        def best(i, state, inserts=0):
            found = []
            if i == len(mine):
                if state in (0, 3):
                    found.append((0, "", ()))
            else:
                _, role, text = mine[i]
                cost, audit, lines = best(i + 1, state)
                found.append((2 + cost, "D" + audit, lines))
                if fault[i] not in ("blank", "duplicate"):
                    cut = 5 * (fault[i] == "truncated")
                    for r, t in steps[state].items():
                        if role[:1] == r:
                            cost, audit, lines = best(i + 1, t)
                            found.append((cost + cut, "K" + audit, (f"{role}:{text}", *lines)))
                        elif r in names:
                            cost, audit, lines = best(i + 1, t)
                            found.append((cost + cut + 1, "R" + audit, (f"{names[r]}:{text}", *lines)))
            if inserts < 3:
                for r, t in steps[state].items():
                    if r in names:
                        cost, audit, lines = best(i, t, inserts + 1)
                        found.append((5 + cost, "I" + audit, (f"{names[r]}:", *lines)))
            return min(found, default=(10 ** 9, "", ()))

        cost, audit, lines = best(0, 0)
        turns = [t for t, _, _ in mine if t is not None]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, fault.count("blank"), fault.count("duplicate"), fault.count("truncated"),
                     sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:])), cost, audit, sha("\n".join(lines)))
    return out


CONV = "conv_id long, turn long, role string, text string, at string, kind string, audit long, fault string"


def repaired_rows(spark, rows):
    found = conversation.repair(spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], CONV)).collect()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found}
    assert len(got) == len(found)
    return got


def test_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in conversation.repair(df).collect()}
    assert got == plain_repair(rows)


def test_random_conversations(spark):
    rng = random.Random(13)
    texts = ["Yes.", "No!", "cut off", "", " \t", None, "Ok? \n", "e.g. so", "😀.", "."]
    roles = ["user", "assistant", "system", "tool", "", None, "sys", "u", "User"]
    rows = []
    for conv in range(400):
        turn = rng.randint(-3, 3)
        for _ in range(rng.randint(1, 12)):
            rows.append((conv if conv else None, turn if rng.random() < 0.95 else None, rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts)))
            turn += rng.choice([1, 1, 1, 1, 0, 2, 30])
    rng.shuffle(rows)
    want = plain_repair(rows)
    assert repaired_rows(spark, rows) == want
    assert {c for w in want.values() for c in w[6]} == set("DKR")  # a deletion is always cheaper than an insertion
    assert repaired_rows(spark, []) == {}


def test_a_conversation_over_many_ranges(spark):
    rng = random.Random(3)
    rows = [(7, i, rng.choice(["user", "assistant"]) if i % 50 < 30 else "user", f"turn {i % 700}.") for i in range(1800)]
    rows += [(8, i, "user", f"turn {i}.") for i in range(900)]               # one run
    rows += [(9, None, "assistant", f"turn {i % 5}.") for i in range(300)]   # all turns null, few texts
    rows += [(c, i, "user" if i % 2 == 0 else "assistant", "Hello there.") for c in (1, 20) for i in range(4)]
    import sys
    sys.setrecursionlimit(20_000)
    got, want = repaired_rows(spark, rows), plain_repair(rows)
    assert got == want


def test_transitions_of_a_run_are_powers():
    rng = random.Random(5)
    for _ in range(200):
        symbols = np.array([rng.randrange(9) for _ in range(rng.randint(1, 4)) for _ in range(rng.choice([1, 2, 5, 40]))])
        after = conversation.STOP
        for x in symbols[::-1]:
            after = conversation.product(conversation.power(int(x), 0), after)
        assert (conversation.product(conversation.whole(symbols), conversation.STOP) == after).all()
        choice, state = conversation.unroll(symbols, conversation.START, conversation.STOP)
        assert len(choice) == len(symbols) and state in range(4)


def test_repaired_turns_fit_the_pattern(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()] + [(999, 0, "assistant", "Only an answer."), (998, 1, "system", "Rule."), (997, 0, "user", "open")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    by = {}
    for r in conversation.repaired(df).orderBy("at", "part").collect():
        by.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    want = plain_repair(rows, damage=False)
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines)) for lines in by.values())
    assert {c: sha("\n".join(lines)) for c, lines in by.items()} == {c: w[7] for c, w in want.items() if w[7] != sha("")}
