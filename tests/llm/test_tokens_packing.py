"""Operators 3 and 6 against the tokenizers library, and their files."""

import numpy as np
import public_tokenizers
import pytest
from brute import crc, ids_of
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spindle.llm import arrow_ids, packing
from spindle.llm.tokens import Encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  ", "a  b", "a   b", " lead", "trail ", "a \n b", "a\n \nb", "don't we'll I'm", "x's", "<|endoftext|> end", "a <|endoftext|> b", "x<|startoftext|>y <|endoftext|><|endoftext|>  z", "<|ENDOFTEXT|> <|endoftext |>", "ΣΑΣ İstanbul ﬁ",
       "é é", "😀😀 🎉", "tab\tb", " nbsp   x", "word.,;", "|||", "1234 12a a12", "a.\nB c\n\nd\t\ne f\n", "x,\ny;\nz \n q", "ªº µ", "\x1c\x1d a", "a b c", "'s 't", " 's"]


def library(path):
    return Tokenizer.from_file(path)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_memoised_ids_are_the_library_s(path, texts):
    tok, enc = library(path), Encoder(path)
    for t in [*ODD, *(r.text for r in list(texts.values())[:150])]:
        assert list(np.frombuffer(enc.document(t), "<u4")) == ids_of(tok, t), t[:80]


def check_packing(rows, expected, length=packing.LENGTH):
    """``expected``: per document (in any order) its ids; rows as of the query."""
    seqs, by_doc = {}, {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    total = sum(len(i) for ids in expected.values() for i in ids)
    assert sum(r.length for r in rows) == total
    assert sorted(seqs) == list(range(-(-total // length)))  # all but the last sequence are full
    for s, parts in seqs.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at == (length if s < len(seqs) - 1 else total - length * (len(seqs) - 1))
    for doc, copies in expected.items():
        got = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[doc])
        if len(copies) == 1:
            at = 0
            for start, n, c, whole in got:
                assert start == at and whole == len(copies[0]) and c == crc(copies[0][start:start + n])
                at += n
            assert at == len(copies[0])
        else:  # rows that repeat an id
            assert sum(n for _, n, _, _ in got) == sum(map(len, copies))


def test_packing_covers_every_id_once(docs, texts):
    tok = library(BYTE)
    check_packing(packing.pack(docs, BYTE).collect(), {d: [ids_of(tok, r.text)] for d, r in texts.items()})


def test_every_window_has_the_corpus_mixture(docs, texts):
    tok = library(BYTE)
    rows = packing.pack(docs, BYTE).collect()
    total = {}
    for r in texts.values():
        total[r.source] = total.get(r.source, 0) + len(ids_of(tok, r.text))
    share = {s: n / sum(total.values()) for s, n in total.items()}
    got = {}
    for r in rows:
        got[r.sequence_id, r.source] = got.get((r.sequence_id, r.source), 0) + r.length
    last = max(r.sequence_id for r in rows)
    for w in range(last):
        for s in share:
            assert abs(got.get((w, s), 0) - share[s] * packing.LENGTH) <= 1 + (s == max(total, key=total.get)) * len(share)


@pytest.mark.parametrize("weights", [None, {"a": 1, "b": 5, "c": 1, "z": 1, "é": 2, None: 3}])
def test_packing_edges(edge, nothing, weights):
    tok = library(BYTE)
    want = {}
    for r in edge.collect():
        want.setdefault(r.doc_id, []).append(ids_of(tok, r.text))
    check_packing(packing.pack(edge, BYTE, weights).collect(), want)
    assert packing.pack(nothing, BYTE).collect() == []


def test_round_robin_sends_all_and_never_takes_back():
    rng = np.random.default_rng(1)
    for n in (1, 2, 20, 120):
        totals = rng.integers(0, 200_000, n).tolist()
        for weights in (None, rng.uniform(0.1, 5, n).tolist()):
            rr = packing.RoundRobin(totals, weights)
            sent = rr.after(np.arange(rr.rounds + 2))
            assert (np.diff(sent, axis=0) >= 0).all() and (sent[-1] == totals).all()
            assert (sent.sum(1) == np.minimum(np.arange(rr.rounds + 2) * rr.round, sum(totals))).all()


def test_arrow_files_round_trip(spark, docs, texts):
    tok = library(WORD)
    manifest = arrow_ids.write_shards(docs, WORD)
    got = {r.doc_id: r for r in arrow_ids.read_documents(manifest).collect()}
    at = 0
    for d in sorted(texts):
        ids = ids_of(tok, texts[d].text)
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    # equal-length sequences and masks, read without a copy
    for r in manifest.collect():
        seqs, _ = arrow_ids.open_shard(r.root, r.name)
        real = 0
        for i in range(seqs.num_record_batches):
            b = seqs.get_batch(i)
            b["ids"].values.to_numpy(zero_copy_only=True)
            assert b.schema.field("ids").type.list_size == arrow_ids.LENGTH == b.schema.field("mask").type.list_size
            real += b["mask"].values.true_count
        assert real == r.n_tokens


def test_arrow_files_edges(edge, nothing):
    tok = library(WORD)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in arrow_ids.read_documents(arrow_ids.write_shards(edge, WORD)).collect())
    rows = sorted(edge.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    at = 0
    for r, (start, doc, n, c) in zip(rows, got, strict=True):
        ids = ids_of(tok, r.text)
        assert (start, doc, n, c) == (at, r.doc_id, len(ids), crc(ids))
        at += n
    assert arrow_ids.read_documents(arrow_ids.write_shards(nothing, WORD)).collect() == []


def test_long_documents_leave_no_short_batch_inside_a_shard(tmp_path):
    rng = np.random.default_rng(3)
    sizes = [100_000, *rng.integers(1, 900, 40), 33_000, 30_000, *rng.integers(1, 900, 40), 30_000, 131_072, 400_000, 1, 30_000, 77]
    want = {i: rng.integers(0, 49_000, n).astype("<u2") for i, n in enumerate(sizes)}
    out = arrow_ids.ShardWriter(str(tmp_path), "s", "<u2", arrow_ids.LENGTH)
    for i, ids in want.items():
        out.add(i, ids)
    out.close()
    seqs, _ = arrow_ids.open_shard(str(tmp_path), "s")
    rows = [seqs.get_batch(i).num_rows for i in range(seqs.num_record_batches)]
    assert set(rows[:-1]) == {arrow_ids.BATCH} and 0 < rows[-1] <= arrow_ids.BATCH
    at = 0
    for doc, start, parts in arrow_ids.shard_documents(str(tmp_path), "s"):
        assert start == at and np.array_equal(np.concatenate(parts), want[doc])
        at += len(want[doc])
    assert at == out.total == sum(sizes)


@pytest.mark.parametrize("n", [64, 300])
@pytest.mark.parametrize("kind", ["equal", "uneven"])
def test_every_window_of_many_sources_has_the_mixture(n, kind):
    totals = [40_000] * n if kind == "equal" else np.random.default_rng(n).integers(1_000, 80_000, n).tolist()
    rr = packing.RoundRobin(totals)
    assert rr.round == packing.LENGTH
    sent = rr.after(np.arange(rr.rounds + 1))
    got = np.diff(sent, axis=0)
    want = packing.LENGTH * np.asarray(totals) / sum(totals)
    assert (got >= 0).all() and (got[:-1].sum(1) == packing.LENGTH).all() and (sent[-1] == totals).all()
    assert np.abs(got[:-1] - want).max() < 1.5


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_literal_added_tokens_are_one_id(spark, path):
    rows = [(1, "a <|endoftext|> b"), (2, "plain words"), (3, "<|startoftext|>x <|endoftext|>"), (4, None), (5, "<|endoftext|>" * 3000)]
    df, tok = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s")), library(path)
    got = {r.doc_id: r for r in arrow_ids.read_documents(arrow_ids.write_shards(df, path)).collect()}
    at = 0
    for d, t in rows:
        ids = ids_of(tok, t)
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    check_packing(packing.pack(df, path).collect(), {d: [ids_of(tok, t)] for d, t in rows})


def test_memos_are_bounded_by_bytes_and_emptied(monkeypatch):
    from spindle.llm import tokens
    monkeypatch.setattr(tokens, "MEMO", 4000)
    enc, tok = Encoder(BYTE), library(BYTE)
    text = " ".join(f"word{'x' * (i % 50)}q{chr(97 + i % 26)}" for i in range(3000))
    assert list(np.frombuffer(enc.encode(text), "<u4")) == tok.encode(text, add_special_tokens=False).ids
    assert enc.held <= 4000 + 400 and len(enc.rest) < 30
    enc.forget()
    assert not enc.rest and not enc.first and not enc.marked and enc.held == 0


@pytest.mark.parametrize("n", [1, 3, 20, 120])
@pytest.mark.parametrize("cells", [1, 5000, packing.CELLS])
def test_spans_are_cut_from_the_whole_table_of_rounds(n, cells, monkeypatch):
    monkeypatch.setattr(packing, "CELLS", cells)
    rng = np.random.default_rng(n)
    totals = rng.integers(1, 90_000, n)
    rr = packing.RoundRobin(totals.tolist())
    state = rr.after(np.arange(rr.rounds + 8))
    s = rng.integers(0, n, 40)
    token = rng.integers(0, totals[s])
    size = np.minimum(np.where(np.arange(40) % 9 == 0, 40_000, 700), totals[s] - token)
    for i, (first, mine, ahead) in enumerate(rr.spans(s, token, size)):
        col = state[:, s[i]]
        a, e = np.searchsorted(col, token[i], "right") - 1, np.searchsorted(col, token[i] + size[i])
        assert (first, mine) == (a, col[a:e + 1].tolist())
        assert ahead == state[a:e + 1, :s[i]].sum(1).tolist()
