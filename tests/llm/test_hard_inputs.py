"""Inputs that hashes, bounds and cuts might get wrong, and edge rows of every stage."""

import hashlib
import math

import numpy as np
import pytest

pytest.importorskip("braidwork.llm")

from braidwork.llm import chat, common, langid, packing, quality, queries, setjoin, simhash, spans, substrings, tokens, topk, toxicity  # noqa: E402
from tests.llm.test_operators import docs, edge_rows  # noqa: E402
from tests.llm.test_setjoin import near_copies  # noqa: E402

SF = "/root/testdata/sf0.1"


def thue_morse(n):
    """A word and its complement: sums over positions of the letters of both agree modulo powers of two."""
    t = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return t, t.translate(str.maketrans("ab", "ba"))


def test_hashes_tell_thue_morse_words_apart():
    for n in (8, 64, 128, 1024, 2048):
        raw = "".join(thue_morse(n)).encode()
        for which in (0, 1):
            h = spans.span_hashes(np.frombuffer(raw, np.uint8), np.array([0, n]), np.array([n, 2 * n]), which)
            assert h[0] != h[1]
    a, b = spans.span_hashes(np.frombuffer(b"ab", np.uint8), np.array([0, 1]), np.array([1, 2]))
    pick = np.array([[a, b][i.bit_count() & 1] for i in range(2048)])
    other = np.array([[b, a][i.bit_count() & 1] for i in range(2048)])
    assert spans.window_hashes(pick, 2048)[0] != spans.window_hashes(other, 2048)[0]


def test_packed_ids_of_thue_morse_words(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    t, u = thue_morse(2048)
    rows = [(1, t), (2, u), (3, t + " " + u), (4, u + "\n" + t)]
    got = {}
    for r in packing.pack(docs(spark, rows).coalesce(1), path).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.ids))
    for i, x in rows:
        assert [k for _, p in sorted(got[i]) for k in p] == tok.encode(x, add_special_tokens=False).ids + [0]


def test_pieces_that_share_a_hash_are_compared(monkeypatch):
    e = tokens.Encoder(queries.tokenizer_path())
    texts = ["one two three", "two  four", "don't we'll é"]
    want = [e.library.encode(t, add_special_tokens=False).ids for t in texts]
    real = tokens.span_hashes
    for same in (lambda v, s, t, which=0: real(v, s, t, which) & np.uint64(3), lambda v, s, t, which=0: real(v, s, t, which) & np.uint64(3) if not which else real(v, s, t, which)):
        monkeypatch.setattr(tokens, "span_hashes", same)
        e._forget()
        assert [x.tolist() for t in texts for x in e.encode([t])] == want
        assert [x.tolist() for x in e.encode(texts)] == want


def test_windows_of_thue_morse_words_are_not_repeats(spark):
    t, u = thue_morse(2048)
    w = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{w} {t}"), (2, f"{w} {u}"), (3, f"{w} {u} x")]
    got = {r.doc_id: r.n_removed for r in substrings.repeated_words(docs(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 20}


def test_a_window_that_most_documents_share(spark):
    common_ = " ".join(f"c{i}" for i in range(25))
    rows = [(i, f"a{i} {common_} b{i}") for i in range(400)] + [(400 + i, common_) for i in range(50)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.repeated_words(docs(spark, rows), chunk_bytes=2000).collect()}
    assert got[0] == (27, 0) and all(got[i] == (27, 25) for i in range(1, 400)) and all(got[i] == (25, 25) for i in range(400, 450))


def test_top_k_without_a_bound(spark):
    schema = "vec_id long, embedding array<double>"
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame([(50, [1e6]), (1, [1e6]), (2, [1e5])], schema), bound=None).collect()]
    assert sorted(got) == [(50, 1, 1, 256_000_000**2), (50, 2, 2, 256_000_000 * 25_600_000)]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame([(50, [1.0]), (1, [1.0]), (1, [2.0])], schema), bound=None).collect()]
    assert sorted(got) == [(50, 1, 1, 131072), (50, 2, 1, 65536)]
    vectors = [(0, [1e30, -1.0]), (1, [1e29, 0.5]), (2, [2e29, 0.5]), (3, [-1e29, 3.0]), (4, [-2e29, 3.0]), (5, [0.25, 7.0]), (100, [1e25, 1.0]), (6, [-0.001, 0.0])]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(vectors, schema), bound=None).collect()]
    q = {i: [math.floor(256 * x) if abs(x) < 2**40 else 256 * int(x) for x in v] for i, v in vectors}
    want = []
    for i in (0, 100):
        best = sorted(((sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i), key=lambda t: (-t[0], t[1]))[:5]
        want += [(i, r + 1, j, min(max(s, -(2**63)), 2**63 - 1)) for r, (s, j) in enumerate(best)]
    assert sorted(got) == sorted(want)


def test_top_k_exchange_grows_with_the_rows():
    """Vectors that travel: all rows for each group of queries, all queries for each block of rows."""

    def exchanged(n):
        blocks, groups = topk.layout(n, n // 50, topk.ROWS_PER_BLOCK, topk.QUERIES_PER_BLOCK, 6)
        return n * groups + n // 50 * blocks

    for n in (10_000, 51_000, 200_000, 800_000):
        assert exchanged(n) <= 13 * n
    assert exchanged(800_000) <= 4.1 * exchanged(200_000)


def test_long_conversation_is_encoded_as_a_whole(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    hard = ["don't we'll  stop", "\\[INST] é\U0001f600 ", "</s>", "x" * 40, "1234 5678", "   \n\n ", "<|endoftext|>", "'", "re'", ""]
    turns = [(1, i, "assistant" if i % 2 else "user", hard[i % len(hard)] * (i % 5 + 1)) for i in range(300)]
    long = [(2, i, "assistant" if i % 2 else "user", f"{i} some words, it's {i} " * 4000) for i in range(20)]
    df = spark.createDataFrame(turns + long, "conv_id long, turn long, role string, text string")
    for part, rows in ((1_000_000, turns + long), (5, turns), (60, turns)):
        got = {}
        for r in chat.format_chat(df.where(f"conv_id in ({','.join(sorted({str(t[0]) for t in rows}))})"), path, part_chars=part).collect():
            got.setdefault(r.conv_id, []).append(r)
        for c in {t[0] for t in rows}:
            parts = sorted(got[c], key=lambda r: r.part)
            whole, loss = chat.render([(r, t) for k, _, r, t in rows if k == c])
            assert "".join(p.formatted for p in parts) == whole
            e = tok.encode(whole, add_special_tokens=False)
            assert [x for p in parts for x in p.token_ids] == e.ids
            at, mask = 0, []
            starts, ends = [], []
            for p in parts:
                starts += [x + at for x in p.token_starts]
                ends += [x + at for x in p.token_ends]
                mask += [(a + at, b + at) for a, b in zip(p.loss_from, p.loss_to) if a < b]
                at += len(p.formatted)
            assert list(zip(starts, ends)) == e.offsets
            under = sorted({i for a, b in mask for i in range(a, b)}) if c == 1 else None
            assert under is None or under == [i for a, b in loss for i in range(a, b)]
            assert len(parts) == 1 or part < len(whole)
            if c == 2:
                assert len(parts) > 1
                d = chat.digests(chat.format_chat(df.where("conv_id = 2"), path)).first()
                text = "".join(t for k, _, r, t in rows if k == 2 and r == "assistant")
                assert d.n_turns == 20 and d.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def plain_fingerprint(text, words=3):
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    if not w:
        return "0" * 16
    own = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxh64_intdigest(x, 42) for x in own]
    return f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}"


def test_fingerprints_against_a_plain_version(spark):
    rows = [r for r in edge_rows() if r[0] is not None] + [(i, " ".join(f"w{j * i % 53}" for j in range(i % 40))) for i in range(100, 150)] + [(200, "a b " * 40_000)]
    got = {(r.doc_id, r.fingerprint) for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == {(i, plain_fingerprint(t)) for i, t in rows}


def test_common_parts_come_last_without_losing_a_pair(spark, monkeypatch):
    rows = near_copies()
    passage = " ".join(f"shared{i}" for i in range(60))
    rows = [(i, f"{passage} {t}" if i % 3 else t) for i, t in rows]
    want = sorted((r.doc_id, r.component_id) for r in setjoin.similar_documents(docs(spark, rows)).collect())
    monkeypatch.setattr(setjoin, "HOT_IN_SAMPLE", 2)
    assert sorted((r.doc_id, r.component_id) for r in setjoin.similar_documents(docs(spark, rows)).collect()) == want
    monkeypatch.setattr(setjoin, "MOST_HOT", 0)
    assert sorted((r.doc_id, r.component_id) for r in setjoin.similar_documents(docs(spark, rows)).collect()) == want


def test_toxicity_on_held_out_documents(spark):
    """Of the 97 toxic ones about ten are repeated words and signs only, labelled at random."""
    d, l = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    own = toxicity.toxicity(d, l).join(l, "doc_id").where("held_out").selectExpr("toxic", "predicted").toPandas()
    hit = int(((own.toxic == 1) & (own.predicted == 1)).sum())
    assert hit >= 0.8 * (own.toxic == 1).sum() and hit >= 0.9 * (own.predicted == 1).sum()
    assert ((own.toxic == 0) & (own.predicted == 0)).sum() >= 0.98 * (own.toxic == 0).sum()


def test_classifiers_on_empty_documents(spark):
    d = docs(spark, edge_rows()).limit(0)
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(d, labels).count() == 0 and langid.languages(d).count() == 0 and quality.quality(d, labels).count() == 0
    assert toxicity.toxicity(docs(spark, edge_rows()), labels).count() == len(edge_rows())


@pytest.mark.parametrize("stage", range(5))
def test_stage_on_edge_rows(spark, stage):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    name, f = p.STAGES[stage]
    df = docs(spark, edge_rows())
    out = common.written(f(spark, df, sf), "stage")
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    if stage < 4:
        assert out.columns == df.columns and out.count() <= df.count()
    else:
        assert out.groupBy().sum("length").first()[0] == sum(r.doc_tokens for r in out.where("start + length = doc_tokens").collect())
    assert {1, 4, 5, 8} <= ids and (None in ids)
    assert f(spark, df.limit(0), sf).count() == 0
