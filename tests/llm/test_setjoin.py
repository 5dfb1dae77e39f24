"""The join of shingle sets against brute force."""

import random

import pytest

pytest.importorskip("braidwork.llm")

from braidwork.llm import setjoin, simhash  # noqa: E402
from tests.llm.test_operators import components, docs, edge_rows  # noqa: E402


def near_copies():
    rng = random.Random(4)
    line = [f"line{i}" for i in range(12)]
    rows = []
    for family in range(90):
        base = [f"f{family}w{rng.randrange(500)}" for _ in range(rng.choice([3, 5, 6, 8, 9, 10, 14, 30, 60, 140, 700]))]
        for _ in range(6):
            w = (line if rng.random() < 0.3 else []) + list(base)
            for _ in range(rng.choice([0, 1, 1, 2, max(1, len(w) // 50), max(1, len(w) // 30)])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((1000 + len(rows), " ".join(w[: len(w) - rng.choice([0, 0, 1])])))
    return rows


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(rows):
    s = [shingles(t) for _, t in rows]
    near = [(i, j) for i in range(len(s)) for j in range(i) if s[i] == s[j] or 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]) > 0]
    root = components(len(s), near)
    return root, len({(i, j) for i, j in near if s[i] != s[j]})


def test_similar_documents_against_brute_force(spark):
    rows = edge_rows() + near_copies()
    root, near = brute_groups(rows)
    assert near > 50
    low = {}
    for r, (i, _) in zip(root, rows):
        low[r] = min(low.get(r, 10**9), 10**9 if i is None else i)
    want = sorted(((i, None if low[r] == 10**9 else low[r]) for r, (i, _) in zip(root, rows)), key=str)
    got = setjoin.similar_documents(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == want
    assert setjoin.similar_documents(docs(spark, rows).limit(0)).count() == 0


def test_pipeline_stage_drops_pairs_of_four_fifths(spark):
    """Two-bit fingerprints left most of these pairs."""
    import corpus_pipeline

    rows = near_copies()
    root, _ = brute_groups(rows)
    kept = corpus_pipeline.near_duplicates(spark, docs(spark, rows), "")
    assert kept.columns == docs(spark, rows).columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(rows[r][0] for r in set(root))


def test_pipeline_stage_keeps_edge_rows(spark):
    df = docs(spark, edge_rows())
    kept = setjoin.drop_similar_documents(df)
    want = {r.component_id for r in setjoin.similar_documents(df).collect()}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str)


def test_fingerprints_give_candidates_that_shingles_confirm(spark, monkeypatch):
    """Without the signatures of sets, texts of linked fingerprints are still found; no fingerprint had a part in it."""
    base = " ".join(f"word{i}" for i in range(900))
    loud = "hum " * 200
    rows = [(1, base), (2, base.replace("word450 ", "other ")), (3, loud + " ".join(f"a{i}" for i in range(40))), (4, loud + " ".join(f"b{i}" for i in range(40))), (5, "quite another text than that")]
    prints = {r.doc_id: r.fp & (2**64 - 1) for r in simhash.fingerprints(docs(spark, rows), words=5).collect()}
    assert 0 < (prints[1] ^ prints[2]).bit_count() <= 2 and (prints[3] ^ prints[4]).bit_count() <= 2
    monkeypatch.setattr(setjoin, "_candidates", lambda *_: spark.createDataFrame([], "a long, b long"))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, rows), words=5, similarity=0.8).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
