"""The operators against brute force, round trips and edge cases on small tables."""

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("braidwork.llm")

from braidwork.llm import chat, common, decontamination, langid, packing, quality, queries, simhash, substrings, topk, toxicity, warc  # noqa: E402

DOC = "doc_id long, text string, lang string, n_words string, fp string, chunk int"


def docs(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "x", "y", 7) for i, t in rows], DOC)


def edge_rows():
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    return [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (4, "One two"), (None, "no id here"), (5, long), (6, "é" * 3000), (7, long + " end"), (8, "A\u0000b \U0001f600 x")]


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.3, 7)]) for i in range(300)]
    vectors += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 7), (303, [math.inf] * 7), (304, []), (305, [0.5, 0.5]), (None, [0.1] * 7), (100, vectors[100][1]), (306, [1e30] + [0.0] * 6)]
    vectors += [(i + 400, vectors[i][1]) for i in range(0, 60)]  # ties
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("score", F.lit(2))
    q = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [max(-(1 << 24), min(1 << 24, math.floor(256 * max(-2.0**25, min(2.0**25, x))))) for x in v]
            q[i] = w + [0] * (7 - len(w))
    want = set()
    for i in q:
        if i % 50 == 0:
            s = sorted(((sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i), key=lambda t: (-t[0], t[1]))[:5]
            want |= {(i, r + 1, j, x) for r, (x, j) in enumerate(s)}
    for rows, group in ((1 << 16, 128), (40, 2)):
        got = {tuple(r) for r in topk.top_k(df, rows_per_block=rows, queries_per_block=group).collect()}
        assert got == want
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id = 0")).count() == 0


def brute_hits(text, items):
    words = [w.decode() for w in decontamination.words_of(text)]
    hit, found = set(), set()
    for name, t in items:
        w = [x.decode() for x in decontamination.words_of(t)]
        n = min(10, len(w))
        for a in range(len(w) - n + 1) if w else ():
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[a : a + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(name))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("most", [16 << 20, 60])
def test_decontamination(spark, most):
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 9, 10, 14])))) for i in range(12)] + [(50, None), (51, "v1 v2 v3"), (51, "Alpha, beta"), (None, "v0")]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(40)] + edge_rows()
    rows.append((90, "x! " + items[5][1].upper() + "; y"))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_contamination(docs(spark, rows), b, max_broadcast_bytes=most).select("doc_id", "n_words", decontamination.n_hit().alias("h"), "items").collect()
    assert len(got) == len(rows)
    known = [x for x in items if x[0] is not None]
    want = sorted([(i, *brute_hits(t, known)) for i, t in rows], key=str)
    assert sorted([(r.doc_id, r.n_words, r.h, r["items"]) for r in got], key=str) == want
    kept = decontamination.drop_contaminated(docs(spark, rows), b)
    assert kept.columns == docs(spark, rows).columns and kept.count() == sum(1 for x in want if not x[2])
    assert decontamination.find_contamination(docs(spark, rows), b.limit(0)).where("size(hit_spans) > 0").count() == 0


@pytest.mark.parametrize("limits", [(1024, 256, None), (64, 3, 40)])
def test_packing(spark, limits):
    from tokenizers import Tokenizer

    rows = edge_rows() + [(i, "some words here " * (i % 37)) for i in range(20, 120)] + [(200, "a<|endoftext|>b don't  stop\n\n x")]
    path = queries.tokenizer_path()
    got = packing.pack(docs(spark, rows), path, max_tokens=limits[0], max_segments=limits[1], max_loss=limits[2]).collect()
    tok = Tokenizer.from_file(path)
    want = sorted((i is None, i or 0, tuple(tok.encode(t or "", add_special_tokens=False).ids) + (0,)) for i, t in rows)
    seqs = defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        seqs[r.sequence_id].append(r)
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:k]) for k in range(len(s))]
        assert sum(r.length for r in s) <= limits[0] and len(s) <= limits[1]
        if limits[2]:
            assert sum(r.length - (r.start + r.length == r.doc_tokens) for r in s) <= limits[2]
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id, r.doc_tokens].append(r)
    rest = sum(r.length for r in got)
    assert rest == sum(len(w[2]) for w in want)
    whole = {}
    for (i, n), pieces in by_doc.items():
        if sum(p.length for p in pieces) == n:
            whole[i, n] = tuple(x for p in sorted(pieces, key=lambda p: p.start) for x in p.ids)
    assert all(whole[i, len(ids)] == ids for none, i, ids in want if not none and (i, len(ids)) in whole) and len(whole) > 100
    if limits[2] is None:
        pad = sum(1024 - n for s in seqs.values() if (n := sum(r.length for r in s)) & (n - 1))
        assert pad == 0
    assert packing.pack(docs(spark, rows).limit(0), path).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "x\r\n\r\ny" * 9000 + "\r\n"
    same = "é" * 600
    rows = [(1, "http://a/ b", big), (2, None, None), (3, "u", ""), (4, "u", same), (5, "u", same), (5, "u", same), (None, "u", same), (6, "u", "short"), (7, "u", "short"), (8, "u", big), (8, "u", "other" * 300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    warc.write_archive(df, f"file://{tmp_path}/a", segment_bytes=1000, chunk_bytes=300)
    got = warc.reassemble(warc.read_records(spark, f"file://{tmp_path}/a")).collect()
    back = sorted(((r.page_id, r.record_type, r.refers_to, r.digest, r.payload_length) for r in got), key=str)
    want = []
    for i, _, t in rows:
        raw = (t or "").encode()
        tops = [p for p, _, x in rows if x == t and p is not None]
        revisit = i is not None and len(raw) >= 1000 and i < max(tops)
        want.append((i, "revisit" if revisit else "response", max(tops) if revisit else None, hashlib.sha1(raw).hexdigest(), len(raw)))
    assert back == sorted(want, key=str)
    for r in got:
        if r.record_type == "response":
            assert hashlib.sha1(bytes(r.payload)).hexdigest() == r.digest
    with pytest.raises(ValueError):
        warc.dechunk(b"5\r\nabc\r\n0\r\n\r\n")
    warc.write_archive(df.limit(0), f"file://{tmp_path}/b")
    assert warc.reassemble(warc.read_records(spark, f"file://{tmp_path}/b")).count() == 0


def components(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("bucket", [4096, 6])
def test_links_of_fingerprints(spark, bucket):
    rng = np.random.default_rng(0)
    fps = set()
    for base in rng.integers(0, 2**63, 20, dtype=np.uint64):
        for _ in range(30):
            x = int(base)
            for k in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(k)
            fps.add(x)
    fp = np.sort(np.array(list(fps), np.uint64).view(np.int64))
    links = simhash.link_fingerprints(spark.createDataFrame([(int(x),) for x in fp], "fp long"), bucket)
    got = {r.node: r.component for r in common.connected_components(links).collect()}
    u = fp.view(np.uint64)
    brute = components(len(fp), [(i, j) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 2).tolist()])
    assert [got.get(int(x), int(x)) for x in fp] == [int(fp[r]) for r in brute]


def test_near_duplicates(spark):
    text = " ".join(f"word{i}" for i in range(400))
    rows = edge_rows() + [(10, text), (11, text.replace("word7 ", "WORD7 ")), (12, text + " tail"), (13, "quite another text than that")]
    df = docs(spark, rows)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: (r.fingerprint, r.component_id) for r in got}
    assert of[1] == of[2] == of[3] == ("0" * 16, 1) and of[11][1] == 10 and of[13][1] == 13
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(ids, key=str) == sorted({r.component_id for r in got}, key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def brute_removed(rows, n):
    first, where = {}, []
    key = lambda i: math.inf if i is None else i
    for i, t in rows:
        w = (t or "").encode().split()
        where.append((key(i), w))
        for a in range(len(w) - n + 1):
            k = tuple(w[a : a + n])
            first[k] = min(first.get(k, (math.inf, math.inf)), (key(i), a))
    out = []
    for i, w in where:
        gone = set()
        for a in range(len(w) - n + 1):
            if first[tuple(w[a : a + n])] < (i, a):
                gone |= set(range(a, a + n))
        out.append((len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("chunk", [8 << 20, 200])
def test_repeated_words(spark, chunk):
    rng = random.Random(9)
    common_ = " ".join(f"c{i}" for i in range(9))
    rows = edge_rows() + [(i, " ".join(rng.choice([common_, "a", "b", "ç d\n e"]) for _ in range(rng.randint(0, 25)))) for i in range(20, 60)]
    if chunk == 200:
        rows = [(i, t) for i, t in rows if t is None or len(t) < 5000]
    got = substrings.repeated_words(docs(spark, rows), window=6, chunk_bytes=chunk).collect()
    want = sorted(((i, n, m, hashlib.sha256(k).hexdigest()) for (i, _), (n, m, k) in zip(rows, brute_removed(rows, 6))), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    df = docs(spark, rows)
    text = substrings.repeated_words(df, window=6, chunk_bytes=chunk, result="text", keep=("lang", "chunk"))
    assert text.columns == ["doc_id", "text", "lang", "chunk", "n_removed"] and text.count() == len(rows)
    assert substrings.repeated_words(df.limit(0)).count() == 0


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "<", "<<SYS>>\n", "  é\U0001f600 \n", "", "[ROLE]x[/TURN]", "s>", "plain text"]
    turns = [("user", hard[0]), ("assistant", hard[0])] + [(r, t) for t in hard for r in ("system", "user", "assistant", "tool<s>", "")]
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant" and t]
    rows = [(1, n, r, t) for n, (r, t) in enumerate(turns)] + [(2, None, None, None), (2, 1, "assistant", "yes"), (2, 1, "assistant", "yes"), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("p"))
    by = defaultdict(list)
    for c, n, r, t in rows:
        by[c].append((-1 if n is None else n, r or "", t or ""))
    for part in (1_000_000, 5):
        out = chat.format_chat(df, queries.tokenizer_path(), part_chars=part)
        got = {r.conv_id: r for r in chat.digests(out).collect()}
        assert set(got) == set(by)
        for c, own in by.items():
            own = sorted(own)
            loss = "".join(t for _, r, t in own if r == "assistant")
            assert got[c].n_turns == len(own) and got[c].loss_chars == len(loss)
            assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
            assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
            assert got[c].formatted_chars == len(chat.render([(r, t) for _, r, t in own])[0])
    assert chat.digests(chat.format_chat(df.limit(0), queries.tokenizer_path())).count() == 0


SF = "/root/testdata/sf0.01"


def test_classifiers_on_held_out_documents(spark):
    d, l = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    q = quality.quality(d, l).join(l, "doc_id").where("held_out")
    assert q.where("predicted = quality").count() >= 0.95 * q.count()
    t = toxicity.toxicity(d, l)
    assert t.count() == d.count()
    seen = t.join(l, "doc_id")
    assert seen.where("predicted = toxic").count() >= 0.95 * seen.count()
    lang = langid.languages(d).join(d, "doc_id").where("held_out")
    assert lang.where("lang_pred = lang").count() >= 0.95 * lang.count()


def test_quality_learns_from_every_labelled_row_and_pair(spark):
    """2000 documents of each label and 40,000 drawn pairs gave other scores."""
    rng = random.Random(8)
    text = lambda loud: " ".join((w.upper() if rng.random() < loud else w) + "!" * (rng.random() < loud) for w in (f"w{rng.randrange(90)}" for _ in range(rng.randrange(1, 25))))
    labels = [(i, int(i % 60 != 0)) for i in range(3600)]
    rows = [(i, text(0.15 if y else 0.35)) for i, y in labels]
    out = {r.doc_id: r.score for r in quality.quality(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    x = np.concatenate(list(quality.features(pa.array([t for _, t in rows]))))
    use = np.array([zlib.crc32(str(i).encode()) % 4 != 2 for i, _ in labels])
    good = np.array([y == 1 for _, y in labels])
    assert (use & good).sum() > 2400 and (use & ~good).sum() * (use & good).sum() > 90_000
    z = np.clip((x - x[use].mean(axis=0)) / np.maximum(x[use].std(axis=0), 1e-6), -8, 8)
    d = (z[use & good][:, None, :] - z[use & ~good][None, :, :]).reshape(-1, z.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(d @ w))
        w = w + np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + quality.RIDGE * np.eye(len(w)), d.T @ p / len(d) - quality.RIDGE * w)
    s = z @ w
    own, bad = np.sort(s[use]), (use & ~good).sum()
    want = 1 / (1 + np.exp(-((s - (own[bad - 1] + own[bad]) / 2) / (own.std() / 4) + np.log(0.7 / 0.3))))
    assert np.abs(want - np.array([out[i] for i, _ in labels])).max() < 1e-3


def test_sums_across_nodes_of_far_strengths():
    rng = np.random.default_rng(3)
    v = rng.random(9000) * (rng.random(9000) < 0.1)  # 140 units of strength
    lead = (np.arange(9000)[:, None] - np.arange(9000)[None, :]) / quality.FINE
    for sign in (1, -1):
        loss = lambda t: np.logaddexp(0, -t)
        for f, far in ((quality.other, lambda n, t: n), (quality.unsure, None), (loss, lambda n, t: t)):
            want = f(sign * lead) @ v
            assert np.allclose(quality.across(v, f, quality.FINE, sign, far), want, rtol=1e-9, atol=1e-12)


def test_classifiers_on_edge_cases(spark):
    df = docs(spark, edge_rows() + [(20, "12 34 !")])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out, name in ((quality.quality(df, labels), "score"), (toxicity.toxicity(df, labels), "score"), (langid.languages(df), "score")):
        got = out.collect()
        assert len(got) == 11 and all(0 <= r[name] <= 1 for r in got)
    lang = {r.doc_id: r.lang_pred for r in langid.languages(df).collect()}
    assert lang[1] == lang[2] == lang[20] == "und" and lang[5] == "en"
    kept = toxicity.drop_toxic(df, labels)
    assert kept.columns == df.columns and kept.count() == 11
    assert quality.quality(df.limit(0), labels).count() == 0


def test_language_machines_are_fitted_off_the_driver(spark):
    """The driver held the sample's features several times over: 118 MB more on check_h."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    tracemalloc.start()
    try:
        model = langid.train(d)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(model.names) == 4 and most < 8e6


def test_memory_given_back_keeps_tables(spark):
    d = spark.range(1000).withColumn("x", F.col("id") % 7).cache()
    wide = F.broadcast(spark.range(7).withColumnRenamed("id", "x"))
    before = d.join(wide, "x").count()
    common.freed(spark)
    assert d.join(wide, "x").count() == before == 1000
    d.unpersist()


def test_pipeline(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    out = d
    for name, stage in p.STAGES[:-1]:
        before, out = out, common.written(stage(spark, out, sf), "t").withColumn("extra", F.lit(1)) if name == "toxicity" else common.written(stage(spark, out, sf), "t")
        assert [c for c in out.columns if c != "extra"] == d.columns and out.count() <= before.count()
    ids = {r.doc_id for r in out.collect()}
    packed = p.packing(spark, out, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids
    assert 0 < len(ids) < d.count()
