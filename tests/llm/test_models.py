"""Fingerprints, graph search, fitted models and the pipeline: brute force, laws and held-out accuracy."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from rasterlab.llm import langid, near_copies, order_minhash, queries, toxicity, vamana
from tests.llm.conftest import DOCS, prose
from tests.llm.test_duplicates import plain_removed
from tests.llm.test_tokens import check_packed

SF, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def check_edits(docs, rows):
    order = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs), reverse=True)
    want = Counter()
    for i, (has, key, t) in enumerate(order):
        n, nxt = len(t) // 3, order[(i + 1) % len(order)][2]
        want[key if has else None, len(t), hashlib.sha256((t[:len(t) - n] + nxt[:n]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    text = {(r.doc_id, len(r.text or "")): r.text or "" for r in docs}
    prints = defaultdict(set)
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints[text[r.doc_id, r.n_chars]].add(r.fingerprint)
        if r.fingerprint == r.edited_fingerprint:
            assert r.near_edited == 1
    assert all(len(p) == 1 for p in prints.values())


def plain_signature(spark, text):
    """Order MinHash of a text in plain Python, with Spark's hash for the k-mers."""
    words = [w for w in (text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    grams = [(words + [None])[i:i + 2] for i in range(max(len(words) - 1, min(len(words), 1)))]
    if not grams:
        return {}
    rows = spark.createDataFrame([(i, *g) for i, g in enumerate(grams)], "i int, a string, b string").selectExpr("i", "xxhash64(a, b) h").orderBy("i").collect()
    h, seen, pool = [r.h for r in rows], Counter(), []
    for i, x in enumerate(h):
        pool.append((x, seen[x], i))
        seen[x] += 1
    hashed = spark.createDataFrame(pool, "x long, o int, i int").selectExpr("shiftrightunsigned(xxhash64(x, o), 1) g", "i").collect()
    slots = defaultdict(list)
    for g, i in sorted((r.g, r.i) for r in hashed):
        slots[g >> 57].append(i)
    return {s: [h[i] for i in sorted(v[:2])] for s, v in slots.items()}


def test_signature_is_that_of_plain_python(spark):
    for text in ("", "one", "a b", prose(1, 30) * 2, "x " * 50, prose(2, 300)):
        want = plain_signature(spark, text)
        got = spark.createDataFrame([(text,)], "t string").select(order_minhash.signature(order_minhash.F.col("t")).alias("s")).first().s
        assert {x >> 32 for x in got} == set(want)
        tuples = spark.createDataFrame([(s, v) for s, v in want.items()] or [(0, [0])], "s long, v array<long>").selectExpr("s * (1L << 32) + (xxhash64(v) & 4294967295L) x")
        assert not want or sorted(got) == sorted(r.x for r in tuples.collect())


def test_edits_of_odd_rows(odd_docs, clashing, no_docs):
    for d in (odd_docs, clashing):
        check_edits(odd_docs.collect(), order_minhash.edited_fingerprints(d).collect())
    assert order_minhash.edited_fingerprints(no_docs).count() == 0


def test_op5_on_the_table(spark):
    rows = queries.op5_order_minhash(spark, SF).collect()
    check_edits(spark.read.parquet(f"{SF}/documents.parquet").collect(), rows)
    long = [r for r in rows if r.n_chars > 500]
    assert np.mean([r.near_edited for r in long]) > 0.15 > 0.05 > np.mean([r.near_next for r in long])


def test_order_matters(spark):
    w = prose(9, 200).split()
    turned = " ".join(w[100:] + w[:100])
    shuffled = " ".join(w[::-1])
    d = spark.createDataFrame([(" ".join(w), turned, shuffled)], "a string, b string, c string")
    s = [order_minhash.signature(order_minhash.F.col(c)) for c in "abc"]
    near = d.select(order_minhash.likeness(s[0], s[0]), order_minhash.likeness(s[0], s[1]), order_minhash.likeness(s[0], s[2])).first()
    assert near[0] == 1 and near[1] > near[2]


def exact(rows, every, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, a in ok:
        if q % every == 0:
            s = sorted((-float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)), i) for i, b in ok if i != q and len(a) == len(b))
            out[q] = [(i, -x) for x, i in s[:k]]
    return out


def recall(got, want):
    mine = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        mine[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = total = 0
    for q, best in want.items():
        assert len(mine[q]) == len(best)
        assert [x[0] for x in sorted(mine[q], key=lambda x: (-round(x[1], 12), x[0]))] == [x[0] for x in mine[q]]
        hits += len({i for i, _ in best} & {i for i, _ in mine[q]})
        total += len(best)
    return hits / total


def test_op4_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{MID}/embeddings.parquet").collect()]
    assert recall(queries.op4_robust_graph(spark, MID).collect(), exact(rows, 50, 5)) >= 0.9


def test_odd_vectors(spark):
    r = random.Random(1)
    v = [[r.gauss(0, 1) for _ in range(4)] for _ in range(120)]
    rows = [(i, x) for i, x in enumerate(v)] + [(i, v[0]) for i in range(200, 260)]
    rows += [(300, None), (350, [0.0] * 4), (400, [1.0, None, 0.0, 0.0]), (450, [float("nan")] * 4), (500, [float("inf")] * 4), (None, v[1]),
             (550, [1.0, 0.0]), (551, [1.0, 1.0]), (600, [2 * x for x in v[3]])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 shard", "2 v", "3 ids", "4 block")
    got = vamana.nearest(d, every=50).collect()
    want = exact(rows, 50, 5)
    assert {x["query_id"] for x in got} == set(want)
    assert recall(got, want) >= 0.95
    first = [x["vec_id"] for x in sorted(got, key=lambda x: x["rank"]) if x["query_id"] == 0]
    assert first == [200, 201, 202, 203, 204]
    assert vamana.nearest(d.limit(0)).count() == 0


def test_shards_and_blocks_are_merged(spark, monkeypatch):
    monkeypatch.setattr(vamana, "QUERY_BLOCK", 3)
    r = np.random.default_rng(2)
    rows = [(i, x.tolist()) for i, x in enumerate(r.normal(size=(600, 8)))]
    v = vamana.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    idx = vamana.index(vamana.nodes_of(v, 6), shard=100)
    assert idx.count() == 600
    assert recall(vamana.search(idx, v.where("vec_id % 50 = 0")).collect(), exact(rows, 50, 5)) >= 0.95


def fold(i, n):
    return zlib.crc32(b"" if i is None else str(i).encode()) % n


def test_language_accuracy_on_held_out_rows(spark):
    rows = queries.op6_language_id(spark, MID).collect()
    lang = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{MID}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(lang)
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and lang[r.doc_id][0] is not None and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == lang[r.doc_id][0] for r in held]) > 0.97
    assert np.mean([r.rejected for r in held]) < 0.01


def test_languages_of_odd_rows(odd_docs, clashing, no_docs):
    m = langid.learn(odd_docs)
    for d in (odd_docs, clashing):
        rows = langid.predicted(d, m).collect()
        assert len(rows) == odd_docs.count()
        letters = Counter((r.doc_id, any(c.isalpha() for c in r.text or "")) for r in odd_docs.collect())
        assert Counter((r.doc_id, r.lang_pred != "und") for r in rows) == letters
        assert langid.without_rejected(d, m).columns == d.columns
    assert langid.predicted(no_docs, m).count() == 0
    nothing = langid.learn(no_docs)
    assert {(r.lang_pred, r.score) for r in langid.predicted(odd_docs, nothing).collect()} == {("und", 0.0)}


def test_counts_read_whole_texts_in_chunks(monkeypatch):
    text = prose(3, 500)
    want = langid.counts(text)
    monkeypatch.setattr(langid, "CHUNK", 100)
    assert (langid.counts(text) == want).all()
    assert langid.counts("12 .,") is None


def test_toxicity_on_held_out_rows(spark):
    small = "/root/testdata/sf0.1"
    rows = queries.op7_toxicity(spark, small).collect()
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.score, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    bad, good = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(b > g) + (b == g) / 2 for b in bad for g in good]) > 0.9
    assert np.mean([s >= 0.5 for s in good]) < 0.03


def test_toxicity_of_odd_rows(spark, odd_docs, clashing, no_docs):
    r = random.Random(4)
    rows = [(i, prose(i, 60) + (" vilegrub" * 3 if i % 3 == 0 else ""), None, None, None) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    m = toxicity.learn(docs, labels)
    s = toxicity.scored(docs, m).collect()
    assert np.mean([x.predicted == (x.doc_id % 3 == 0) for x in s]) > 0.97
    for d in (odd_docs, clashing):
        assert Counter(x.doc_id for x in toxicity.scored(d, m).collect()) == Counter(x.doc_id for x in odd_docs.collect())
        assert toxicity.without_toxic(d, m).columns == d.columns
    assert toxicity.scored(no_docs, m).count() == 0
    none = toxicity.learn(docs, labels.limit(0))
    assert {x.score for x in toxicity.scored(docs, none).collect()} == {0.0}
    assert r is not None


def test_windows_hold_the_whole_text():
    text = prose(8, 300) + " " + "z" * 1000
    assert b"".join(toxicity.windows(text)).replace(b" ", b"").decode() == text.lower().replace(" ", "")
    assert toxicity.windows(None) == toxicity.windows(" \n") == []


def near_copy_roots(rows):
    """The smallest doc_id of each component of five-word Jaccard of 0.8 or more, by brute force."""
    sets = [set(near_copies.shingles(r.text).tolist()) for r in rows]
    root = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or len(x & y) >= 0.8 * len(x | y):
                a, b = root[i], root[j]
                root = [b if k == a else k for k in root]
    return {min(rows[i].doc_id for i in range(len(rows)) if root[i] == k) for k in set(root)}


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    calm = corpus_pipeline.drop_toxic(spark, docs, SF)
    known = corpus_pipeline.keep_known_languages(spark, calm, SF)
    assert calm.columns == known.columns == columns
    assert known.count() > 0.7 * docs.count()
    one = corpus_pipeline.drop_near_copies(spark, known, SF)
    rows = known.collect()
    assert sorted(r.doc_id for r in one.collect()) == sorted(near_copy_roots(rows))
    cut = {r.doc_id: r for r in corpus_pipeline.drop_repeated_passages(spark, one, SF).collect()}
    rows = one.collect()
    for r, (n, gone, *_) in zip(rows, plain_removed([r.text for r in rows], 200)):
        left = cut[r.doc_id]
        assert n - gone <= len((left.text or "").encode()) <= n - gone + 6 * (gone > 0) * 5
        assert left.n_chars == len(left.text or "")
        assert (left.lang, left.source) == (r.lang, r.source)
    whole = corpus_pipeline.run(spark, SF).collect()
    check_packed(cut.values(), whole)
    assert corpus_pipeline.ORACLE_SQL is None
