"""Archives, lexical search and pivot clustering against brute force."""

import hashlib
import io
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from rasterlab.llm import nra, pivots, warc
from tests.llm.conftest import prose

PAGES = "page_id long, url string, html string"
ITEMS = "item_id long, text string"
VECTORS = "vec_id long, embedding array<float>"


def odd_pages():
    long_ = prose(1, 300)
    rows = [(1, "http://a/ü b\r\nX: y", long_), (5, None, long_), (3, "", long_), (None, "u", long_), (7, "u", "short"), (8, "u", "short"),
            (9, "u", None), (10, "u", ""), (11, "u", "é" * 500), (12, "u", "é" * 500), (13, "u", "e" * 999), (14, "u", "e" * 999),
            (20, "u", prose(2, 400)), (20, "u", prose(2, 400)), (19, "u", prose(2, 400)), (21, "u", "x" * 300_000), (5, "other", prose(3, 200)),
            (None, None, prose(4, 300)), (None, None, prose(4, 300)), (30, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 100), (31, None, None)]
    return rows + [(100 + i, f"http://h/{i}", prose(i, 250)) for i in range(60)]


def plain_pages(rows):
    top = {}
    for i, _, t in rows:
        if i is not None:
            top[t or ""] = max(i, top.get(t or "", i))
    out = Counter()
    for i, _, t in rows:
        b = (t or "").encode()
        m = top.get(t or "")
        again = len(b) >= 1000 and m is not None and i != m
        out[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", m if again else None] += 1
    return out


def columns(df):
    return Counter(tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


def test_archives_give_back_every_page(spark):
    rows = odd_pages()
    d = spark.createDataFrame(rows, PAGES).repartition(3)
    assert columns(warc.roundtrip(d)) == plain_pages(rows)
    clash = d.select("*", *[F.lit(1).alias(n) for n in ("payload", "same", "response", "revisit", "file", "records", "n")])
    assert columns(warc.roundtrip(clash)) == plain_pages(rows)
    assert warc.roundtrip(d.limit(0)).count() == 0
    few = rows[:2]
    assert columns(warc.roundtrip(spark.createDataFrame(few, PAGES))) == plain_pages(few)


def test_archives_end_at_their_size_and_carry_their_dictionary(spark):
    rows = [(i, "u", prose(i, 400)) for i in range(300)]
    files = warc.write(spark.createDataFrame(rows, PAGES).coalesce(2), archive_bytes=50_000)
    held = files.collect()
    assert sum(f.records for f in held) == 300 and len(held) > 4
    assert max(f.bytes for f in held) < 60_000 + warc.DICTIONARY_BYTES
    raw = open(held[0].file.removeprefix("file:"), "rb").read()
    assert len(raw) == held[0].bytes
    assert int.from_bytes(raw[:4], "little") == warc.SKIPPABLE
    got = list(warc.records(io.BytesIO(raw)))
    assert len(got) == held[0].records + 1 and warc.parse(got[0])[0]["warc-type"] == "warcinfo"
    size = int.from_bytes(raw[4:8], "little")
    with pytest.raises(zstandard.ZstdError):  # frames need the dictionary
        zstandard.ZstdDecompressor().decompressobj().decompress(raw[8 + size:])
    assert {r.page_id: bytes(r.payload).decode() for r in warc.read(files).collect()} == {i: t for i, _, t in rows}


def test_a_damaged_record_is_noticed():
    raw = warc.record(3, "u", b"abc" * 500, None, False)
    head, block = warc.parse(raw)
    assert head["warc-type"] == "response" and block.endswith(b"abc" * 500)
    with pytest.raises(ValueError):
        warc.parse(raw[:-5])
    with pytest.raises(ValueError):
        warc._page(raw.replace(b"abcabc", b"abcabd", 1))
    packed = zstandard.ZstdCompressor().compress(raw)
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(packed[:-3])))
    assert list(warc.records(io.BytesIO(packed * 3))) == [raw] * 3
    assert list(warc.records(io.BytesIO(b""))) == []


def plain_terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_ranking(docs, items, k=10):
    ts = [Counter(plain_terms(t)) for _, t in docs]
    n = [sum(t.values()) for t in ts]
    docs_n, length = sum(x > 0 for x in n), sum(n)
    df = Counter(w for t in ts for w in t)
    out = Counter()
    for item, text in items:
        found = []
        for (doc, _), t, m in zip(docs, ts, n):
            s = sum(math.floor(1000 * math.log((2 * docs_n + 2) / (2 * df[w] + 1))) * (10**9 * t[w] // (1000 * t[w] + 8 * (10 + 90 * m * docs_n // length)))
                    for w in set(plain_terms(text)) if t[w])
            if s > 0:
                found.append((-s, doc is None, doc or 0))
        for rank, (s, none, doc) in enumerate(sorted(found)[:k], 1):
            out[item, rank, None if none else doc, -s] += 1
    return out


def ranking(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def test_search_equals_brute_force(spark, odd_docs, clashing, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    items = [(1, prose(3, 20)), (2, None), (3, "nothing of this kind"), (1, "THE tion Anan é中😀"), (None, "heed shon"), (4, "a a a"), (5, "x_y z\x00")]
    q = spark.createDataFrame(items, ITEMS)
    want = plain_ranking(docs, items)
    assert ranking(nra.ranked(odd_docs, q)) == want
    assert ranking(nra.ranked(clashing, q.withColumn("rank", F.lit(1)).withColumn("score", F.lit("x")))) == want
    assert ranking(nra.ranked(odd_docs, q, item_bytes=60)) == want
    assert nra.ranked(no_docs, q).count() == nra.ranked(odd_docs, q.limit(0)).count() == 0


def test_search_over_many_shards_with_ties(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(r.choices(vocabulary, [1 / (j + 1) for j in range(60)], k=r.choice([5, 5, 20, 80])))) for i in range(1500)]
    docs += [(2000 + i, docs[7][1]) for i in range(400)]
    r.shuffle(docs)
    items = [(i, " ".join(r.choices(vocabulary, k=8))) for i in range(12)] + [(50, docs[3][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert ranking(nra.ranked(d, spark.createDataFrame(items, ITEMS), shard_docs=100)) == plain_ranking(docs, items)


def test_search_stops_reading_once_all_is_decided():
    n = 20_000
    r = np.random.default_rng(1)
    term = np.repeat([1, 2], n)
    impacts = np.r_[r.permutation(n), r.permutation(n)] + 1
    impacts[[5, n + 5]] = 900_000
    s = nra.Shard(np.tile(np.arange(n), 2), term, impacts, n, 2)
    d, score, read = s.search(np.array([1, 2]), np.array([10, 20]), [], 1)
    assert d.tolist() == [5] and score.tolist() == [27_000_000] and read < n / 10


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(np.float32(c))) for c in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    cents = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def assign():
        out = []
        for _, v in kept:
            out.append(min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents)))
        return out
    for _ in range(rounds):
        a = assign()
        for j in range(len(cents)):
            if own := [v for (_, v), (_, c) in zip(kept, a) if c == j]:
                cents[j] = [sum(x) // len(own) for x in zip(*own)]
    a = assign()
    total = Counter()
    for d, c in a:
        total[c] += d
    return Counter((i, c, d, total[c], sum(total.values()), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest())
                   for (i, _), (d, c) in zip(kept, a))


def clusters(df):
    return Counter(tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


def some_vectors(n, spread):
    r = np.random.default_rng(n)
    centres = r.normal(size=(9, 64))
    return [(i, (centres[i % 9] + spread * r.normal(size=64)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_clusters_equal_brute_force(spark, spread):
    rows = some_vectors(150, spread)
    odd = [(500, None), (501, [1.0] * 63), (502, [None] + [1.0] * 63), (503, [float("nan")] * 64), (504, [float("inf")] + [0.0] * 63), (505, []),
           (None, [0.5] * 64), (None, [0.25] * 64), rows[3], rows[3], (506, [0.0] * 64), (507, [-0.0] * 64)]
    rows = rows + odd + [(600 + i, rows[0][1]) for i in range(40)]
    d = spark.createDataFrame(rows, VECTORS).repartition(3)
    want = plain_clusters(rows)
    assert clusters(pivots.clustered(d)) == want
    names = ("cluster", "distance", "x", "to_pivot", "sums", "n", "inertia")
    assert clusters(pivots.clustered(d.select("*", *[F.lit("a").alias(n) for n in names]))) == want


def test_few_and_no_and_huge_vectors(spark):
    rows = some_vectors(5, 1.0)
    assert clusters(pivots.clustered(spark.createDataFrame(rows, VECTORS))) == plain_clusters(rows)
    none = pivots.clustered(spark.createDataFrame([], VECTORS))
    assert none.count() == 0 and none.columns[:3] == ["vec_id", "cluster", "distance"]
    huge = [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [1.0] * 64)]
    got = pivots.clustered(spark.createDataFrame(huge, VECTORS), k=1).collect()
    assert len(got) == 3 and all(x.distance >= 0 for x in got)


def test_bounds_save_exact_distances_and_change_nothing():
    x = np.floor(64 * np.array([v for _, v in some_vectors(900, 0.05)])).astype(np.int32)
    fixed, cents = pivots.farthest_first(x[:256], 16), x[:16].astype(np.int64)
    cluster, best, exact = pivots.assigned(x, pivots.to_pivots(x, fixed), cents, fixed)
    every = np.stack([pivots.squared(x, c) for c in cents], axis=1)
    assert (cluster == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert exact < every.size / 4
