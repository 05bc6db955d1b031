"""SimHash components and repeated passages against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from rasterlab.llm import links, queries, simhash, suffixes
from tests.llm.conftest import DOCS, prose

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """Of a list of fingerprints: the number of the smallest list position that each reaches."""
    a = np.array(fps, np.uint64)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 3
    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def brute(rows):
    fps = [plain_fingerprint(r.text) for r in rows]
    members = defaultdict(list)
    comp = plain_components(fps)
    for r, c in zip(rows, comp):
        members[c] += [r.doc_id] if r.doc_id is not None else []
    return Counter((r.doc_id, f"{f:016x}", min(members[c], default=None)) for r, f, c in zip(rows, fps, comp))


def test_simhash_of_odd_rows(odd_docs, clashing, no_docs):
    for d in (odd_docs, clashing):
        assert Counter(map(tuple, simhash.near_duplicates(d).collect())) == brute(odd_docs.collect())
        kept = simhash.one_of_each(d)
        assert kept.columns == d.columns
        want = {c for *_, c in brute(odd_docs.collect())}
        assert Counter(r.doc_id for r in kept.collect()) == Counter(want)
    assert simhash.near_duplicates(no_docs).count() == simhash.one_of_each(no_docs).count() == 0


def test_one_id_with_different_texts_keeps_each(spark):
    a, b, c = (prose(i, 60) for i in (31, 32, 33))
    rows = [(5, a, None, None, None), (5, b, None, None, None), (5, a, None, None, None), (3, b, None, None, None), (None, c, None, None, None)]
    got = sorted((r.doc_id or 0, r.text) for r in simhash.one_of_each(spark.createDataFrame(rows, DOCS)).collect())
    assert got == sorted([(5, a), (3, b), (0, c)])


def test_op8_on_the_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert Counter(map(tuple, queries.op8_simhash(spark, SF).collect())) == brute(rows)


def clouds(seed, n):
    """Fingerprints around a few centres, many within reach of each other."""
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(4)]
    out = set()
    while len(out) < n:
        x = r.choice(centres)
        for _ in range(r.randint(0, 7)):
            x ^= 1 << r.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("group", [4, 2048])
def test_large_groups_are_refiled_without_losing_links(spark, group):
    fps = clouds(group, 600)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.a: r.b for r in links.components(simhash.fingerprint_links(df, group)).collect()}
    want = defaultdict(list)
    for f, c in zip(signed, plain_components(fps)):
        want[c].append(f)
    assert Counter(tuple(sorted(v)) for v in want.values()) == Counter(
        tuple(sorted(v)) for v in grouped(signed, lambda f: got.get(f, f)).values())


def grouped(items, key):
    out = defaultdict(list)
    for x in items:
        out[key(x)].append(x)
    return out


def test_components_of_a_path_a_star_and_loops(spark):
    e = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7), (5000, 5000)]
    random.Random(1).shuffle(e)
    got = {r.a: r.b for r in links.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {i: 1000 for i in range(1001, 1100)}
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


@given(st.binary(max_size=120), st.integers(1, 24), st.integers(0, 60), st.integers(1, 60))
@settings(max_examples=150, deadline=None)
def test_two_stage_order(raw, depth, first, n):
    b = np.frombuffer(raw + bytes(8), np.uint8)
    wanted = np.zeros(len(b), bool)
    wanted[first:first + n] = True
    got = suffixes.two_stage(b, wanted, depth).tolist()
    at = lambda i: b[i:i + depth].tobytes()
    assert sorted(got) == np.flatnonzero(wanted).tolist()
    assert [at(i) for i in got] == sorted(map(at, got))
    for x, y, n in zip(got, got[1:], suffixes.shared(b, np.array(got, int), depth)):
        p, q = at(x).ljust(depth, b"\0"), at(y).ljust(depth, b"\0")
        assert n == next((i for i in range(depth) if p[i] != q[i]), depth)


def plain_removed(texts, width):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + width] for r in raw for i in range(len(r) - width + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - width + 1):
            if seen[r[i:i + width]] > 1:
                gone[i:i + width] = True
        gone[-1] = False
        kept = bytes(x for x, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) > 0).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def check_removed(docs, rows, width):
    want = Counter((d.doc_id, *x) for d, x in zip(docs, plain_removed([d.text for d in docs], width)))
    assert Counter(map(tuple, rows)) == want


def passages(spark, n=60):
    shared = [prose(900 + i, 45) for i in range(4)]
    r = random.Random(3)
    rows = []
    for i in range(n):
        parts = [prose(i, r.randint(5, 60)) for _ in range(3)]
        if i % 2:
            parts.insert(1, shared[i % 4][r.randint(0, 30):])
        if i % 5 == 0:
            parts.append(parts[0])
        rows.append((i, " ".join(parts), "en", "s", 0))
    return spark.createDataFrame([*rows, rows[3], (77, rows[4][1], None, None, None)], DOCS)


@pytest.mark.parametrize("group", [2, 8192])
def test_repeated_passages(spark, group):
    d = passages(spark)
    check_removed(d.collect(), suffixes.removed(d, group=group).collect(), 200)


def test_repeats_of_odd_rows(odd_docs, clashing, no_docs):
    for d in (odd_docs, clashing):
        check_removed(odd_docs.collect(), suffixes.removed(d).collect(), 200)
        out = suffixes.without_repeats(d)
        assert out.columns == d.columns
        assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in d.collect())
    assert suffixes.removed(no_docs).count() == suffixes.without_repeats(no_docs).count() == 0


def test_texts_longer_than_a_chunk(spark, monkeypatch):
    long = prose(50, 400)
    a = np.frombuffer(long.encode(), np.uint8)
    whole = suffixes.anchors(a)
    monkeypatch.setattr(suffixes, "CHUNK", 900)
    for x, y in zip(whole, suffixes.anchors(a)):
        assert x.tolist() == y.tolist()


def test_characters_stay_whole():
    raw = "aé中b".encode()
    assert suffixes.kept_text(raw, [(2, 4)]) == "aé中b"
    assert suffixes.kept_text(raw, [(1, 6)]) == "ab"
    assert suffixes.kept_text(raw, [(2, 6)]) == "aéb"
    assert suffixes.kept_text(raw, [(1, 5)]) == "a中b"


def test_op9_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    check_removed(docs, queries.op9_suffix_dedup(spark, SF).collect(), 200)
