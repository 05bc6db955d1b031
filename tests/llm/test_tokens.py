"""Piece encoding and packing against the libraries and plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rasterlab.llm import packing, piece_bpe, queries
from tests.llm.conftest import prose

PIECES, WORD_BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_random_strings_encode_and_decode_as_the_library(library):
    own, r = piece_bpe.PieceEncoder(PIECES), random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "the", "é", "▁", "ﬁ", "́", "中", "😀", "\x00", "tion", "<s>", "1", ".", "ing ", "     ", "\t", "zz"]
    for _ in range(1500):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        want = library.encode(s)
        assert own.encode(s) == want
        assert own.decode(want) == library.decode(want)
        assert own.digest_parts(s) == (len(want), ",".join(map(str, want)), library.decode(want))


def test_caches_that_start_anew_change_nothing(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "CACHE_WORDS", 3)
    monkeypatch.setattr(piece_bpe, "PAIRS", 5)
    own = piece_bpe.PieceEncoder(PIECES)
    for seed in range(20):
        want = library.encode(prose(seed, 50))
        assert own.digest_parts(prose(seed, 50))[:2] == (len(want), ",".join(map(str, want)))


def digest(library, text):
    ids = library.encode(text or "")
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_digests_of_odd_rows(library, odd_docs, clashing, no_docs):
    want = Counter((r.doc_id, *digest(library, r.text)) for r in odd_docs.collect())
    for d in (odd_docs, clashing):
        assert Counter(map(tuple, piece_bpe.digests(d, PIECES).collect())) == want
    assert piece_bpe.digests(no_docs, PIECES).count() == 0
    back = {r.doc_id: r.decoded for r in piece_bpe.encoded(odd_docs, PIECES).collect()}
    assert back[5] == "é中😀  x  y\n\n\tz "


def test_op1_on_the_table(spark, library):
    want = {(r.doc_id, *digest(library, r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {tuple(r) for r in queries.op1_piece_bpe(spark, SF).collect()} == want


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check_packed(docs, rows, length=4096):
    tokenizer, want = Tokenizer.from_file(WORD_BPE), Counter()
    for r in docs:
        ids = ids_of(tokenizer, r.text)
        for i, at in enumerate(range(0, len(ids), length)):
            part = ids[at:at + length]
            want[r.doc_id, i, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= length
    return len(by), sum(n for s in by.values() for _, n in s)


def test_packing_of_odd_rows(odd_docs, clashing, no_docs):
    for d in (odd_docs, clashing):
        check_packed(odd_docs.collect(), packing.pack(d, WORD_BPE).collect())
    n, total = check_packed(odd_docs.collect(), packing.pack(odd_docs, WORD_BPE, 64).collect(), 64)
    assert n <= total / 64 + 3
    assert packing.pack(no_docs, WORD_BPE).count() == 0


def test_packed_ids_of_letters_of_every_script():
    r, tokenizer, mine = random.Random(11), Tokenizer.from_file(WORD_BPE), packing.WordTokens(WORD_BPE)
    letters = [c for c in map(chr, range(0x250)) if c.isalpha()] + [c for c in map(chr, range(0x250, 0x30000)) if c.isalpha()][::37]
    others = list(".,;:!?'\u0307\u0301\u0345\u200d -_1²½\n\t\u00a0\u3000") + ["İ", "ı", "ß", "ſ", "K", "ﬁ", "ǆ", "ŉ", "ΐ", "Å"]
    for _ in range(5000):
        words = ["".join(r.choice(letters if r.random() < 0.8 else others) for _ in range(r.randint(1, 5))) + r.choice(["", "", ".", ",", "!", "?!"])
                 for _ in range(r.randint(1, 6))]
        text = r.choice([" ", " ", "\n", ", "]).join(words)
        assert mine.ids(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
    assert mine.ids("İ,") == np.array(tokenizer.encode("İ,", add_special_tokens=False).ids, "<u4").tobytes()


def test_op3_needs_hardly_more_than_the_least_number_of_sequences(spark):
    rows = queries.op3_best_fit_packing(spark, SF).collect()
    n, total = check_packed(spark.read.parquet(f"{SF}/documents.parquet").collect(), rows)
    assert n <= -(-total // 4096) * 1.01 + 1


def test_rounds_of_small_tasks_lose_nothing(spark):
    r = random.Random(2)
    parts = spark.createDataFrame([(i, 0, 0, r.randint(1, 100), i) for i in range(3000)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.packed(parts, 100, task_items=50, nearly=0).collect()
    assert sorted((x.doc_id, x.length) for x in rows) == sorted((x.doc_id, x.length) for x in parts.collect())
    fill = Counter()
    for x in rows:
        fill[x.sequence_id] += x.length
    assert max(fill.values()) <= 100
    assert len(fill) <= sum(fill.values()) / 100 * 1.02 + 2


def test_items_that_never_join_end_the_rounds(spark):
    parts = spark.range(500).selectExpr("id doc_id", "0 piece", "0L start", "60L length", "id ids_crc32")
    assert packing.packed(parts, 100, task_items=20).select("sequence_id").distinct().count() == 500


def test_best_fit_takes_the_fullest_bin():
    assert packing.best_fit([6, 5, 4, 3, 2], 10) == [[0, 2], [1, 3, 4]]
    assert packing.best_fit([], 10) == []


def test_packing_words_of_the_older_half_need_no_tokenizer():
    import public_tokenizers
    from rasterlab.llm import packing

    t = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    text = "Grüße, words. and İstanbul, İ, 42 marks! x" + "y" * 70 + "   ﬁn"
    want = t.t.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(t.ids(text), "<u4").tolist() == want
    t.old, t.young = t.young, {m: t.young[m] for m in packing.MARKS}
    calls, real = [], t.t

    class Counting:
        normalizer = real.normalizer

        def encode_batch_fast(self, words, **kw):
            calls.append(words)
            return real.encode_batch_fast(words, **kw)
    t.t = Counting()
    assert np.frombuffer(t.ids(text), "<u4").tolist() == want
    assert [w for c in calls for w in c] == ["x" + "y" * 70]  # the one that is too long to be kept
    calls.clear()
    assert np.frombuffer(t.ids("words. and Grüße,"), "<u4").tolist() == real.encode("words. and Grüße,", add_special_tokens=False).ids
    t.old, t.young = t.young, {m: t.young[m] for m in packing.MARKS}
    t.ids("words. and")
    assert not calls
