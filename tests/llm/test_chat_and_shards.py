"""Chat formatting read back, and the laws of rendezvous shards."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rasterlab.llm import chat, queries, rendezvous

SF = "/root/testdata/sf0.001"
ODD = [(1, 0, "user", "hi\\<|\\"), (1, 1, "assistant", "<|im_end|>"), (1, 2, "assistant", "<\\|x"), (1, 2, "assistant", None),
       (2, None, None, "no turn"), (2, 5, "ro\nle<\\n", ""), (None, 1, "assistant", "x" * 3000), (3, 1, "user", "<"), (3, 2, "user", "|im_sep|>"),
       (3, 2, "user", "|im_sep|>"), (4, 0, "assistant", "\n\n"), (4, 1, "assistant", "\\\\<|<||>")]


def hexed(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    out = set()
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        out.add((c, len(turns), hexed("".join(f"{r}\n{x}\n" for *_, r, x in turns)), len(loss), hexed(loss)))
    return out


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string")


def test_every_turn_is_read_back(odd):
    rows = chat.chat_digests(odd.withColumn("turns", F.lit(1)).withColumn("segments", F.lit(2))).collect()
    assert {tuple(r)[:5] for r in rows} == brute(ODD)


def test_neighbours_of_a_role_share_a_block(odd):
    text = {r.conv_id: r.formatted for r in chat.chat_format(odd).collect()}
    assert text[1].count(chat.START) == text[1].count(chat.END) == 2
    assert text[1].count(chat.SEP) == 2
    assert text[3] == "<|im_start|>user\n<<|im_sep|>|im_sep|><|im_sep|>|im_sep|><|im_end|>\n"


def test_loss_is_under_the_mask_only(odd):
    for r in chat.chat_format(odd).collect():
        assert "".join(s.text for s in r.segments) == r.formatted
        assert not any(re.search(r"<\|", s.text) for s in r.segments if s.loss)


def test_no_rows(odd):
    assert chat.chat_digests(odd.limit(0)).count() == 0


def test_op2_on_the_table(spark):
    own = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    own += [(-1, 0, "user", chat.QUOTED), (-1, 1, "assistant", chat.QUOTED)]
    assert {tuple(r)[:5] for r in queries.op2_chat_format(spark, SF).collect()} == brute(own)


def check_shards(docs, rows, shards):
    want = Counter((d.doc_id, len((d.text or "").encode()) + 16, zlib.crc32((d.text or "").encode())) for d in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots, of = defaultdict(list), {}
    for r in rows:
        assert r.law == "key" and 0 <= r.shard < shards
        assert r.grown_shard in (r.shard, shards)
        assert of.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        slots[r.shard].append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def test_shards_of_odd_rows(odd_docs, clashing, no_docs):
    for d in (odd_docs, clashing):
        check_shards(odd_docs.collect(), rendezvous.place(d, 7).collect(), 7)
    assert rendezvous.place(no_docs, 7).count() == 0


def test_a_grown_shard_is_where_one_more_shard_puts_the_row(spark):
    d = spark.range(2000).selectExpr("id doc_id", "'x' text")
    now = {r.doc_id: r for r in rendezvous.place(d, 10).collect()}
    more = {r.doc_id: r.shard for r in rendezvous.place(d, 11).collect()}
    assert all(more[i] == r.grown_shard for i, r in now.items())
    moved = sum(r.grown_shard == 10 for r in now.values())
    assert 120 < moved < 250
    assert all(120 < n < 290 for n in Counter(r.shard for r in now.values()).values())


def test_weights_are_shares(spark):
    d = spark.range(4000).selectExpr("id doc_id", "'x' text")
    n = Counter(r.shard for r in rendezvous.place(d, 3, [1.0, 3.0, 0.0]).collect())
    assert 2 not in n
    assert 0.2 < n[0] / 4000 < 0.3
    with pytest.raises(ValueError):
        rendezvous.place(d, 1, [0.0])


def test_a_hot_key_has_gapless_slots(spark):
    d = spark.range(3000).selectExpr("if(id % 3 = 0, 5, id) doc_id", "'same' text").repartition(9)
    check_shards(d.collect(), rendezvous.place(d, 4).collect(), 4)


def test_op10_on_the_table(spark):
    check_shards(spark.read.parquet(f"{SF}/documents.parquet").collect(), queries.op10_rendezvous(spark, SF).collect(), 40)
