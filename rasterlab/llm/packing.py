"""Best-fit packing of documents into sequences of at most 4096 tokens.

Documents become pieces: only longer ones are cut, into full pieces and a last one. Full pieces are
sequences by themselves. The others are dealt evenly over tasks, each of which packs its own best fit,
largest first, and emits the bins that are nearly full. Underfull bins go on as items: fewer tasks take
them, pack them again best fit, and so on, until one task's worth is left or nothing joins any more.
An item carries its pieces, at most 4096 of them, so tasks hold a bounded number of bounded rows.

Null text counts as empty: a document of the closing id alone. Repeated rows are packed as often as they
occur.
"""

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterlab.llm.common import in_batches, pick, stash

LENGTH = 4096
CLOSING_ID = 1
TASK_ITEMS = 8_000  # items that one task packs
OPENED = 12          # times as many if they are single pieces
NEARLY = 8           # a bin with at most so many free places is emitted
CACHE_WORDS = 400_000  # cached words of each half of a worker's cache
MARKS = ".,;:!?"       # marks that may follow a word; each is a run of its own
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch  # letters that stay one letter in the tokenizer's normal form


class WordTokens:
    """Ids of a text, word by word: the tokenizer drops blanks, so words between them do not interact.

    Words of letters are one run for the tokenizer, and a mark after them is another, so new words of
    letters are encoded together and cut where a run ends.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.ends = np.zeros(self.t.get_vocab_size(), bool)
        self.ends[[i for p, i in self.t.get_vocab().items() if p.endswith("</w>")]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        words = text.replace("\n", " ").split(" ")
        parts = list(map(self.young.get, words))
        if None in parts:
            at = [i for i, p in enumerate(parts) if p is None]
            new = [words[i] for i in at]
            got = self._new(set(new))
            for i, w in zip(at, new):
                parts[i] = got[w]
        return b"".join(parts)

    def _new(self, missed: set[str]) -> dict[str, bytes]:
        young, old, got = self.young, self.old, {}
        marked, letters, others = [], set(), [m for m in MARKS if m not in young]
        for w in missed:
            b = old.get(w)
            if b is not None:
                got[w] = b
            elif w.isascii() and w.isalpha():  # as most words
                letters.add(w)
            elif w[-1:] in MARKS and self._letters(w[:-1]):
                marked.append(w)
            elif self._letters(w):
                letters.add(w)
            else:
                others.append(w)
        stems = {}
        for w in marked:
            s = w[:-1]
            b = young.get(s) or old.get(s)
            if b is None:
                letters.add(s)
            else:
                stems[s] = b
        if letters:
            left = list(letters)
            got.update(zip(left, self._together(left)))
        if others:
            for w, e in zip(others, self.t.encode_batch_fast(others, add_special_tokens=False)):
                got[w] = np.array(e.ids, "<u4").tobytes()
        for w in marked:
            s = w[:-1]
            got[w] = (stems.get(s) or got[s]) + (young.get(w[-1]) or got[w[-1]])
        if len(young) + len(got) > CACHE_WORDS:
            self.old, self.young = young, {m: b for m in MARKS if (b := young.get(m))}
        self.young.update(got if max(map(len, got)) <= 64 else {w: b for w, b in got.items() if len(w) <= 64})
        return got

    def _letters(self, word: str) -> bool:
        """Whether the tokenizer sees nothing but letters (its normal form may take a letter apart)."""
        return word.isalpha() and (word.isascii() or _LATIN(word) is not None or self.t.normalizer.normalize_str(word).isalpha())

    def _together(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.t.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cut = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(cut) != len(words):  # a letter that the tokenizer's normal form takes apart
            return [np.array(e.ids, "<u4").tobytes() for e in self.t.encode_batch_fast(words, add_special_tokens=False)]
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip([0, *cut], cut)]


@functools.lru_cache(2)
def tokens(path: str) -> WordTokens:
    return WordTokens(path)


def pieces(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    def run(keys, texts):
        out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
        close = np.array([CLOSING_ID], "<u4").tobytes()
        for key, text in zip(keys, texts):
            ids = tokens(path).ids(text or "") + close
            for i, at in enumerate(range(0, len(ids), 4 * length)):
                part = ids[at:at + 4 * length]
                for name, v in zip(out, (key, i, at // 4, len(part) // 4, zlib.crc32(part))):
                    out[name].append(v)
        return out
    return in_batches(pick(docs, doc_id="long", text="string"), run,
                      "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], capacity: int = LENGTH) -> list[list[int]]:
    """Bins of item numbers: largest item first, into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if some bin has r free places
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fits = rooms >> sizes[i]
        if fits:
            room = sizes[i] + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        room -= sizes[i]
        by_room.setdefault(room, []).append(b)
        rooms |= 1 << room
    return bins


MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64()), ("offset", pa.int64())])
ITEM = pa.schema([("size", pa.int32()), ("members", pa.list_(MEMBER)), ("full", pa.bool_())])
ITEM_DDL = ("size int, members array<struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long, "
            "offset: long>>, full boolean")


def _pack_task(batches, capacity, nearly):
    sizes, members = [], []
    for b in batches:
        sizes += b.column(0).to_pylist()
        members += b.column(1).to_pylist()
    out = {n: [] for n in ITEM.names}

    def flush():
        got = pa.RecordBatch.from_pydict(out, schema=ITEM)
        for v in out.values():
            v.clear()
        return got
    for b in best_fit(sizes, capacity):
        at, held = 0, []
        for i in b:
            held += [m | {"offset": m["offset"] + at} for m in members[i]]
            at += sizes[i]
        out["size"].append(at)
        out["members"].append(held)
        out["full"].append(at >= capacity - nearly)
        if len(out["size"]) == 1000:
            yield flush()
    yield flush()


def packed(parts: DataFrame, length: int = LENGTH, task_items: int = TASK_ITEMS, nearly: int = NEARLY) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; no sequence is longer than ``length``."""
    columns = [F.col(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
    one = parts.select(F.col("length").cast("int").alias("size"),
                       F.array(F.struct(*columns, F.lit(0).cast("long").alias("offset"))).alias("members"))
    done = [one.where(F.col("size") == length)]
    left = one.where(F.col("size") < length)
    count, stalled, share = left.count(), None, OPENED * task_items
    while count:
        tasks = -(-count // share)
        out = stash(left.repartition(tasks).mapInArrow(
            functools.partial(_pack_task, capacity=length, nearly=nearly), ITEM_DDL))
        bins, full = out.agg(F.count("*"), F.count_if("full")).first()
        under = bins - full
        joins = under <= 0.999 * count
        if tasks == 1 or not joins and stalled is not None and under > 0.999 * stalled:
            done.append(out.drop("full"))  # one task has seen all, or opening the bins brought nothing
            break
        done.append(out.where("full").drop("full"))
        left, count, share = out.where("not full").drop("full"), under, task_items
        if not joins:  # bins that do not join any more are opened, and their pieces meet others
            stalled = under
            piece = F.col("m").withField("offset", F.lit(0).cast("long"))
            left = left.select(F.explode("members").alias("m")).select(F.col("m.length").cast("int").alias("size"), F.array(piece).alias("members"))
            count, share = left.count(), OPENED * task_items
    bins = functools.reduce(DataFrame.unionByName, done).withColumn("sequence_id", F.monotonically_increasing_id())
    return bins.select("sequence_id", F.inline("members")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """All documents as pieces placed in sequences."""
    return packed(stash(pieces(docs, path, length)), length)
