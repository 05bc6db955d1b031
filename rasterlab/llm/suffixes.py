"""Passages of 200 bytes that occur twice, found by suffix sorting in two stages.

*Which texts meet.* Every window of ``WIDTH`` bytes has an anchor: its ``GRAM``-byte string with the
smallest hash, the leftmost of equals. Equal windows have equal anchors at equal places, so it is enough
to compare the windows of one anchor string with each other; a window belongs to one anchor only. The
windows of an anchor are one stretch of their text. Counts per anchor string decide most of it without
any sorting: a string that occurs once has no repeats, and if all its stretches are equal, all repeat.

*Suffix sorting.* What is left (stretches that differ somewhere, as at the edges of copied passages)
is sorted by suffixes, one of each kind of stretch, all stretches of an anchor string in one task. Suffixes
smaller than their successor are sorted directly, the others are induced from them by scanning the
buckets of first bytes in order; then common prefixes of neighbours are computed, and a run of
neighbours that share ``WIDTH`` bytes is a repeated window. An anchor string with more than ``GROUP``
different stretches (a passage that a large share of all texts hold) would not fit one task; its windows
are counted by their hashes, spread over all tasks, with the same result.

Spans are judged on the input. Texts are identified by content (MD5 and length), so copies are worked on
once and repeated rows get equal results. Null text is empty; texts shorter than ``WIDTH`` lose nothing.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from rasterlab.llm.common import drop_stash, in_batches, partitions, pick, stash

WIDTH = 200
GRAM = 32
HOT_SHARE = 1000         # an anchor string with more than one in so many of all anchors is hot
CHUNK = 1 << 17          # bytes that are hashed at once
SORT_BYTES = 1 << 20     # stretches sorted at once, as whole anchor groups
GROUP = 8192             # stretches of one anchor string that one task sorts; more are compared window by window


def _grams(b: np.ndarray, n: int) -> np.ndarray:
    """Mixed 64-bit hashes of all ``n``-byte strings (``n`` a power of two), by doubling."""
    h = b.astype(np.uint64) + np.uint64(1)
    base, k = 0x9E3779B97F4A7C15, 1
    while k < n:
        h = h[:-k] * np.uint64(base) + h[k:]
        base = base * base % (1 << 64)
        k *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _window_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of ``w`` values."""
    k = 1
    while 2 * k <= w:
        v = np.minimum(v[:-k], v[k:])
        k *= 2
    return np.minimum(v[:len(v) - (w - k)], v[w - k:]) if w > k else v


def anchors(b: np.ndarray, width: int = WIDTH, gram: int = GRAM):
    """(anchor hash, first window, last window) of every anchor of a text's bytes, in order."""
    reach = width - gram + 1
    parts = []
    step = max(CHUNK, 4 * width)
    for at in range(0, len(b) - width + 1, step):
        part = b[at:at + step + width - 1]
        h = _grams(part, gram)
        low = np.uint64((1 << 20) - 1)
        best = _window_min((h & ~low) | np.arange(len(h), dtype=np.uint64), reach) & low
        cut = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
        parts.append((h[best[cut]], cut + at, np.r_[cut[1:], len(best)] - 1 + at, best[cut].astype(np.int64) + at))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, first, last, where = (np.concatenate([p[i] for p in parts]) for i in range(4))
    new = np.r_[True, where[1:] != where[:-1]]  # an anchor may go on over a chunk's end
    keep = np.flatnonzero(new)
    return h[keep], first[keep], last[np.r_[keep[1:], len(new)] - 1]


def _pieces(texts: DataFrame, width: int) -> DataFrame:
    """(text_md5, anchor, stretch, first, last): the anchors of every text, with the hash of their stretch."""
    def run(texts):
        out = {n: [] for n in ("text_md5", "anchor", "stretch", "first", "last")}
        for t in texts:
            raw = (t or "").encode()
            if len(raw) < width:
                continue
            h, a, z = anchors(np.frombuffer(raw, np.uint8), width)
            key = hashlib.md5(raw).digest()
            a, z = a.tolist(), z.tolist()
            out["text_md5"] += [key] * len(a)
            out["anchor"] += h.view(np.int64).tolist()
            out["stretch"] += [_signed(xxhash.xxh3_64_intdigest(raw[i:j + width])) for i, j in zip(a, z)]
            out["first"] += a
            out["last"] += z
        return out
    return in_batches(texts.select("text"), run, "text_md5 binary, anchor long, stretch long, first long, last long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _words(b: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as a big-endian number (zeros beyond the end)."""
    v = np.r_[b, np.zeros(8, np.uint8)].astype(np.uint64)
    k = 1
    while k < 8:
        v = (v[:-k] << np.uint64(8 * k)) | v[k:]
        k *= 2
    return v[:len(b)]


def _direct(pos: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """``pos`` ordered by the ``depth`` bytes from there, eight at a time; ties stay in place."""
    if not len(pos):
        return pos
    group = np.zeros(len(pos), np.int64)
    open_ = np.arange(len(pos))
    for at in range(0, depth, 8):
        p = pos[open_]
        key = words[np.minimum(p + at, len(words) - 1)]
        order = np.lexsort((key, group[open_]))
        pos[open_] = p[order]
        key, g = key[order], group[open_]
        new = np.r_[True, (g[1:] != g[:-1]) | (key[1:] != key[:-1])]
        start = np.flatnonzero(new)
        size = np.diff(np.r_[start, len(new)])
        group[open_] = np.repeat(open_[start], size)
        open_ = open_[np.repeat(size > 1, size)]
        if not len(open_):
            break
    return pos


def two_stage(b: np.ndarray, wanted: np.ndarray, depth: int = WIDTH) -> np.ndarray:
    """The ``wanted`` positions (a mask) in the order of their suffixes, exact to ``depth`` bytes.

    ``b`` must not end inside a wanted suffix's first ``depth`` bytes. Wanted stretches should be whole:
    a suffix is induced from its successor, so each is extended to the next directly sorted one.
    """
    n = len(b)
    change = np.flatnonzero(np.r_[b[1:] != b[:-1], True])        # last position of every run of equal bytes
    run_end = change[np.searchsorted(change, np.arange(n))]
    after = np.r_[b, 0][run_end + 1].astype(np.int16)
    after[run_end == n - 1] = -1
    smaller = b.astype(np.int16) < after                          # the suffix is smaller than its successor
    # extend to the next smaller suffix, from which the ones before are induced
    nxt = np.where(smaller, np.arange(n), n)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    take = wanted.copy()
    ends = np.flatnonzero(wanted & ~np.r_[wanted[1:], False])
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, ends, 1)
    np.add.at(edge, np.minimum(nxt[ends], n - 1) + 1, -1)
    take |= np.cumsum(edge[:n]) > 0
    sorted_ = _direct(np.flatnonzero(take & smaller), _words(b), depth + 8)
    first = b[sorted_]
    bucket_at = np.searchsorted(first, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    end = n - 1
    if take[end] and not smaller[end]:                            # the empty suffix comes before all
        induced[b[end]].append(np.array([end]))

    def deal(scanned):
        """Predecessors of the scanned suffixes that are larger than these, by first byte."""
        p = scanned[scanned > 0] - 1
        p = p[take[p] & ~smaller[p]]
        c = b[p]
        order = np.argsort(c, kind="stable")
        p, c = p[order], c[order]
        cuts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else []
        for i, j in zip(cuts, [*cuts[1:], len(c)]):
            induced[c[i]].append(p[i:j])
    out = []
    for c in range(256):
        at = 0
        while at < len(induced[c]):                               # grows while runs of this byte are scanned
            out.append(induced[c][at])
            deal(induced[c][at])
            at += 1
        direct = sorted_[bucket_at[c]:bucket_at[c + 1]]
        out.append(direct)
        deal(direct)
    order = np.concatenate(out)
    return order[wanted[order]]


def shared(b: np.ndarray, order: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """For neighbours in suffix order: the length of their common prefix, at most ``width``."""
    words = _words(b)
    lcp = np.zeros(max(len(order) - 1, 0), np.int64)
    live = np.arange(len(lcp))
    last = len(b) - 1
    for at in range(0, width, 8):
        x = words[np.minimum(order[live] + at, last)] ^ words[np.minimum(order[live + 1] + at, last)]
        same = x == 0
        lcp[live[~same]] = at + sum((x[~same] >> np.uint64(64 - 8 * k) == 0).astype(np.int64) for k in range(1, 8))
        live = live[same]
        if not len(live):
            break
    lcp[live] = width
    return np.minimum(lcp, width)


def repeated_windows(stretches: list[bytes], many: list[bool], width: int = WIDTH) -> list[list[tuple[int, int]]]:
    """For every stretch the runs (first, last) of windows that occur again, within these or because of ``many``.

    A stretch holds windows at all its starts up to its length less ``width``; ``many`` says that the
    stretch itself occurs more than once.
    """
    raw = np.frombuffer(b"".join(stretches) + bytes(8), np.uint8)
    size = np.array([len(s) for s in stretches])
    start = np.r_[0, np.cumsum(size)[:-1]]
    windows = size - width + 1
    wanted = np.zeros(len(raw), bool)
    at = np.repeat(start - np.r_[0, np.cumsum(windows)[:-1]], windows) + np.arange(windows.sum())
    wanted[at] = True
    order = two_stage(raw, wanted, width)
    owner = np.repeat(np.arange(len(size)), size)[order]
    same = shared(raw, order, width) >= width
    run = np.cumsum(np.r_[True, ~same]) - 1
    weight = np.bincount(run, weights=1 + np.asarray(many)[owner]) if len(run) else np.zeros(0)
    hit = np.zeros(len(raw), bool)
    hit[order[weight[run] > 1]] = True
    out = []
    for s, w in zip(start, windows):
        m = np.flatnonzero(np.diff(np.r_[False, hit[s:s + w], False]))
        out.append(list(zip(m[::2].tolist(), (m[1::2] - 1).tolist())))
    return out


def _sorted_groups(rows: DataFrame, width: int) -> DataFrame:
    """(anchor, stretch, text, many) grouped by anchor to (anchor, stretch, runs of repeated windows)."""
    ddl = "anchor long, stretch long, run_first long, run_last long"

    def run(batches):
        held, size = [], 0

        def flush(group):
            found = repeated_windows([g[2] for g in group], [g[3] for g in group], width)
            flat = [(g[0], g[1], a, z) for g, runs in zip(group, found) for a, z in runs]
            cols = list(zip(*flat)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["anchor", "stretch", "run_first", "run_last"])
        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns]):
                if size >= SORT_BYTES and r[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[2])
        if held:
            yield flush(held)
    n = partitions(rows.sparkSession)
    return rows.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(run, ddl)


def _counted_windows(rows: DataFrame, width: int) -> DataFrame:
    """As ``_sorted_groups``, for anchors with too many stretches for a task: a run for each repeated window."""
    def run(anchors_, stretches, texts, many):
        out = {n: [] for n in ("anchor", "stretch", "at", "window", "many")}
        for a, s, t, m in zip(anchors_, stretches, texts, many):
            for i in range(len(t) - width + 1):
                for n, v in zip(out, (a, s, i, xxhash.xxh3_128_digest(t[i:i + width]), m)):
                    out[n].append(v)
        return out
    w = in_batches(rows, run, "anchor long, stretch long, at long, window binary, many boolean")
    hit = w.groupBy("window").agg(F.count("*").alias("n"), F.bool_or("many").alias("any")).where("n > 1 or any").select("window")
    return w.join(hit, "window").select("anchor", "stretch", F.col("at").alias("run_first"), F.col("at").alias("run_last"))


def _cut_out(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(anchor, stretch, bytes, many) of wanted stretches, cut from one row that holds the text."""
    lists = wanted.groupBy("text_md5").agg(F.collect_list(F.struct("anchor", "stretch", "first", "last", "many")).alias("w"))
    holder = texts.groupBy("text_md5").agg(F.min("row").alias("row"))  # copies of a text: one of them
    joined = texts.join(lists.join(holder, "text_md5"), ["text_md5", "row"]).select("text", "w")

    def run(texts, lists):
        out = {n: [] for n in ("anchor", "stretch", "bytes", "many")}
        for t, w in zip(texts, lists):
            raw = t.encode()
            for x in w:
                for n, v in zip(out, (x["anchor"], x["stretch"], raw[x["first"]:x["last"] + width], x["many"])):
                    out[n].append(v)
        return out
    return in_batches(joined, run, "anchor long, stretch long, bytes binary, many boolean")


def _joined(p: DataFrame, kinds: DataFrame) -> DataFrame:
    """``p`` with the counts of its anchors; anchors with over a thousandth of all rows (so at most a
    thousand of them) come by broadcast, so no task has to hold one."""
    kinds = stash(kinds)
    most = p.count() // HOT_SHARE
    hot = F.broadcast(kinds.where(F.col("n") > most))
    usual = p.join(hot, "anchor", "left_anti")
    return p.join(hot, "anchor").unionByName(usual.join(kinds.where(F.col("n") <= most), "anchor"))


def repeated_spans(texts: DataFrame, width: int = WIDTH, group: int = GROUP) -> DataFrame:
    """(text_md5, spans): for every text with repeats, the byte ranges (a, z) that they cover.

    ``texts`` has ``text``, its ``text_md5`` and a number ``row`` that keeps most copies of a text apart.
    """
    p = stash(_pieces(texts, width))
    kinds = p.groupBy("anchor").agg(F.count("*").alias("n"), F.min("stretch").alias("low"), F.max("stretch").alias("high")).where("n > 1")
    again = stash(_joined(p, kinds).select("text_md5", "anchor", "stretch", "first", "last", (F.col("low") == F.col("high")).alias("whole")))
    drop_stash(p)
    mixed = again.where("not whole")
    one = mixed.groupBy("anchor", "stretch").agg(F.count("*").alias("n"), F.min(F.struct("text_md5", "first", "last")).alias("of"))
    one = one.select("of.*", "anchor", "stretch", (F.col("n") > 1).alias("many"))
    large = stash(one.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > group).select("anchor"))
    if large.isEmpty():
        runs = _sorted_groups(_cut_out(texts, one, width), width)
    else:
        cut = stash(_cut_out(texts, one, width))
        runs = _sorted_groups(cut.join(large, "anchor", "left_anti"), width).unionByName(
            _counted_windows(cut.join(large, "anchor"), width))
    spans = again.where("whole").select("text_md5", F.col("first").alias("a"), (F.col("last") + width).alias("z")).unionByName(
        mixed.join(runs, ["anchor", "stretch"]).select(
            "text_md5", (F.col("first") + F.col("run_first")).alias("a"), (F.col("first") + F.col("run_last") + width).alias("z")))
    return stash(spans.distinct().groupBy("text_md5").agg(F.collect_list(F.struct("a", "z")).alias("spans")))


def merged(spans) -> list[tuple[int, int]]:
    """Overlapping and touching ranges made one, in order."""
    out: list[list[int]] = []
    for a, z in sorted((s["a"], s["z"]) for s in spans or []):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [tuple(x) for x in out]


def _with_spans(docs: DataFrame, width: int, group: int = GROUP) -> DataFrame:
    """``docs`` as (doc: struct of all columns, text, spans)."""
    text = F.col("text").cast("string")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text.alias("text"),
                    F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("text_md5"))
    row = F.coalesce(F.col("doc.doc_id").cast("long"), F.lit(-(1 << 63)))
    texts = d.select(F.coalesce("text", F.lit("")).alias("text"), "text_md5", row.alias("row"))
    return d.join(repeated_spans(texts, width, group), "text_md5", "left").drop("text_md5")


def removed(docs: DataFrame, width: int = WIDTH, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    d = _with_spans(pick(docs, doc_id="long", text="string"), width, group).select("doc.doc_id", "text", "spans")

    def run(keys, texts, spans):
        out = {n: [] for n in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
        for key, t, s in zip(keys, texts, spans):
            raw, m = (t or "").encode(), merged(s)
            kept, at = hashlib.sha256(), 0
            for a, z in m:
                kept.update(raw[at:a])
                at = z
            kept.update(raw[at:])
            for n, v in zip(out, (key, len(raw), sum(z - a for a, z in m), len(m), kept.hexdigest())):
                out[n].append(v)
        return out
    return in_batches(d, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def kept_text(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; a character goes only if all its bytes do."""
    out, at = [], 0
    for a, z in spans:
        while a < z and raw[a] & 0xC0 == 0x80:      # a character that begins before the span stays
            a += 1
        while z > a and z < len(raw) and raw[z] & 0xC0 == 0x80:
            z -= 1                                  # one that ends after it stays too
        out.append(raw[at:a])
        at = z
    return b"".join([*out, raw[at:]]).decode()


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents with their texts less all repeated passages; the other columns as they are.

    A null text stays null. If there is an ``n_chars`` it is that of the new text.
    """
    from pyspark.sql.types import StringType

    cut = F.udf(lambda t, s: t and kept_text(t.encode(), merged(s)), StringType())
    d = _with_spans(docs, width).withColumn("kept", F.when(
        F.col("spans").isNotNull() & F.col("text").isNotNull(), cut("text", "spans")).otherwise(F.col("text")))
    new = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return d.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
