"""SimHash near-duplicates by multi-index hashing.

Fingerprints are looked up, not compared with all others. A 64-bit fingerprint is cut in two halves; two
fingerprints that differ in at most three bits differ in at most one bit in one of the halves. So every
fingerprint is filed under both halves, and looks up each half and its Hamming ball of radius one. As the
two of a pair differ in that bit, it is enough to look for values with one *more* bit set.

Equal fingerprints are one node before anything is looked up, so copies cost nothing. The fetched groups
(all fingerprints filed or looked up under a value) are verified inside tasks with whole-fingerprint
distances; a group yields links that join its linked members, never all its pairs. A group beyond
``GROUP`` members is not compared at all as it is: it is filed again by the two quarters of the other
half (same rule, same completeness), which spreads it. Verification inside a group keeps to blocks, so
memory stays bounded.

Null and empty texts have fingerprint zero, linked like any other. Repeated rows are repeated.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from rasterlab.llm.common import in_batches, partitions, pick, stash
from rasterlab.llm.links import components

RADIUS = 3
SHINGLE = 3
SEED = 42
GROUP = 2048
BLOCK = 1024
HASHES = 1 << 16  # shingle hashes turned into bits at once


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """SimHash of the word shingles of a text (lower-cased A-Z, words between ASCII blanks)."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lengths) - 1
        starts = (ends - lengths + 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[n - 1:].tolist())]
    counts = np.zeros(64, np.int64)
    h = np.array(hashes, "<u8")
    for at in range(0, len(h), HASHES):
        part = h[at:at + HASHES]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (a signed long)."""
    def run(keys, texts):
        f = [fingerprint(t) for t in texts]
        return {"doc_id": keys, "fp": [x - (1 << 64) if x >> 63 else x for x in f]}
    return in_batches(pick(docs, doc_id="long", text="string"), run, "doc_id long, fp long")


def _filed(fps: DataFrame) -> DataFrame:
    """(slot, value, fp, home): both halves of every fp as they are, and with one more bit set."""
    half = F.explode(F.array(*[F.struct(F.lit(i).alias("slot"), F.shiftrightunsigned("fp", 32 * i).bitwiseAND(0xFFFFFFFF).alias("value"))
                               for i in range(2)])).alias("h")
    base = fps.select("fp", half).select("fp", "h.slot", "h.value")
    ball = F.expr("transform(filter(sequence(0, 31), b -> (value & shiftleft(1L, b)) = 0), b -> value | shiftleft(1L, b))")
    return base.select("slot", "value", "fp", F.lit(True).alias("home")).unionByName(
        base.select("slot", F.explode(ball).alias("value"), "fp", F.lit(False).alias("home")))


def _refiled(groups: DataFrame) -> DataFrame:
    """Rows of large groups, filed under the quarters of the half that the group does not fix."""
    other = F.shiftrightunsigned("fp", 0).bitwiseAND(0xFFFFFFFF)
    other = F.when(F.col("slot") == 0, F.shiftrightunsigned("fp", 32)).otherwise(other)
    quarter = F.explode(F.array(*[F.struct(F.lit(i).alias("q"), F.shiftrightunsigned(other, 16 * i).bitwiseAND(0xFFFF).alias("v"))
                                  for i in range(2)])).alias("x")
    base = groups.select("slot", "value", "fp", "home", quarter).select("slot", "value", "fp", "home", "x.q", "x.v")
    # here both sides of a pair file their whole balls: the two may differ in the home flag
    ball = F.expr("concat(array(v), transform(sequence(0, 15), b -> v ^ shiftleft(1L, b)))")
    seeks = base.where("not home").select("slot", "value", "fp", "home", "q", F.explode(ball).alias("v"))
    more = F.expr("transform(filter(sequence(0, 15), b -> (v & shiftleft(1L, b)) = 0), b -> v | shiftleft(1L, b))")
    twins = base.where("home").select("slot", "value", "fp", F.lit(False).alias("home"), "q", F.explode(more).alias("v"))
    rows = base.where("home").select("slot", "value", "fp", "home", "q", "v").unionByName(seeks).unionByName(twins)
    return rows.select(F.xxhash64("slot", "value", "q", "v", F.lit("again")).alias("key"), "fp", "home")


def group_links(keys: np.ndarray, fps: np.ndarray, home: np.ndarray, radius: int = RADIUS):
    """Links that join, in every group of equal ``keys`` (sorted), the members within ``radius``.

    Only pairs with a filed member count. Small groups are compared in one go over all of them; a group
    beyond ``BLOCK`` members in blocks, where rows already joined to the same root are skipped.
    """
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[cut, len(keys)])
    has = np.add.reduceat(home, cut, dtype=np.int64) > 0 if len(cut) else np.zeros(0, bool)
    out_a, out_b = [], []
    small = has & (size > 1) & (size <= 16)
    start, n = cut[small], size[small]
    for step in range(1, 16):  # members at distance ``step`` in the same group
        live = n > step
        if not live.any():
            break
        s, m = start[live], n[live] - step
        i = np.repeat(s - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum())
        j = i + step
        near = (home[i] | home[j]) & (np.bitwise_count(fps[i] ^ fps[j]) <= radius) & (fps[i] != fps[j])
        out_a.append(fps[i[near]])
        out_b.append(fps[j[near]])
    for s, n in zip(cut[has & (size > 16)], size[has & (size > 16)]):
        a, b = _spanning(fps[s:s + n], home[s:s + n], radius)
        out_a.append(a)
        out_b.append(b)
    none = np.zeros(0, fps.dtype)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _spanning(fps: np.ndarray, home: np.ndarray, radius: int):
    """Links that join a group's near members: breadth first, each unreached member is reached once."""
    order = np.argsort(~home, kind="stable")
    u, first = np.unique(fps[order], return_index=True)
    filed = home[order][first]
    out_a, out_b = [], []
    left = np.ones(len(u), bool)
    while (left & filed).any():  # the others link to filed members only
        front = np.flatnonzero(left & filed)[:1]
        left[front] = False
        while len(front):
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            parent = np.full(len(rest), -1)
            for at in range(0, len(front), BLOCK):
                f = front[at:at + BLOCK]
                for lo in range(0, len(rest), BLOCK):
                    open_ = np.flatnonzero(parent[lo:lo + BLOCK] < 0) + lo
                    r = rest[open_]
                    near = (np.bitwise_count(u[f][:, None] ^ u[r][None, :]) <= radius) & (filed[f][:, None] | filed[r][None, :])
                    hit = near.any(axis=0)
                    parent[open_[hit]] = f[near[:, hit].argmax(axis=0)]
            new = parent >= 0
            out_a.append(u[rest[new]])
            out_b.append(u[parent[new]])
            left[rest[new]] = False
            front = rest[new]
    none = np.zeros(0, fps.dtype)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _verified(rows: DataFrame) -> DataFrame:
    """Links (a, b) of rows (key, fp, home), a group of equal keys at a time."""
    def run(batches):
        held: list[tuple] = []

        def links(parts):
            k, f, h = (np.concatenate([p[i] for p in parts]) for i in range(3))
            a, b = group_links(k, f, h)
            return pa.RecordBatch.from_pydict({"a": a.view(np.int64), "b": b.view(np.int64)})
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column(0).to_numpy()
            f = batch.column(1).to_numpy().view(np.uint64)
            h = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            last = int(np.searchsorted(k, k[-1]))  # the last group may go on in the next batch
            if last:
                yield links([*held, (k[:last], f[:last], h[:last])])
                held = []
            held.append((k[last:], f[last:], h[last:]))
        if held:
            yield links(held)
    n = partitions(rows.sparkSession)
    return rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def fingerprint_links(fps: DataFrame, group: int = GROUP) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct ``fp`` within ``RADIUS`` bits."""
    filed = _filed(fps)
    key = F.xxhash64("slot", "value")
    # values that only one fingerprint is filed or looked up under are most of them; the sizes need no rows
    sizes = filed.where("home").groupBy("slot", "value").agg(F.count("*").alias("n"))
    large = stash(sizes.where(F.col("n") > group).select("slot", "value"))
    if large.isEmpty():
        return _verified(filed.select(key.alias("key"), "fp", "home"))
    large = F.broadcast(large) if large.count() <= 10_000 else large
    rest = filed.join(large, ["slot", "value"], "left_anti").select(key.alias("key"), "fp", "home")
    return _verified(rest.unionByName(_refiled(filed.join(large, ["slot", "value"]))))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach)."""
    d = stash(fingerprints(docs))
    nodes = stash(d.groupBy("fp").agg(F.min("doc_id").alias("low")))
    of = components(fingerprint_links(nodes.select("fp")))  # a: fp, b: its component's smallest fp
    member = nodes.join(of.withColumnRenamed("a", "fp"), "fp", "left").select(
        "fp", F.coalesce("b", "fp").alias("root"), "low")
    low = member.groupBy("root").agg(F.min("low").alias("component_id"))
    member = member.join(low, "root").select("fp", "component_id")
    return d.join(member, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` less near-duplicates: of each component the smallest doc_id, once.

    Decided per doc_id and text: rows of one doc_id whose texts differ are documents of their own, only
    repeats of the same text go. A component without any doc_id keeps one of its texts.
    """
    text = F.col("text").cast("string")
    key = F.concat_ws(" ", F.col("doc_id").cast("long").cast("string"), F.md5(F.coalesce(text, F.lit(""))))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), key.alias("key"),
                    F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    f = stash(in_batches(d.select("key", "doc_id", "text"), lambda keys, ids, texts: {
        "key": keys, "doc_id": ids, "fp": [_signed(fingerprint(t)) for t in texts]}, "key string, doc_id long, fp long"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    nodes = stash(f.groupBy("fp").agg(F.min(order).alias("low")))
    of = components(fingerprint_links(nodes.select("fp"))).withColumnRenamed("a", "fp")
    roots = nodes.join(of, "fp", "left").groupBy(F.coalesce("b", "fp").alias("root")).agg(F.min("low").alias("low"))
    kept = d.select("key", "doc").join(roots.select("low.key"), "key", "left_semi").dropDuplicates(["key"])
    return kept.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x
