"""Rendezvous hashing of record keys over weighted shards.

Each shard draws a number from the hash of (key, shard); a key goes to the shard with the largest
``weight / -ln(draw)``. Draws of the other shards stay as they are when a shard is added, so rows move
only into the new one.

The key is ``doc_id``; null is a key of its own. Null text has no bytes and the CRC of nothing. Repeated
rows go to the same shard and get slots of their own. Only small columns are shuffled: slots are dealt
over a range sort by (shard, key, ...) whose last column tells repeated rows apart, so a shard or key
with many rows is spread over many tasks; its running numbers come from counts of the sorted parts.
"""

import functools
import operator

from pyspark.sql import Column, DataFrame, Window, functions as F

from rasterlab.llm.common import partitions, pick, stash

ROW_BYTES = 16
LOW = (1 << 33) - 1  # the low bits of monotonically_increasing_id count the rows of a part


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) from the hash of key and shard."""
    top = F.shiftrightunsigned(F.xxhash64(F.coalesce(key, F.lit("")), key.isNull(), F.lit(shard)), 11)
    return (top.cast("double") + 0.5) / float(1 << 53)


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard, from 0, of a key (a string); shards of weight 0 get nothing, ties go to the smaller."""
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must not be negative, and one must be positive")
    scores = [F.struct((F.lit(float(w)) / -F.log(draw(key, i))).alias("s"), F.lit(-i).alias("i"))
              for i, w in enumerate(weights) if w > 0]
    return (-(F.greatest(*scores)["i"] if len(scores) > 1 else scores[0]["i"])).cast("int")


def place(docs: DataFrame, shards: int = 40, weights: list[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    ``grown_shard`` is the shard with one more shard of mean weight. Slots count from 0 in every shard.
    """
    w = weights or [1.0] * shards
    d = pick(docs, doc_id="long", text="string")
    key = F.col("doc_id").cast("string")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = d.select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        shard_of(key, w).alias("shard"), shard_of(key, [*w, functools.reduce(operator.add, w) / len(w)]).alias("grown_shard"),
        F.monotonically_increasing_id().alias("apart"))
    order = ["shard", "doc_id", "size", "text_crc32", "apart"]
    spread = stash(rows)
    at = stash(spread.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
               .withColumn("at", F.monotonically_increasing_id()).drop("apart"))
    part = F.shiftright("at", 33).alias("part")
    runs = at.groupBy("shard", part).agg(F.count("*").alias("n"), F.min(F.col("at").bitwiseAND(LOW)).alias("first"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("shard", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return at.withColumn("part", part).join(runs, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("at").bitwiseAND(LOW) + F.col("shift")).cast("long").alias("slot"), "grown_shard")
