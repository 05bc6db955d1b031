"""Order MinHash fingerprints in DataFrame functions.

A text is split at blanks; the k-mers are runs of ``K`` words. Equal k-mers get occurrence numbers, and
(k-mer, number) is hashed. The hash falls in one of ``SLOTS`` slots; each slot keeps its ``PICK`` smallest
hashes, puts their k-mers back in text order, and hashes that tuple. Moving text changes the order, so
the share of equal slots falls with edit distance and not only with what the texts have in common.

Everything is arrays of longs inside one row: hashes and positions share a long (the position takes as
many low bits as the document needs), so sorting is that of primitive arrays and grouping is a look at
neighbours. Nothing is exploded and no function runs over an array more than a fixed number of times.

Null text counts as empty; an empty text has empty slots, shown as dashes. Slots empty in both are not
counted; two empty texts are alike (1.0). Texts of fewer than K words have one k-mer, their words.
"""

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from rasterlab.llm.common import partitions, pick

K = 2
SLOTS = 64
PICK = 2
EMPTY = "--------"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def signature(text: Column, k: int = K, slots: int = SLOTS, pick_: int = PICK) -> Column:
    """Array of (slot, hash of the slot's ordered tuple), both in one long, for the non-empty slots."""
    slot_bits = slots.bit_length() - 1
    if 1 << slot_bits != slots:
        raise ValueError("slots must be a power of two")
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def kmers(w):
        n = F.greatest(F.size(w) - (k - 1), F.least(F.size(w), F.lit(1)))
        return F.transform(F.slice(w, 1, n), lambda _, i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))

    def of_kmers(h):
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(h)))) - 1
        return _let(mask, lambda m: sign(h, m))  # m: the bits that hold a position

    def sign(h, m):
        high = F.bitwise_not(m)
        sorted_ = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(high).bitwiseOR(i.cast("long"))))

        def numbered(s):
            starts = F.filter(F.transform(s, lambda x, j: F.when(
                (j == 0) | (x.bitwiseAND(high) != F.get(s, j - 1).bitwiseAND(high)), j)), lambda j: j.isNotNull())
            return _let(starts, lambda st: F.flatten(F.transform(st, lambda p, r: F.transform(
                F.slice(s, p + 1, F.coalesce(F.get(st, r + 1), F.size(s)) - p),
                lambda x, o: F.shiftrightunsigned(F.xxhash64(F.get(h, x.bitwiseAND(m).cast("int")), o), 1)
                .bitwiseAND(high).bitwiseOR(x.bitwiseAND(m))))))

        def picked(g):
            slot = lambda x: F.shiftright(x, 63 - slot_bits)
            starts = F.filter(F.transform(g, lambda x, j: F.when((j == 0) | (slot(x) != slot(F.get(g, j - 1))), j)),
                              lambda j: j.isNotNull())

            def tuple_hash(p):
                here = slot(F.get(g, p))
                at = [F.when(slot(F.get(g, p + j)) == here, F.get(g, p + j).bitwiseAND(m).cast("int")) for j in range(pick_)]
                ordered = F.sort_array(F.array(*at))
                return here * (1 << 32) + F.xxhash64(F.transform(ordered, lambda i: F.get(h, i))).bitwiseAND((1 << 32) - 1)
            return F.transform(starts, tuple_hash)
        return _let(sorted_, lambda s: _let(F.sort_array(numbered(s)), picked))
    return _let(words, lambda w: _let(kmers(w), of_kmers))


def shown(sig: Column, slots: int = SLOTS) -> Column:
    """The signature as text: eight hex digits a slot, dashes where it is empty."""
    have = F.map_from_entries(F.transform(sig, lambda x: F.struct(
        F.shiftright(x, 32), F.lpad(F.lower(F.hex(x.bitwiseAND((1 << 32) - 1))), 8, "0"))))
    return _let(have, lambda h: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long")),
                                                         lambda i: F.coalesce(F.try_element_at(h, i), F.lit(EMPTY))), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots among those that are not empty in both."""
    return _let(F.struct(a.alias("a"), b.alias("b")), lambda s: _let(
        F.struct(F.size(F.array_intersect(s["a"], s["b"])).alias("same"),
                 F.size(F.array_union(F.transform(s["a"], lambda x: F.shiftright(x, 32)),
                                      F.transform(s["b"], lambda x: F.shiftright(x, 32)))).alias("used")),
        lambda n: F.when(n["used"] == 0, 1.0).otherwise(n["same"] / n["used"])))


def with_next(d: DataFrame) -> DataFrame:
    """(doc_id, text) with ``sig``, and with text and sig of the row with the next smaller doc_id.

    After the last comes the first. Rows are cut by doc_id into ranges of about equal counts; a window
    runs inside a range, and the top row of a range is handed to the range above it. Null ids come last;
    equal ids are ordered by text.
    """
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    n = partitions(d.sparkSession)
    cuts = d.select(key.alias("k")).agg(
        F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], 20 * n).alias("c"), F.min("k").alias("m")).first()
    cuts = sorted({float(c) for c in cuts["c"] or []} - {float(cuts["m"] or 0)})
    d = d.withColumn("k", key)
    if cuts:
        d = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="kd", outputCol="range").transform(
            d.withColumn("kd", F.col("k").cast("double"))).drop("kd").withColumn("range", F.col("range").cast("int"))
    else:
        d = d.withColumn("range", F.lit(0))
    last = len(cuts)
    down = Window.partitionBy("range").orderBy(F.desc("k"), F.desc("text"))
    top = F.broadcast(d.groupBy("range").agg(F.max("k").alias("k")))  # a row for each range, at most ``n``
    first = d.join(top, ["range", "k"], "left_semi").groupBy("range").agg(F.max("text").alias("handed")).select(
        F.when(F.col("range") == last, 0).otherwise(F.col("range") + 1).alias("range"), "handed")
    own = d.withColumn("sig", signature(F.col("text")))
    got = own.withColumn("inner", F.lead(F.struct("text", "sig")).over(down)).join(
        first.withColumn("handed_sig", signature(F.col("handed"))), "range", "left")
    return got.select("doc_id", "text", "sig", F.coalesce("inner.text", "handed").alias("next_text"),
                      F.when(F.col("inner").isNull(), F.col("handed_sig")).otherwise(F.col("inner.sig")).alias("next_sig"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts and of their edited texts, and likenesses to these and to the next text."""
    d = with_next(pick(docs, doc_id="long", text="string").fillna("", ["text"]))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    d = d.select("doc_id", "sig", n.cast("long").alias("n_chars"), "next_sig", edited.alias("edited"))
    d = d.withColumn("edited_sig", signature(F.col("edited"))).withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    return d.select("doc_id", "n_chars", "edited_sha256", shown(F.col("sig")).alias("fingerprint"),
                    shown(F.col("edited_sig")).alias("edited_fingerprint"),
                    likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
                    likeness(F.col("sig"), F.col("next_sig")).alias("near_next"))
