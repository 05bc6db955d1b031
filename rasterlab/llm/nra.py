"""Ranked lexical search without random access (NRA) over impact-sorted lists.

Documents are tokenised once: a stored table keeps, per document, its length and its occurrences of the
searched terms. Corpus figures (documents, terms, documents a term) are Spark aggregates of all rows. A task
then reads its documents as shards and sorts a shard's occurrences by term and impact. For every item the
lists of its terms are read in step, a block of each at a time, in blocks that double: what was read of a
document is the lower end of its score, and for each list in which it was not met yet the impact that this
list has reached is added for the upper end. Reading goes on until no unread document can enter and every
document that still can has a closed interval, so members, ties and scores are final. The task's tenth score
so far rules out documents of its next shards; the tasks' lists of ten are merged.

Items are searched in blocks of about ``ITEM_BYTES`` of text, so what a task is given stays bounded whatever
the number of items (one item's text is never cut). Each item row is ranked by itself, also if item_ids
repeat or are null. A null text has no terms. Rows of documents are documents each, also if doc_ids repeat;
equal scores go by ascending doc_id, a null doc_id last. An item without terms, or without a document that
scores above 0, has no rows.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rasterlab.llm.common import BATCH_ROWS, pick, stash

BEST = 10
ITEM_BYTES = 8 << 20
SHARD_DOCS = 16_384
SHARD_POSTINGS = 4 << 20  # a shard ends at either
STEP = 256                # first block of a list
SALT = 64                 # parts that an item's candidates are merged in first
_KEPT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and bytes of other characters."""
    return (text or b"").translate(_KEPT).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impact(tf, n, documents: int, length: int):
    """The share of an occurrence count in the score, by 64-bit integers."""
    m = 100 - 90 + (90 * n * documents) // max(length, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def occurrences(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the document), term and tf (arrays of the searched terms it holds)."""
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, BATCH_ROWS):
                part = b.slice(at, BATCH_ROWS)
                n, size, term, tf = [], [], [], []
                for text in part.column(1).to_pylist():
                    words = terms(text)
                    ids, count = np.unique(np.fromiter(filter(None, map(vocabulary.get, words)), np.int32), return_counts=True)
                    n.append(len(words))
                    size.append(len(ids))
                    term.append(ids)
                    tf.append(count)
                cut = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(cut, pa.array(np.concatenate(term).astype(np.int32))),
                     pa.ListArray.from_arrays(cut, pa.array(np.concatenate(tf).astype(np.int64)))], names=["doc_id", "n", "term", "tf"])
    d = pick(docs, doc_id="long", text="string")
    return d.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n long, term array<int>, tf array<long>")


class Shard:
    """Impact-sorted lists of some documents: list ``t`` is ``doc[start[t]:start[t + 1]]``, highest impact first."""

    def __init__(self, docs: np.ndarray, term: np.ndarray, impacts: np.ndarray, n: int, vocabulary: int):
        order = np.argsort((term.astype(np.int64) << 20) + ((1 << 20) - impacts), kind="stable")
        self.n, self.doc, self.impact = n, docs[order], impacts[order]
        self.start = np.searchsorted(term[order], np.arange(vocabulary + 2))

    def search(self, terms_: np.ndarray, weights: np.ndarray, best: list[int], k: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that may enter the ``k`` best, with final scores, and the number of entries read.

        ``best``: final scores of documents of other shards.
        """
        at, end = self.start[terms_].copy(), self.start[terms_ + 1]
        lower, seen = np.zeros(self.n, np.int64), np.zeros((len(terms_), self.n), bool)
        held, alive, read = np.array(best, np.int64), None, 0
        while True:
            for i in np.flatnonzero(at < end):
                stop = min(at[i] + step, end[i])
                d, v = self.doc[at[i]:stop], weights[i] * self.impact[at[i]:stop]
                read += stop - at[i]
                at[i] = stop
                if alive is not None:
                    d, v = d[alive[d]], v[alive[d]]
                lower[d] += v  # a document is once in a list
                seen[i, d] = True
            step *= 2
            more = at < end
            bound = np.where(more, weights * self.impact[np.where(more, at, 0)], 0) if len(self.impact) else np.zeros(len(at), np.int64)
            scores = np.concatenate([held, lower[lower > 0] if alive is None else lower[alive]])
            least = max(1, int(np.partition(scores, -k)[-k])) if len(scores) >= k else 1
            if alive is None:
                if bound.sum() >= least:  # an unread document may still enter
                    continue
                candidates = np.flatnonzero(lower > 0)
            else:
                candidates = np.flatnonzero(alive)
            unseen = bound @ ~seen[:, candidates]
            can = lower[candidates] + unseen >= least
            candidates, unseen = candidates[can], unseen[can]
            if not unseen.any():
                return candidates, lower[candidates], read
            alive = np.zeros(self.n, bool)
            alive[candidates] = True


def _searched(occ: DataFrame, items: list[np.ndarray], weights: np.ndarray, documents: int, length: int, k: int, shard_docs: int) -> DataFrame:
    """item (its place), doc_id, score: the ``k`` best of every task."""
    lists = [t[weights[t] > 0] for t in items]

    def run(batches):
        best: list[list[tuple]] = [[] for _ in lists]  # (-score, no doc_id, doc_id)

        def take(parts):
            ids = [x for p in parts for x in p.column(0).to_pylist()]
            size = np.concatenate([p.column(2).value_lengths().to_numpy() for p in parts])
            term = np.concatenate([p.column(2).flatten().to_numpy() for p in parts])
            tf = np.concatenate([p.column(3).flatten().to_numpy() for p in parts])
            n = np.concatenate([p.column(1).to_numpy() for p in parts])
            doc = np.repeat(np.arange(len(ids), dtype=np.int32), size)
            shard = Shard(doc, term, impact(tf, n[doc], documents, length), len(ids), len(weights) - 1)
            for mine, t in zip(best, lists):
                if len(t):
                    d, s, _ = shard.search(t, weights[t], [-x[0] for x in mine], k)
                    mine.extend((-int(b), ids[a] is None, ids[a] or 0) for a, b in zip(d.tolist(), s))
                    mine.sort()
                    del mine[k:]
        held, rows, entries = [], 0, 0
        for b in batches:
            for at in range(0, b.num_rows, BATCH_ROWS):
                held.append(b.slice(at, BATCH_ROWS))
                rows += held[-1].num_rows
                entries += len(held[-1].column(2).flatten())
                if rows >= shard_docs or entries >= SHARD_POSTINGS:
                    take(held)
                    held, rows, entries = [], 0, 0
        if held:
            take(held)
        out = [(i, None if none else d, -s) for i, mine in enumerate(best) for s, none, d in mine]
        yield pa.RecordBatch.from_pydict({"item": pa.array([x[0] for x in out], pa.int32()), "doc_id": pa.array([x[1] for x in out], pa.int64()),
                                          "score": pa.array([x[2] for x in out], pa.int64())})
    return occ.mapInArrow(run, "item int, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST, shard_docs: int = SHARD_DOCS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: of every item (item_id, text) its ``k`` best documents."""
    q = pick(items, item_id="long", text="string").select("item_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    blocks = max(1, -(-(q.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) // item_bytes))
    out = None
    for block in range(blocks):
        rows = q.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # about item_bytes
        found = _block(docs, [(r.item_id, sorted(set(terms(bytes(r.text))))) for r in rows], k, shard_docs)
        out = found if out is None else out.unionByName(found)
    return out


def _block(docs: DataFrame, items: list[tuple], k: int, shard_docs: int) -> DataFrame:
    spark = docs.sparkSession
    words = sorted({t for _, ts in items for t in ts})
    place = {t: i + 1 for i, t in enumerate(words)}  # 0 stands for no searched term
    occ = stash(occurrences(docs, place))
    total = occ.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("length")).first()
    documents, length = total.documents, total.length or 0
    weights = np.zeros(len(words) + 1, np.int64)
    for r in occ.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # a row a searched term
        weights[r.term] = weight(documents, r["count"])
    lists = [np.array([place[t] for t in ts], np.int64) for _, ts in items]
    found = _searched(occ, lists, weights, documents, length, k, shard_docs)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "item"), F.lit(SALT)))
    few = some.withColumn("at", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("at") <= k).drop("at", "part")
    top = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(items)], "item int, item_id long")
    return top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format('text')}, '{_PATTERN}') AS ts FROM documents),
n AS (SELECT r, doc_id, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS len FROM n),
q AS (SELECT row_number() OVER () AS qr, item_id, list_distinct(regexp_extract_all({_LOWER.format('text')}, '{_PATTERN}')) AS ts FROM benchmark),
qt AS (SELECT qr, item_id, unnest(ts) AS t FROM q),
p AS (SELECT r, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM qt) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), c),
s AS (SELECT p.r, p.t, w.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n.n * c.nd) // c.len))) AS s FROM p JOIN n ON p.r = n.r JOIN w ON p.t = w.t, c),
a AS (SELECT qr, item_id, s.r, sum(s) AS score FROM qt JOIN s ON qt.t = s.t GROUP BY qr, item_id, s.r),
o AS (SELECT item_id, n.doc_id, score, row_number() OVER (PARTITION BY qr ORDER BY score DESC, n.doc_id NULLS LAST) AS rank FROM a JOIN n ON a.r = n.r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM o WHERE rank <= {BEST}
"""
