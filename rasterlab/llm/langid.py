"""Language identification by averaged hashed subword embeddings with a linear softmax.

The subwords of a text are the one-, two- and three-letter strings of its lower-cased words, with word
ends; each is hashed to one of ``BUCKETS`` embeddings. A text is the average of its subwords' embeddings,
and a linear softmax over that average gives the languages. Embeddings and softmax are trained by
stochastic gradient descent in numpy. A temperature is calibrated on documents that training has not
seen, and so is the rejection: a text is rejected if it has no letter or if its score is below what all
but ``LOST`` of the rightly predicted calibration documents reach.

Only text and lang of rows with ``crc32(doc_id as text) mod 4 <> 2`` are learnt from; of these a sample of
``SAMPLE`` at most (in expectation, chosen by a hash of the text). Null texts and texts without a letter
are ``und`` with score 0, and so is every text if there is nothing to learn from. Scoring reads whole
texts, in chunks.
"""

import functools
import pickle

import numpy as np
from pyspark.sql import DataFrame, functions as F

from rasterlab.llm.common import crc_fold, in_batches, pick

FOLDS, HELD_OUT = 4, 2
SAMPLE = 6000        # labelled documents, at most (in expectation)
BUCKETS = 1 << 14
DIM = 16
EPOCHS = 5
RATE = 2.0
CALIBRATION = 4      # one in so many sampled documents calibrates
LOST = 0.0005        # share of rightly predicted documents that rejection may cost
MARGIN = 0.7         # the threshold is this part of the lowest score that must be kept
UNKNOWN = "und"
CHUNK = 1 << 18      # code points counted at once


@functools.lru_cache(1)
def letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def counts(text: str | None) -> np.ndarray | None:
    """How often each bucket's subwords occur in the whole text; None if it has no letter."""
    if not text:
        return None
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    total, found = np.zeros(BUCKETS, np.int64), False
    for at in range(0, len(cp), CHUNK):
        part = cp[max(0, at - 2):at + CHUNK]
        part = np.where(letter_table()[part], part, 0).astype(np.uint64)
        if at == 0:
            part = np.r_[np.zeros(1, np.uint64), part]
        if at + CHUNK >= len(cp):
            part = np.r_[part, np.zeros(1, np.uint64)]
        a, b, c = part[:-2], part[1:-1], part[2:]
        mid = b > 0
        found |= bool(mid.any())
        a, b, c = a[mid], b[mid], c[mid]
        for h in (b * np.uint64(0x9E3779B97F4A7C15), (a * np.uint64(1 << 21) + b + np.uint64(1 << 60)) * np.uint64(0xC2B2AE3D27D4EB4F),
                  (a * np.uint64(1 << 42) + b * np.uint64(1 << 21) + c + np.uint64(1 << 63)) * np.uint64(0xD6E8FEB86659FD93)):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            total += np.bincount((h >> np.uint64(50)).astype(np.int64), minlength=BUCKETS)
    return total if found else None


class Model:
    """Languages and the product of embeddings and softmax weights (a row for each bucket)."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, threshold: float = 0.0):
        self.langs, self.table, self.bias = langs, table, bias
        self.temperature, self.threshold = temperature, threshold

    def logits(self, c: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(c)
        return (c[at] @ self.table[at]) / c.sum() + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        c = counts(text) if self.langs else None
        if c is None:
            return UNKNOWN, 0.0
        p = softmax(self.logits(c) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], seed: int = 7) -> Model:
    """A model from (bucket numbers, their counts, language) of documents."""
    langs = sorted({lang for _, _, lang in rows})
    if not rows:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    rows = [(at.astype(np.int64), n / n.sum(), langs.index(lang)) for at, n, lang in rows]
    held = rows[::CALIBRATION] if len(rows) >= 20 else rows
    learn = [r for i, r in enumerate(rows) if i % CALIBRATION] if len(rows) >= 20 else rows
    e = rng.normal(0, 0.1, (BUCKETS, DIM))
    w, bias = rng.normal(0, 0.1, (DIM, len(langs))), np.zeros(len(langs))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(learn)):
            at, share, y = learn[i]
            x = share @ e[at]
            g = softmax(x @ w + bias)
            g[y] -= 1
            dx = w @ g
            w -= rate * 0.1 * np.outer(x, g)
            bias -= rate * 0.01 * g
            e[at] -= np.minimum(rate * share * 10, rate)[:, None] * dx
    model = Model(langs, e @ w, bias)
    z = np.array([share @ model.table[at] + bias for at, share, _ in held])
    y = np.array([r[2] for r in held])

    def loss(t):
        return -np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()
    model.temperature = float(min(np.geomspace(0.25, 8, 31), key=loss))
    p = softmax(z / model.temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
    if len(right):
        model.threshold = MARGIN * float(right[int(LOST * len(right))])
    return model


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labelled rows of the learning folds; equal texts of a language count once."""
    d = pick(docs, doc_id="long", text="string", lang="string").where(
        (crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = d.count()
    draw = F.shiftrightunsigned(F.xxhash64("text", F.lit("langid")), 11) / float(1 << 53)
    chosen = d.where(draw < sample / max(n, 1)).select("text", "lang")

    def run(texts, langs):
        out = {"key": [], "at": [], "n": [], "lang": []}
        for t, lang in zip(texts, langs):
            c = counts(t)
            if c is not None:
                at = np.flatnonzero(c)
                for name, v in zip(out, (hash_of(t), at.tolist(), c[at].tolist(), lang)):
                    out[name].append(v)
        return out
    got = in_batches(chosen, run, "key long, at array<int>, n array<long>, lang string").dropDuplicates(["key", "lang"])
    return fit([(np.array(r["at"]), np.array(r["n"], float), r["lang"]) for r in got.orderBy("key", "lang").toLocalIterator()])


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode()) >> 1


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    blob = pickle.dumps(model)

    def run(keys, held, texts):
        m = _model(blob)
        p = [m.predict(t) for t in texts]
        return {"doc_id": keys, "held_out": held, "lang_pred": [x for x, _ in p], "score": [s for _, s in p],
                "rejected": [x == UNKNOWN or s < m.threshold for x, s in p]}
    d = pick(docs, doc_id="long", text="string").select(
        "doc_id", (crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text")
    return in_batches(d, run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


@functools.lru_cache(2)
def _model(blob: bytes) -> Model:
    return pickle.loads(blob)


def without_rejected(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose language the model tells, with all their columns."""
    blob = pickle.dumps(model)

    @F.pandas_udf("boolean")
    def kept(texts):
        m = _model(blob)
        return texts.map(lambda t: (lambda p: p[0] != UNKNOWN and p[1] >= m.threshold)(m.predict(t)))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text").cast("string").alias("text"))
    return d.where(kept("text")).select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
