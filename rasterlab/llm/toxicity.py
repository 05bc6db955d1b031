"""Toxicity by compression distance.

Two zstandard dictionaries are used, one trained on windows of ordinary text, one of toxic words. A text is cut into windows
of whole words; a window's distance is how many bytes shorter it gets when the toxic dictionary may be
used besides the ordinary one. The two compressors share the ordinary content at the same offsets, so
ordinary windows come out alike to the byte and what differs is toxic content. The toxic dictionary is
not trained on whole toxic windows: it is the list of single words that ``telling_words`` picks by the
ratios below (zstandard trains on the list only beyond 8 * ``DICT_BYTES`` bytes of it). So toxicity that
lies in phrases of ordinary words, or in rare words with no telling beginning, gives no distance. Two
dictionaries trained on whole windows did worse on held-out labels; the README has both figures.

Windows are counted from several distances on; a logistic curve, fitted on labelled documents that neither
dictionary has seen, weighs these thresholds and turns a document's counts into a score.

Labels are learnt from rows with ``crc32(doc_id as text) mod 5 <> 0`` only; of these, a sample of
``SAMPLE`` documents at most per class (in expectation, chosen by a hash of the id). Null and empty texts
have no window and get the score of a text without hits. Without labels of both kinds every score is 0.
"""

import functools
import pickle
import zlib
from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import DataFrame, functions as F

from rasterlab.llm.common import crc_fold, in_batches, pick, stash

FOLDS = 5
SAMPLE = 3000        # labelled documents of a class, at most (in expectation)
WINDOW = 64          # bytes of a window, as whole words
LONGEST = 256        # a longer word is cut
DICT_BYTES = 16384   # of each dictionary
CALIBRATION = 3      # one in so many sampled documents is for the thresholds, not for the dictionaries
LETTERS = 4, 5, 6    # first bytes of a word that can be telling
TELLING = 0.01       # share of toxic texts that must hold a word, or its first bytes, to learn it
LEAST = 7            # and so many toxic texts
TIMES = 12           # so many times the share of ordinary texts that hold it
HITS = 1, 2, 3, 4, 6  # distances from which windows are counted; calibration weighs them


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """The whole text, lower-cased, as windows of words that reach ``size`` bytes, joined by spaces."""
    out, held, n = [], [b""], 0
    for w in (text or "").lower().encode().split():
        for at in range(0, len(w), LONGEST):
            part = w[at:at + LONGEST]
            held.append(part)
            n += len(part) + 1
            if n >= size:
                out.append(b" ".join([*held, b""]))
                held, n = [b""], 0
    if n:
        out.append(b" ".join([*held, b""]))
    return out


def _trained(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary trained on samples; few samples are their own dictionary."""
    total = sum(map(len, samples))
    if len(samples) >= 50 and total > 8 * size:
        try:
            d = zstandard.train_dictionary(size, samples, k=64, d=8)
            return d.as_bytes()
        except zstandard.ZstdError:  # too uniform to choose from
            pass
    return b"".join(dict.fromkeys(samples))[-size:]


class Distance:
    """Bytes that the toxic dictionary saves on a window."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.content = toxic, ordinary
        raw = zstandard.DICT_TYPE_RAWCONTENT
        options = dict(level=3, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.plain = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(bytes(len(toxic)) + ordinary, dict_type=raw), **options)
        self.both = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(toxic + ordinary, dict_type=raw), **options)

    def __reduce__(self):
        return Distance, self.content

    def of(self, text: str | None) -> np.ndarray:
        a, b = self.plain.compress, self.both.compress
        return np.array([len(a(w)) - len(b(w)) for w in windows(text)], np.int64)


def features(d: np.ndarray) -> list[float]:
    """Of a document's distances: the largest, then for each of ``HITS`` the windows that reach it, and their share."""
    if not len(d):
        return [0.0] * (1 + 2 * len(HITS))
    out = [min(float(d.max()), 12.0) / 4]
    for least in HITS:
        hits = int((d >= least).sum())
        out += [float(np.log1p(hits)), 10 * hits / len(d)]
    return out


class Model:
    def __init__(self, distance: Distance | None, weights=(0.0,) * (1 + 2 * len(HITS)), bias: float = 0.0):
        self.distance, self.weights, self.bias = distance, np.asarray(weights), bias

    def score(self, text: str | None) -> float:
        if self.distance is None:
            return 0.0
        z = float(np.dot(features(self.distance.of(text)), self.weights)) + self.bias
        return float(1 / (1 + np.exp(-max(-500.0, min(500.0, z)))))


def telling_words(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Words that toxic texts hold ``TIMES`` as often as ordinary ones, rarest first.

    Words that few texts hold count if their first letters are telling.
    """
    def held(texts):
        words, starts = Counter(), Counter()
        for t in texts:
            own = {w.strip(b".,;:!?\"'()") for w in t.lower().encode().split() if len(w) <= LONGEST} - {b""}
            words.update(own)
            starts.update({w[:n] for w in own for n in LETTERS if len(w) >= n})
        return words, starts
    toxic, ordinary = apart(toxic), apart(ordinary)
    (words, t), (plain, o) = held(toxic), held(ordinary)
    share = (len(toxic) + 1) / (len(ordinary) + 1)
    least = max(LEAST, TELLING * len(toxic))
    starts = {s for s, n in t.items() if n >= least and n > 30 * share * (o[s] + 0.25)}
    return sorted((w for w, n in words.items() if n > TIMES * share * plain[w] and (
        any(w[:k] in starts for k in LETTERS) or n >= least and n > TIMES * share * (plain[w] + 0.25))), key=lambda w: (words[w], w))


def apart(texts: list[str]) -> list[str]:
    """Texts less those that mostly repeat earlier ones, so that copies do not make a word look common."""
    seen: set[int] = set()
    out = []
    for t in texts:
        w = t.lower().encode().split()
        own = {h for i in range(max(1, len(w) - 2)) if not (h := zlib.crc32(b" ".join(w[i:i + 3]))) % 8}
        if len(own & seen) <= 0.3 * len(own):
            out.append(t)
        seen |= own
    return out


def fit(toxic: list[str], ordinary: list[str]) -> Model:
    """A model from toxic and ordinary texts; every ``CALIBRATION``-th of each is left for calibration."""
    if len(toxic) < 2 * CALIBRATION or len(ordinary) < 2 * CALIBRATION:
        return Model(None)
    learn = [[t for i, t in enumerate(x) if i % CALIBRATION] for x in (toxic, ordinary)]
    held = [x[::CALIBRATION] for x in (toxic, ordinary)]
    samples = [b" " + w + b" " for w in telling_words(*learn)]
    plain = [w for t in learn[1] for w in windows(t)]
    distance = Distance(_trained(samples, DICT_BYTES) if samples else b"", _trained(plain[:: max(1, len(plain) // 40_000)], DICT_BYTES))
    d = [[distance.of(t) for t in x] for x in held]
    x = np.array([features(v) for part in d for v in part])
    y = np.r_[np.ones(len(d[0])), np.zeros(len(d[1]))]
    return Model(distance, *logistic(x, y))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 50) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton steps."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    pull = np.full(len(w), ridge)
    pull[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pull), a.T @ (y - p) - pull * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labelled rows of the learning folds; an id that is labelled both ways is toxic."""
    own = pick(labels, doc_id="long", toxic="int").where("doc_id is not null and toxic is not null")
    own = own.where(crc_fold(F.col("doc_id"), FOLDS) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in own.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    part = F.when(F.col("toxic") > 0, sample / max(sizes.get(True, 0), 1)).otherwise(sample / max(sizes.get(False, 0), 1))
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("toxicity")), 11) / float(1 << 53)
    chosen = F.broadcast(own.where(draw < part))  # at most about 2 * sample rows
    rows = pick(docs, doc_id="long", text="string").join(chosen, "doc_id").where("text is not null").select("doc_id", "text", "toxic")
    got = rows.dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    return fit([r["text"] for r in got if r["toxic"] > 0], [r["text"] for r in got if r["toxic"] <= 0])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    blob = pickle.dumps(model)

    def run(keys, held, texts):
        m = _model(blob)
        s = [m.score(t) for t in texts]
        return {"doc_id": keys, "held_out": held, "score": s, "predicted": [int(x >= 0.5) for x in s]}
    d = pick(docs, doc_id="long", text="string").select(
        "doc_id", (crc_fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "text")
    return in_batches(d, run, "doc_id long, held_out boolean, score double, predicted int")


@functools.lru_cache(2)
def _model(blob: bytes) -> Model:
    return pickle.loads(blob)


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns."""
    blob = pickle.dumps(model)

    @F.pandas_udf("double")
    def score(texts):
        m = _model(blob)
        return texts.map(m.score)
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text").cast("string").alias("text"))
    return kept.where(score("text") < 0.5).select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
