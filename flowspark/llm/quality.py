"""Quality classifier with supervised subword embeddings.

A text is the average of learned vectors: one for each word, each word's character n-grams
and each pair of neighbouring words, all hashed to buckets. A softmax over the average
gives the score. Vectors and softmax are trained by stochastic gradient descent in numpy,
in one task, on a bounded sample of labelled documents. Two marks join the word pairs, as
fixed buckets: a pair of equal words, and a pair seen before in the text, so that
repetition is learned apart from which words repeat. Every text ends with an end mark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import encoded, table, with_text_score
from .labelled import in_fold, labelled_sample

BUCKET_BITS, DIM, GRAMS = 17, 10, (3, 4)
END, SAME, AGAIN = 0, 1, 2
EPOCHS, RATE = 12, 0.6
#: Bound of the training sample: rows of each label, bytes of text of each label.
SAMPLE_ROWS, SAMPLE_BYTES = {0: 2000, 1: 4000}, 12 << 20
ACCEPT = 0.7

_POWERS = np.array([xxhash.xxh64_intdigest(b"quality%d" % i) | 1 for i in range(16)], np.uint64)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.maximum((h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), 3)


def _word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words; buckets of each word itself and of its character n-grams, and whose they are."""
    hashes = np.fromiter(map(_word_hash, words), np.uint64, len(words))
    buffer = np.frombuffer(b"".join([b"<" + w + b">" for w in words]), np.uint8)
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)
    code = (buffer.astype(np.uint64) + np.uint64(1)) * _POWERS[15]
    code ^= code >> np.uint64(31)
    buckets, owners = [_bucket(hashes)], [np.arange(len(words))]
    for n in GRAMS:
        m = len(buffer) - n + 1
        if m > 0:
            h = np.full(m, _POWERS[n], np.uint64)
            for j in range(n):
                h += code[j : j + m] * _POWERS[j]
            inside = owner[:m] == owner[n - 1 :]
            buckets.append(_bucket(h[inside]))
            owners.append(owner[:m][inside])
    return hashes, np.concatenate(buckets), np.concatenate(owners)


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words, with the marks of repetition."""
    a, b = hashes[:-1], hashes[1:]
    h = a * _POWERS[13] + b
    out = _bucket(h)
    if len(h):
        seen = np.ones(len(h), bool)
        seen[np.unique(h, return_index=True)[1]] = False
        out = np.concatenate([out, np.full(int((a == b).sum()), SAME), np.full(int(seen.sum()), AGAIN)])
    return out


def text_buckets(text: object) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their share of all its features."""
    words = encoded(text).split()
    parts = [np.array([END])]
    if words:
        hashes, own, _ = word_features(words)
        parts += [own, pair_buckets(hashes)]
    bucket, n = np.unique(np.concatenate(parts), return_counts=True)
    return bucket.astype(np.int32), (n / n.sum()).astype(np.float32)


def train(rows: pd.DataFrame, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the buckets and the softmax matrix, for rows (label, text, share)."""
    rng = np.random.default_rng(seed)
    rows = rows.sort_values(["label", "text"]).reset_index(drop=True)
    inputs = [text_buckets(t) for t in rows["text"]]
    label = rows["label"].to_numpy()
    drawn = rows.groupby("label")["text"].transform("count").to_numpy() / max(1, len(rows))
    weight = rows["share"].to_numpy() / drawn
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    softmax = np.zeros((2, DIM), np.float32)
    steps, at = EPOCHS * max(1, len(rows)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            bucket, part = inputs[i]
            rate = RATE * (1 - at / steps)
            at += 1
            mean = part @ vectors[bucket]
            wrong = _softmax(softmax @ mean)
            wrong[label[i]] -= 1
            wrong *= rate * min(4.0, weight[i])
            back = wrong @ softmax
            softmax -= np.outer(wrong, mean)
            # The average passes its gradient to each feature undivided, as a sum would.
            vectors[bucket] -= np.outer(np.minimum(1, part * len(part)), back) * 0.05
    return vectors, softmax


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


class Scorer:
    """Scores texts; the summed vectors of words met before are remembered, up to a number of words."""

    LIMIT = 200_000

    def __init__(self, vectors: np.ndarray, softmax: np.ndarray):
        self.vectors, self.softmax = vectors, softmax.astype(np.float64)
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.hash, self.sum = np.empty(0, np.uint64), np.empty((0, DIM + 1), np.float32)

    def _learn(self, words: set[bytes]) -> None:
        new = sorted(words - self.place.keys())
        if not new:
            return
        hashes, bucket, owner = word_features(new)
        order = np.argsort(owner, kind="stable")
        bucket, owner = bucket[order], owner[order]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        sums = np.empty((len(new), DIM + 1), np.float32)
        sums[:, :DIM] = np.add.reduceat(self.vectors[bucket], first, axis=0)
        sums[:, DIM] = np.diff(first, append=len(owner))
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.hash, self.sum = np.concatenate([self.hash, hashes]), np.concatenate([self.sum, sums])

    def score(self, texts: list[object]) -> list[float]:
        split = [encoded(t).split() for t in texts]
        if len(self.place) > self.LIMIT:
            self._clear()
        self._learn({w for words in split for w in words})
        return [self._one(words) for words in split]

    def _one(self, words: list[bytes]) -> float:
        total, n = self.vectors[END].astype(np.float64), 1.0
        if words:
            at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
            own = self.sum[at].sum(axis=0, dtype=np.float64)
            pairs = pair_buckets(self.hash[at])
            total = total + own[:DIM] + self.vectors[pairs].sum(axis=0, dtype=np.float64)
            n += own[DIM] + len(pairs)
        return float(_softmax(self.softmax @ (total / n))[1])


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: F.Column) -> tuple[np.ndarray, np.ndarray]:
    """Trains in one task on the bounded sample; the model has a fixed size."""
    sample = labelled_sample(docs, labels, label, learn, SAMPLE_ROWS, SAMPLE_BYTES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches) or [pd.DataFrame({"label": [], "text": [], "share": []})], ignore_index=True)
        vectors, softmax = train(rows)
        yield pd.DataFrame({"vectors": [vectors.tobytes()], "softmax": [softmax.tobytes()]})

    model = sample.repartition(1).mapInPandas(run, "vectors binary, softmax binary").first()
    if model is None:  # no labelled row at all
        return np.zeros((1 << BUCKET_BITS, DIM), np.float32), np.zeros((2, DIM), np.float32)
    return (
        np.frombuffer(bytes(model["vectors"]), np.float32).reshape(-1, DIM),
        np.frombuffer(bytes(model["softmax"]), np.float32).reshape(2, DIM),
    )


def score_documents(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """docs (text, ...) plus score: the probability of label 1. Null text is scored as empty."""
    given = docs.sparkSession.sparkContext.broadcast(model)
    return with_text_score(docs, lambda: Scorer(*given.value).score)


def classify(docs: DataFrame, labels: DataFrame, *, label: str = "quality", parts: int = 4, fold: int = 2) -> DataFrame:
    """docs (doc_id, text, ...) plus held_out, score, predicted.

    Labels of rows in the fold (crc32 of doc_id modulo parts) are never learned. Repeated
    rows and ties are scored alike; without any label the score is 0.5 throughout. Columns
    of these three names are replaced.
    """
    model = fit(docs, labels, label, ~in_fold(F.col("doc_id"), parts, fold))
    scored = score_documents(docs.drop("held_out", "score", "predicted"), model)
    return scored.withColumn("held_out", in_fold(F.col("doc_id"), parts, fold)).withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def can_learn(docs: DataFrame, labels: DataFrame, *, label: str = "quality", parts: int = 4, fold: int = 2) -> bool:
    """Whether documents outside the fold have labels of both kinds; without them all scores are alike."""
    known = labels.where(~in_fold(F.col("doc_id"), parts, fold)).select("doc_id", F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    return docs.where("text is not null").select("doc_id").join(known, "doc_id").select("label").distinct().count() == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
