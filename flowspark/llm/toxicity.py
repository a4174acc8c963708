"""Toxicity by compression distance to two zstandard dictionaries.

Both dictionaries hold the same common text; one adds pieces of words that toxic documents
use far more often than ordinary ones, the other as many bytes of further ordinary words.
Each window (a word between blanks) is compressed with both: how many bytes the toxic
dictionary saves is its distance. Each window starts with a run of different bytes that both
dictionaries end their common text with: so a block is always compressed, no saving is lost
to a raw block, and matches are dear to the compressor. A window that shares no GRAM bytes
with the toxic pieces can save nothing worth counting and has distance 0. How many windows
of a document pass each threshold gives a calibrated logistic score.

Dictionaries and calibration are trained in one task on a bounded sample of labelled
documents. Each fold is scored with dictionaries of the other folds; these scores calibrate,
and the size of the dictionaries is the one of DICT_BYTES that calibrates best; sizes above
SURE are tried as long as they gain. The dictionaries in use are then built from all rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import encoded, table, with_text_score
from .labelled import in_fold, labelled_sample

LEVEL = 19
DICT_BYTES = (200, 400, 600, 1000, 2000, 4000, 8000, 16000)
FOLDS, SURE = 2, 1000
COMMON_BYTES, PRIMER = 600, bytes(range(128, 256))
GRAM = 5
#: Lengths in bytes of the word starts that are weighed besides whole words.
STARTS = range(4, 11)
THRESHOLDS = range(1, 10)
SAMPLE_ROWS, SAMPLE_BYTES = {1: 1500, 0: 3000}, 12 << 20
TOXIC = 0.5


class Distance:
    """Bytes that the toxic dictionary saves on a window; known words are remembered up to a number."""

    LIMIT = 500_000

    def __init__(self, toxic: bytes, ordinary: bytes, common: bytes):
        self.toxic, self.ordinary = self._compressor(common + toxic), self._compressor(common + ordinary)
        self.grams = {toxic[i : i + GRAM] for i in range(len(toxic) - GRAM + 1)}
        self.known: dict[bytes, int] = {}

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        how = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, source_size=256, dict_size=len(content), write_content_size=False, write_checksum=False,
            write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=own, compression_params=how)

    def of(self, word: bytes) -> int:
        d = self.known.get(word)
        if d is None:
            if len(self.known) >= self.LIMIT:
                self.known.clear()
            text, d = b" " + word + b" ", 0
            if any(text[i : i + GRAM] in self.grams for i in range(len(text) - GRAM + 1)):
                window = PRIMER + text
                d = len(self.ordinary.compress(window)) - len(self.toxic.compress(window))
            self.known[word] = d
        return d

    def features(self, text: object) -> np.ndarray:
        """For each threshold the windows that pass it, as a logarithm and as a share; the length."""
        words = encoded(text).split()
        d = np.fromiter(map(self.of, words), np.int64, len(words))
        passed = np.array([(d >= k).sum() for k in THRESHOLDS], np.float64)
        return np.concatenate([np.log1p(passed), passed / max(1, len(words)) ** 0.5, [np.log1p(len(words))]])


def _pieces(text: str) -> set[bytes]:
    words = {b" " + w for w in set(encoded(text).split())}
    return {w + b" " for w in words} | {w[:n] for w in words for n in STARTS if len(w) > n}


def _joined(pieces: list[bytes], size: int) -> tuple[bytes, int]:
    """The first pieces up to a size, the best last, where the compressor reaches them cheapest."""
    out: list[bytes] = []
    total = 0
    for p in pieces:
        if total >= size:
            break
        out.append(p)
        total += len(p)
    return b"".join(reversed(out)), len(out)


def toxic_pieces(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Word starts and words by how much more toxic documents have them, without what others contain."""
    with_it: Counter[bytes] = Counter(p for t in toxic for p in _pieces(t))
    without: Counter[bytes] = Counter(p for t in ordinary for p in _pieces(t))

    def weight(p: bytes) -> float:
        a, b = (with_it[p] + 0.5) / (len(toxic) + 1), (without[p] + 0.5) / (len(ordinary) + 1)
        return with_it[p] * math.log(a / b)

    rare = [p for p in with_it if with_it[p] > 1 and without[p] * len(toxic) <= 0.05 * with_it[p] * len(ordinary)]
    ranked = sorted(((-weight(p), p) for p in rare if weight(p) > 0))
    chosen, text = [], b""
    for _, p in ranked:
        if p not in text:
            chosen.append(p)
            text += p
        if len(text) > 2 * max(DICT_BYTES):
            break
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps; the weighted log loss by halves of the rows."""

    def solve(rows: np.ndarray) -> np.ndarray:
        beta, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 2.0)
        ridge[-1] = 1e-3  # the constant
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x[rows] @ beta, -30, 30)))
            slope = x[rows].T @ (weight[rows] * (p - y[rows])) + ridge * beta
            curve = (x[rows].T * (weight[rows] * p * (1 - p) + 1e-9)) @ x[rows] + np.diag(ridge)
            step = np.linalg.solve(curve, slope)
            beta -= step
            if np.abs(step).max() < 1e-6:
                break
        return beta

    every, loss = np.arange(len(y)), 0.0
    for k in (0, 1):
        away = every % 2 == k
        p = np.clip(1 / (1 + np.exp(-np.clip(x[away] @ solve(every[~away]), -30, 30))), 1e-6, 1 - 1e-6)
        loss -= float((weight[away] * (y[away] * np.log(p) + (1 - y[away]) * np.log(1 - p))).sum())
    return solve(every), loss


class Vocabulary:
    """The pieces of dictionaries that some labelled rows give, for any size."""

    def __init__(self, rows: pd.DataFrame):
        toxic, ordinary = rows["text"][rows["label"] == 1].tolist(), rows["text"][rows["label"] == 0].tolist()
        frequent = Counter(b" " + w for t in ordinary for w in encoded(t).split())
        by_use = [w for w, n in sorted(frequent.items(), key=lambda x: (-x[1] * (len(x[0]) - 2), x[0]))]
        common, used = _joined(by_use, COMMON_BYTES)
        self.common, self.rest, self.pieces = common + PRIMER, by_use[used:], toxic_pieces(toxic, ordinary)

    def dictionaries(self, size: int) -> dict[str, bytes]:
        own, _ = _joined(self.pieces, size)
        other, _ = _joined(self.rest, len(own))
        return {"toxic": own, "ordinary": other, "common": self.common}


def train(rows: pd.DataFrame) -> dict[str, object]:
    """The model for rows (label, text, share)."""
    rows = rows.sort_values(["label", "text"]).reset_index(drop=True)
    fold = np.arange(len(rows)) % FOLDS
    parts = [Vocabulary(rows[fold != k]) for k in range(FOLDS)]
    y = rows["label"].to_numpy(np.float64)
    drawn = rows.groupby("label")["text"].transform("count").to_numpy() / max(1, len(rows))
    weight = rows["share"].to_numpy() / drawn
    best: tuple[float, int, np.ndarray] | None = None
    for size in DICT_BYTES:
        x = np.zeros((len(rows), 2 * len(THRESHOLDS) + 1))
        for k, part in enumerate(parts):
            distance = Distance(**part.dictionaries(size))
            for i in np.flatnonzero(fold == k):
                x[i] = distance.features(rows["text"][i])
        center, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        beta, loss = _logistic(np.column_stack([(x - center) / scale, np.ones(len(x))]), y, weight)
        if best is None or loss < best[0]:
            best = loss, size, np.concatenate([beta[:-1] / scale, [beta[-1] - (beta[:-1] * center / scale).sum()]])
        elif size > SURE:
            break
    return {**Vocabulary(rows).dictionaries(best[1]), "line": best[2].tolist()}


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: F.Column) -> dict[str, object] | None:
    """Trains in one task on the bounded sample. None without rows of both labels."""
    sample = labelled_sample(docs, labels, label, learn, SAMPLE_ROWS, SAMPLE_BYTES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        rows = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"label": [], "text": [], "share": []})
        if (rows["label"].value_counts() >= 4).sum() == 2:
            yield pd.DataFrame({k: [v] for k, v in train(rows).items()})

    model = sample.repartition(1).mapInPandas(run, "toxic binary, ordinary binary, common binary, line array<double>").first()
    return model and {**{k: bytes(model[k]) for k in ("toxic", "ordinary", "common")}, "line": list(model["line"])}


def score_documents(docs: DataFrame, model: dict[str, object] | None) -> DataFrame:
    """docs (text, ...) plus score: the probability of label 1, 0.5 without a model. Null text is scored as empty."""
    docs = docs.drop("score")
    if model is None:
        return docs.withColumn("score", F.lit(0.5))
    given = docs.sparkSession.sparkContext.broadcast(model)

    def scorer() -> Callable[[list[object]], list[float]]:
        m = given.value
        distance, line = Distance(m["toxic"], m["ordinary"], m["common"]), np.array(m["line"])
        return lambda texts: [1 / (1 + math.exp(-np.clip(distance.features(t) @ line[:-1] + line[-1], -30, 30))) for t in texts]

    return with_text_score(docs, scorer)


def classify(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", parts: int = 5, fold: int = 0) -> DataFrame:
    """docs (doc_id, text, ...) plus held_out, score, predicted.

    Labels of rows in the fold (crc32 of doc_id modulo parts) are never learned. With fewer
    than four rows of a label the score is 0.5. Columns of these three names are replaced.
    """
    model = fit(docs, labels, label, ~in_fold(F.col("doc_id"), parts, fold))
    scored = score_documents(docs.drop("held_out", "score", "predicted"), model)
    return scored.withColumn("held_out", in_fold(F.col("doc_id"), parts, fold)).withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
