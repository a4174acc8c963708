"""Approximate nearest neighbours by inner product with an adaptive dimension scan.

Inner product becomes Euclidean distance by one more dimension: with M the largest norm,
|(q, 0) - (x, sqrt(M^2 - |x|^2))|^2 = |q|^2 + M^2 - 2 q.x. The extended vectors are rotated
at random, so that any first columns estimate the whole distance, and dealt to the lists of
a k-means index. A query scans the lists nearest to it. Within a list, columns come in
blocks: after each block a hypothesis test compares the partial distance, scaled up, with
the distance of the query's neighbour so far, and abandons candidates that would be nearer
only by an unlikely error. The survivors are scored exactly, in double precision, on the
original vectors.

Equal vectors are one candidate with its smallest ids: no more than K + 1 of them can be
among the K nearest of any query. Equal queries are searched once, and each then leaves out
its own row. Lists are cut into cells of bounded size, the queries of a list too, and each
pair of cells is one group of work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, table

K = 20
#: Vectors that train the index at most; every vector is indexed.
SAMPLE = 20_000
#: Bounds of lists, whose number is a fifth of the root of the vectors', and the part of them a query scans.
#: The share suits vectors without structure, whose neighbours lie in many lists.
MOST_LISTS, PROBED, LEAST_PROBED = 65_536, 0.7, 24
#: A share of candidates few enough to be measured one by one.
FEW = 0.03
#: Pairs that a step of a scan holds.
STEP = 1 << 17
#: Rounding of a distance, as a part of the squared lengths.
NEAR = 1e-9
BLOCK, SIGMAS = 16, 2.6
CELL, QUERY_CELL = 8192, 1024


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) without null, zero or non-finite ones; of the most common length only."""
    x = F.col("embedding").cast("array<double>")
    good = F.col("embedding").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.coalesce(good, F.lit(False)) & F.exists(x, lambda v: v != 0)).select("vec_id", x.alias("embedding"))
    rows = rows.where("vec_id is not null")
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (sizes["n"] if sizes else 0))


def distinct_vectors(rows: DataFrame, copies: int) -> DataFrame:
    """(h, embedding, ids): each vector once, with its smallest ids up to a number of copies; h is its hash."""
    first = Window.partitionBy("h", "embedding").orderBy("vec_id")
    few = rows.withColumn("turn", F.dense_rank().over(first)).where(F.col("turn") <= copies)
    return few.groupBy("h", "embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centers = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.concatenate([_nearest(x[i : i + 4096], centers) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centers))
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=len(centers))])
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(axis=1) - 2 * x @ centers.T).argmin(axis=1)


class Index:
    """Rotation and list centers; vectors are extended by the dimension that turns inner products into distances."""

    def __init__(self, longest: float, rotation: np.ndarray, centers: np.ndarray | None = None):
        self.longest, self.rotation, self.centers = longest, rotation, centers

    @classmethod
    def fit(cls, sample: np.ndarray, longest: float, n_lists: int, seed: int = 11) -> Index:
        """Fitted on a bounded sample."""
        rng = np.random.default_rng(seed)
        dims = sample.shape[1] + 1
        index = cls(longest, np.linalg.qr(rng.standard_normal((dims, dims)))[0])
        index.centers = _kmeans(index.extended(sample), min(n_lists, len(sample)), rng)
        return index

    def extended(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, self.longest**2 - (x**2).sum(axis=1)))
        return np.column_stack([x, rest]) @ self.rotation

    def query(self, q: np.ndarray) -> np.ndarray:
        return np.column_stack([q, np.zeros(len(q))]) @ self.rotation


def scan(query: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) of numbers that hold each query's k nearest rows, with few others.

    The k rows that look nearest after the first block are measured in full; the farthest of
    them is what the test of each block compares with, scaled by 1 + SIGMAS / sqrt(columns seen).
    Where all rows are measured to the end, the k-th nearest takes its place.
    """
    dims = rows.shape[1]
    if len(rows) <= k:
        return np.repeat(np.arange(len(query)), len(rows)), np.tile(np.arange(len(rows)), len(query))

    def block(at: int, stop: int) -> np.ndarray:
        a, b = query[:, at:stop], rows[:, at:stop]
        left = np.column_stack([-2 * a, (a**2).sum(axis=1), np.ones(len(a))])
        return left @ np.column_stack([b, np.ones(len(b)), (b**2).sum(axis=1)]).T

    part = block(0, min(BLOCK, dims))
    lead = np.argpartition(part, k - 1, axis=1)[:, :k]
    worst = ((rows[lead] - query[:, None, :]) ** 2).sum(axis=2).max(axis=1)
    # While many candidates are left, a block is measured for all at once; then for the rest only.
    stop = min(BLOCK, dims)
    while True:
        if stop == dims:
            error = NEAR * ((query**2).sum(axis=1) + (rows**2).sum(axis=1).max())
            alive = part <= (np.partition(part, k - 1, axis=1)[:, k - 1] + error)[:, None]
            break
        alive = part <= (worst * (1 + SIGMAS / np.sqrt(stop)) ** 2 * (stop / dims))[:, None]
        if np.count_nonzero(alive) <= FEW * alive.size:
            break
        at, stop = stop, min(stop + BLOCK, dims)
        part += block(at, stop)
    q, x = np.nonzero(alive)
    part = part[q, x]
    while stop < dims:
        at, stop = stop, min(stop + BLOCK, dims)
        part = part + ((rows[x, at:stop] - query[q, at:stop]) ** 2).sum(axis=1)
        bound = worst[q] * ((1 + SIGMAS / np.sqrt(stop)) ** 2 if stop < dims else 1 + 1e-9)
        inside = part * (dims / stop) <= bound
        q, x, part = q[inside], x[inside], part[inside]
    return q, x


def _best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k best entries of each group, by score and then id."""
    order = np.lexsort((ids, -score, group))
    start = np.flatnonzero(np.diff(group[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(start, np.diff(start, append=len(order)))
    return order[rank < k]


def nearest_neighbours(vectors: DataFrame, queries: F.Column, *, k: int = K) -> DataFrame:
    """vectors (vec_id, embedding) to (query_id, rank, vec_id, score), k rows a query, nearest first.

    queries: which rows are queries. A query's own row is no candidate, nor is another row
    of its id; rows that repeat id and vector count once. Ties go to the smaller vec_id.
    Vectors that take no part (null, zero, non-finite, of another length than most) are
    neither queries nor candidates. With k or fewer candidates all are returned.
    """
    spark = vectors.sparkSession
    rows = keep(usable_vectors(vectors).withColumn("h", F.xxhash64("embedding")))
    classes = keep(distinct_vectors(rows, k + 1))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v))
    stat = classes.agg(F.count("*").alias("n"), F.max(norm).alias("longest")).first()
    out = "query_id long, rank int, vec_id long, score double"
    if not stat["n"]:
        return spark.createDataFrame([], out)
    sample = classes.orderBy(F.xxhash64("embedding")).limit(SAMPLE).select("embedding").toPandas()
    n_lists = int(min(MOST_LISTS, max(1, round(stat["n"] ** 0.5 / 5)), max(1, len(sample) // 16)))
    index = Index.fit(np.array(sample["embedding"].tolist(), np.float64), stat["longest"], n_lists)
    given = spark.sparkContext.broadcast((index.longest, index.rotation, index.centers))
    n_lists = len(index.centers)
    probes = min(n_lists, max(LEAST_PROBED, int(n_lists * PROBED)))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(*given.value)
        for batch in batches:
            x = index.extended(np.array(batch["embedding"].tolist(), np.float64).reshape(len(batch), -1))
            yield pd.DataFrame({"list": _nearest(x, index.centers), "ids": batch["ids"], "embedding": batch["embedding"]})

    listed = keep(classes.mapInPandas(assign, "list int, ids array<long>, embedding array<double>"))
    # One row for each list; lists are at most MOST_LISTS.
    sizes = dict(listed.groupBy("list").agg(F.sum(F.size("ids"))).collect())
    held = spark.sparkContext.broadcast(np.array([sizes.get(i, 0) for i in range(n_lists)]))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, size = Index(*given.value), held.value
        for batch in batches:
            q = index.query(np.array(batch["embedding"].tolist(), np.float64).reshape(len(batch), -1))
            for at in range(0, len(q), 512):
                d = (index.centers**2).sum(axis=1) - 2 * q[at : at + 512] @ index.centers.T
                order = np.argsort(d, axis=1, kind="stable")
                # Lists are added until they hold enough candidates besides the query's own row.
                enough = (np.cumsum(size[order], axis=1) - size[order]) < k + 1
                enough[:, :probes] = True
                which, rank = np.nonzero(enough)
                piece = batch.iloc[at : at + 512].iloc[which]
                yield pd.DataFrame({"list": order[which, rank], "query_id": piece["query_id"].to_numpy(), "query": piece["embedding"].to_numpy()})

    # A query vector is named by the smallest id of its class; copies meet their result at the end.
    named = rows.where(queries).join(classes.select("h", "embedding", F.col("ids")[0].alias("class")), ["h", "embedding"])
    named = keep(named.select("vec_id", "class").distinct())
    wanted = named.select("class").distinct()
    asked = classes.select(F.col("ids")[0].alias("class"), "embedding").join(wanted, "class").withColumnRenamed("class", "query_id")
    asked = asked.mapInPandas(choose, "list int, query_id long, query array<double>")
    # Cells: a list's vectors by a hash, as many as its size asks for; every query of the list
    # meets each. Its queries are cut as well, by the load that lists have on average.
    counts = keep(listed.groupBy("list").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells")))
    lots = int(np.ceil(2 * wanted.count() * probes / n_lists / QUERY_CELL)) or 1
    placed = listed.join(counts, "list").withColumn("cell", F.pmod(F.xxhash64("embedding"), F.col("cells")).cast("int"))
    placed = placed.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    asked = asked.withColumn("lot", F.pmod(F.xxhash64("query_id"), F.lit(lots)).cast("int"))
    asked = asked.join(counts, "list").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    placed = placed.select("list", "cell", "lot", "ids", "embedding")
    asked = asked.select("list", "cell", "lot", "query_id", "query")

    def search(found: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        kinds = {"query_id": "int64", "vec_id": "int64", "score": "float64"}
        if not len(found) or not len(ask):
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in kinds.items()})
        index = Index(*given.value)
        x = np.array(found["embedding"].tolist(), np.float64)
        q = np.array(ask["query"].tolist(), np.float64)
        turned, moved, ids = index.extended(x), index.query(q), found["ids"].tolist()
        held = np.fromiter(map(len, ids), np.int64, len(ids))
        flat, first = np.concatenate(ids), np.cumsum(held) - held
        parts, step = [], max(1, STEP // len(x))
        for at in range(0, len(q), step):
            a, b = scan(moved[at : at + step], turned, k + 1)
            score = np.einsum("ij,ij->i", x[b], q[a + at])
            n = held[b]
            a, score = np.repeat(a, n), np.repeat(score, n)
            vec = flat[np.repeat(first[b] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            top = _best(a, score, vec, k + 1)
            parts.append(pd.DataFrame({"query_id": ask["query_id"].to_numpy()[a[top] + at], "vec_id": vec[top], "score": score[top]}))
        return pd.concat(parts, ignore_index=True)

    key = ["list", "cell", "lot"]
    pairs = placed.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(search, "query_id long, vec_id long, score double")
    nearest = [F.desc("score"), F.asc("vec_id")]
    best = Window.partitionBy("query_id").orderBy(*nearest)
    shared = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1).withColumnRenamed("query_id", "class").drop("rank")
    own = named.withColumnRenamed("vec_id", "query_id").join(shared, "class").where("query_id <> vec_id")
    ranked = own.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(vectors, F.pmod(F.col("vec_id"), F.lit(20)) == 0)
