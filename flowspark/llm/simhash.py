"""SimHash near-duplicates with BK-trees over shards of fingerprints.

A fingerprint bit is set where more than half the shingle hashes have it. Fingerprints
within a radius are linked, links are closed to components. To find links without
comparing all pairs, a fingerprint is cut into bands; fingerprints that share a band's
value form a shard. With more bands than the radius two linked fingerprints always share
one (exact). A shard is a BK-tree: the children of a node are keyed by their Hamming
distance to it, and a search follows only edges within the radius of the query's distance.
Trees of many shards are grown and searched together in numpy.

Only distinct fingerprints are searched. A shard's result is one link from each member to
the head of its local group, never all pairs. Shards above SHARD_LIMIT members are cut
into trees of that size, and their members are sent as queries to the other trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import encoded, keep, table
from .components import connected_components

SEED = 42
SHARD_LIMIT = 8192
#: (query, node) pairs that a search step holds at most, about.
STEP = 1 << 20


def shingle_bits(words: list[bytes], shingle: int, bits: int) -> np.ndarray:
    """The fingerprint as bits/8 bytes; zero for no words."""
    if not words:
        return np.zeros(bits // 8, np.uint8)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - shingle + 1)
    start, stop = np.concatenate([[0], ends[: n - 1]]).tolist(), (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(bits, np.int64)
    for at in range(0, n, 1 << 15):
        raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(start[at : at + (1 << 15)], stop[at : at + (1 << 15)], strict=True)])
        first = np.frombuffer(raw, ">u8").astype(np.uint64)
        for k in range(bits // 64):
            h = first if k == 0 else _mixed(first + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15))
            spread = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            counts[64 * k : 64 * k + 64] += spread.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(docs: DataFrame, shingle: int, bits: int) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as binary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = [shingle_bits(encoded(t).lower().split(), shingle, bits).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": fp})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp binary")


class BKForest:
    """BK-trees of several shards, as sorted (node, distance) keys with the child's number."""

    def __init__(self, fp: np.ndarray, shard: np.ndarray):
        """fp: rows of uint64 words. shard: a number for each row; rows of a shard share a tree."""
        self.fp, self.width = fp, 64 * fp.shape[1] + 1
        _, first, of = np.unique(shard, return_index=True, return_inverse=True)
        self.root = first[of]
        waiting = np.setdiff1d(np.arange(len(fp)), first)
        at, keys, children = self.root[waiting], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(waiting):
            key = at * self.width + self.distance(waiting, at)
            level, lead, of = np.unique(key, return_index=True, return_inverse=True)
            keys.append(level)
            children.append(waiting[lead])
            at = waiting[lead][of]
            down = np.ones(len(waiting), bool)
            down[lead] = False
            waiting, at = waiting[down], at[down]
        key, child = np.concatenate(keys), np.concatenate(children)
        order = np.argsort(key)
        self.key, self.child = key[order], child[order]

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.fp[a] ^ self.fp[b]).sum(axis=1, dtype=np.int64)

    def search(self, query: np.ndarray, start: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) within the radius, found from the nodes start downwards."""
        stack = [(query, start)]
        while stack:
            q, node = stack.pop()
            if len(q) > STEP:
                half = len(q) // 2
                stack += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            d = self.distance(q, node)
            near = (d <= radius) & (q != node)
            if near.any():
                yield q[near], node[near]
            low = np.searchsorted(self.key, node * self.width + np.maximum(d - radius, 0))
            high = np.searchsorted(self.key, node * self.width + np.minimum(d + radius, self.width - 1), "right")
            n = high - low
            if total := int(n.sum()):
                place = np.repeat(low - np.cumsum(n) + n, n) + np.arange(total)
                stack.append((np.repeat(q, n), self.child[place]))


def _local_links(fp: np.ndarray, shard: np.ndarray, member: np.ndarray, radius: int) -> np.ndarray:
    """For each row the row that heads its group within the shard."""
    tree = np.flatnonzero(member)
    forest = BKForest(np.concatenate([fp[tree], fp[~member]]), np.concatenate([shard[tree], -1 - np.arange((~member).sum())]))
    rows = np.concatenate([tree, np.flatnonzero(~member)])
    root_of = dict(zip(shard[tree].tolist(), forest.root[: len(tree)].tolist(), strict=True))
    start = np.array([root_of.get(s, -1) for s in shard[rows].tolist()], np.int64)
    query = np.flatnonzero(start >= 0)
    label = np.arange(len(rows))
    for q, node in forest.search(query, start[query], radius):
        pair = np.unique(np.sort(np.stack([label[q], label[node]], 1), axis=1), axis=0)
        pair = pair[pair[:, 0] < pair[:, 1]]
        if len(pair):
            label = _merged(label, pair)
    return rows[label][np.argsort(rows)]


def _merged(label: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    head: dict[int, int] = {}

    def find(x: int) -> int:
        while head.get(x, x) != x:
            head[x] = head.get(head[x], head[x])
            x = head[x]
        return x

    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        if a != b:
            head[max(a, b)] = min(a, b)
    to = np.arange(len(label))
    for x in head:
        to[x] = find(x)
    return to[label]


def search_shards(shards: DataFrame, radius: int) -> DataFrame:
    """shards (shard, tree, member, fp) sorted by (shard, tree) within partitions, to links (a, b)."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        fp = np.frombuffer(b"".join(rows["fp"]), ">u8").astype(np.uint64).reshape(len(rows), -1)
        shard = rows.groupby(["shard", "tree"], sort=False).ngroup().to_numpy()
        head = _local_links(fp, shard, rows["member"].to_numpy(bool), radius)
        linked = head != np.arange(len(rows))
        return pd.DataFrame({"a": rows["fp"][linked], "b": rows["fp"].to_numpy()[head[linked]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = (rows["shard"] == rows["shard"].iloc[-1]) & (rows["tree"] == rows["tree"].iloc[-1])
            if not last.all():  # the last shard may go on in the next batch
                yield links(rows[~last].reset_index(drop=True))
            rest = rows[last].reset_index(drop=True)
        if rest is not None and len(rest):
            yield links(rest)

    return shards.mapInPandas(run, "a binary, b binary")


def near_links(prints: DataFrame, bits: int, radius: int, bands: int, band_bits: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) that share a band's value and lie within the radius."""
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(bits // 8)), lambda i: F.lpad(F.bin(F.conv(F.hex(F.substring(F.col("fp"), i, 1)), 16, 10).cast("long")), 8, "0")), "")
    wide = band_bits * bands > bits  # equal cuts where the bands don't fit otherwise
    cuts = [(bits * i // bands, bits * (i + 1) // bands) if wide else (band_bits * i, band_bits * (i + 1)) for i in range(bands)]
    values = [F.concat(F.lit(f"{i}:"), F.substring("_bits", a + 1, b - a)) for i, (a, b) in enumerate(cuts)]
    # The bits differ between rows, so a band's value is hashed to one long for the shuffle.
    shards = prints.withColumn("_bits", text).select("fp", F.explode(F.array(*[F.xxhash64(v) for v in values])).alias("shard"))
    sizes = shards.groupBy("shard").count().where(F.col("count") > SHARD_LIMIT)
    trees = F.ceil(F.col("count") / SHARD_LIMIT)
    hot = keep(sizes.select("shard", trees.cast("int").alias("trees")))
    placed = shards.join(hot, "shard", "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int"))
    placed = placed.withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("own"))))
    placed = placed.select("shard", "tree", (F.col("tree") == F.col("own")).alias("member"), "fp")
    dealt = placed.repartition("shard", "tree").sortWithinPartitions("shard", "tree")
    return search_shards(dealt, radius)


def simhash_groups(
    docs: DataFrame, *, shingle: int = 4, bits: int = 64, radius: int = 4, bands: int | None = None, band_bits: int | None = None
) -> DataFrame:
    """docs (doc_id, text) to (doc_id, fingerprint, component_id).

    Words are lower-cased (A-Z) and cut at ASCII white space. A null or empty text has
    fingerprint zero and is linked like any other. component_id is the smallest doc_id
    reachable over links; null ids are never the smallest unless there is no other. Without
    bands, radius + 1 equal bands are used, which finds every link. Repeated rows stay.
    """
    if bands is None:
        bands, band_bits = radius + 1, math.ceil(bits / (radius + 1))
    prints = keep(fingerprints(docs, shingle, bits))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = connected_components(near_links(distinct.select("fp"), bits, radius, bands, band_bits)).toDF("fp", "root")
    named = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = keep(named.groupBy("root").agg(F.min("low").alias("component_id")))
    classes = keep(named.join(lows, "root").select("fp", "component_id"))
    return prints.join(classes, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
