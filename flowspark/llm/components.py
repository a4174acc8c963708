"""Connected components of an edge table, by repeated contraction in Spark.

Each round every node hooks onto the neighbour (or itself) with the smallest hash; edges
are rewritten to the hooked nodes, loops and repeats vanish. The hash order makes the
number of live nodes fall by a constant factor a round, also on long chains and stars.
Nothing of the graph reaches the driver but whether edges are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, release


def _undirected(edges: DataFrame) -> DataFrame:
    """One row for each pair of different nodes."""
    pair = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pair.distinct()


def _rank(node: str) -> F.Column:
    return F.struct(F.xxhash64(node).alias("h"), F.col(node).alias("n"))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (node, root): a root for every node that has an edge to another node.

    Edges with a null end and loops are left out. Which node is the root is fixed by the
    hash order, so reruns agree; take a minimum over members for a name of your own.
    """
    live = keep(_undirected(edges))
    maps: list[DataFrame] = []
    while not live.isEmpty():
        both = live.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            live.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        nearest = both.groupBy("node").agg(F.min(_rank("other")).alias("low"))
        hooked = keep(nearest.select("node", F.least(_rank("node"), "low")["n"].alias("root")))
        maps.append(hooked)
        left, right = hooked.toDF("a", "root_a"), hooked.toDF("b", "root_b")
        moved = live.join(left, "a").join(right, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        live, done = keep(_undirected(moved)), live
        release(done)
    release(live)
    if not maps:
        kind = dict(edges.dtypes)["a"]
        return edges.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
    labels = maps[-1]
    for hooked in reversed(maps[:-1]):
        last = labels.select(F.col("node").alias("root"), F.col("root").alias("last"))
        labels, done = keep(hooked.join(last, "root", "left").select("node", F.coalesce("last", "root").alias("root"))), labels
        release(done, hooked)
    return labels
