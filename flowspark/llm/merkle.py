"""Merkle manifest of a table, with proofs by octopus multiproofs.

Rows are leaves. The leaves of a group (a language) stand in key order and make a tree:
every two neighbours become their parent, a lone last one too, until one node is left, the
group's subroot. The subroots, in group order, make one more tree in the same way; its last
node is the root.

Trees grow in tiers. A block of 2**TIER neighbouring nodes makes its own levels in one task
and hands one node to the next tier, so there are as many Spark steps as tiers, and no task
sees more than one block.

A proof of a row is the list of its siblings up to the root. The wanted leaves of a block
ask for them together: `missing` walks up from all of them at once and names the least set
of nodes that cannot be derived from the leaves themselves, the set is fetched in one join,
all shared interior nodes are derived once, and each leaf's own proof is read off them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import crc32_sql, keep, table
from .places import placed

#: Levels that one task makes: a block has at most 1,024 leaves.
TIER = 10
#: Name of the tree over the subroots; those of groups are "" (null) or "=" and the group.
TOP = "top"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Node = tuple[int, int]


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 of the values, each `-` if null, else UTF-8 byte count, a colon and the value."""
    texts = [v.cast("string") for v in values]
    parts = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows as Python objects, one at a time: a row holds a whole block."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)


# --- trees -------------------------------------------------------------------------


@dataclass(frozen=True)
class Manifest:
    """leaves: (tree, place, key, leaf, height, size, ...); nodes: (tree, level, place, digest) of all trees.

    groups: (tree, top_place, top_height, top_size), the place of each group in the top tree.
    """

    leaves: DataFrame
    nodes: DataFrame
    groups: DataFrame
    tier: int

    def root(self) -> DataFrame:
        """(root), one row; none for an empty table."""
        top = self.groups.select("top_height").limit(1)
        nodes = self.nodes.where(F.col("tree") == TOP).join(top, F.col("level") == F.col("top_height"))
        return nodes.select(F.col("digest").alias("root"))


def _with_height(leaves: DataFrame) -> DataFrame:
    """leaves (tree, ...) plus size, the number of leaves of the tree, and height, its levels above the leaves."""
    sizes = leaves.groupBy("tree").agg(F.count("*").alias("size"))
    height = F.when(F.col("size") > 1, F.length(F.bin(F.col("size") - 1))).otherwise(0)
    return leaves.join(sizes.withColumn("height", height), "tree")


def _grow(base: int, tier: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("tree", pa.string()), ("height", pa.int32()), ("level", pa.int32()), ("place", pa.int64()), ("digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            made, at, out = row["digests"], row["block"] << tier, []
            for level in range(base + 1, min(base + tier, row["height"]) + 1):
                made, at = [digest(*made[i : i + 2]) for i in range(0, len(made), 2)], at >> 1
                out += [(row["tree"], row["height"], level, at + i, d) for i, d in enumerate(made)]
            yield _batch(out, schema)

    return run


def grow(leaves: DataFrame, tier: int) -> DataFrame:
    """leaves (tree, place, digest, height) to all nodes (tree, height, level, place, digest), leaves included."""
    current = leaves.select("tree", F.col("height").cast("int").alias("height"), F.lit(0).alias("level"), "place", "digest")
    nodes, base = current, 0
    while True:
        blocks = current.groupBy("tree", "height", F.shiftright("place", tier).alias("block"))
        packed = blocks.agg(F.array_sort(F.collect_list(F.struct("place", "digest")))["digest"].alias("digests"))
        made = keep(packed.mapInArrow(_grow(base, tier), "tree string, height int, level int, place long, digest string"))
        nodes, base = nodes.unionByName(made), base + tier
        current = made.where((F.col("level") == base) & (F.col("level") < F.col("height")))
        if current.isEmpty():
            return nodes


def manifest(rows: DataFrame, *, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, altered: dict[str, Column] | None = None, tier: int = TIER) -> Manifest:
    """The manifest of rows: leaves are digests of `fields`, in groups, by key.

    altered gives changed values of fields; leaves then also have `changed`, the digest with
    them, null where it is the same. Nulls are values of their own and come first, in
    keys and groups. Rows that share a key stand in order of their digests; equal rows are
    leaves each. Values may be empty or of any length: they are hashed by Spark. An empty table
    has no root. Columns beyond key, group and fields are not read.
    """
    given = [F.col(f) for f in fields]
    others = [(altered or {}).get(f, F.col(f)) for f in fields]
    differs = reduce(Column.__or__, [~old.eqNullSafe(new) for old, new in zip(given, others, strict=True)])
    named = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"),
        F.col(key).alias("key"),
        leaf_digest(given).alias("leaf"),
        F.when(differs, leaf_digest(others)).alias("changed"),
    )
    leaves = keep(_with_height(placed(keep(named), ["tree"], ["key", "leaf"])))
    nodes = grow(leaves.withColumnRenamed("leaf", "digest"), tier)
    subroots = nodes.where(F.col("level") == F.col("height")).select("tree", "digest")
    tops = placed(keep(subroots), [], ["tree"]).withColumnRenamed("tree", "group")
    tops = keep(_with_height(tops.withColumn("tree", F.lit(TOP))))
    groups = tops.select(F.col("group").alias("tree"), *[F.col(c).alias(f"top_{c}") for c in ("place", "height", "size")])
    every = nodes.drop("height").unionByName(grow(tops, tier).drop("height"))
    return Manifest(leaves, every, groups, tier)


# --- proofs ------------------------------------------------------------------------


def missing(places: list[int], height: int, size: int) -> list[Node]:
    """The least set of nodes (level, place) that, with these leaves, gives the top of a tree of `size` leaves."""
    known, found = np.unique(np.array(places, np.int64)), []
    for level in range(height):
        siblings = np.setdiff1d(known ^ 1, known, assume_unique=True)
        found += [(level, int(p)) for p in siblings if p < -(-size >> level)]
        known = np.unique(known >> 1)
    return found


def derive(known: dict[Node, str], places: list[int], height: int, size: int) -> None:
    """Adds to known all nodes over the leaves at these places."""
    live = sorted(set(places))
    for level in range(height):
        live = sorted({p >> 1 for p in live})
        for p in live:
            pair = [known[level, c] for c in (2 * p, 2 * p + 1) if c < -(-size >> level)]
            known[level + 1, p] = digest(*pair)


def siblings(known: dict[Node, str], place: int, height: int, size: int) -> list[str]:
    """The proof of one leaf inside its tree: a digest for each level, empty where the node is alone."""
    return ["" if place >> level ^ 1 >= -(-size >> level) else known[level, place >> level ^ 1] for level in range(height)]


def fold(leaf: str, place: int, proof: list[str]) -> str:
    """The top of a tree from one leaf and its proof."""
    for level, other in enumerate(proof):
        leaf = digest(other, leaf) if place >> level & 1 else digest(leaf, other)
    return leaf


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of wanted leaves to the coordinates they ask for, tops of both trees included."""
    schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("of", pa.string()), ("level", pa.int32()), ("place", pa.int64())])
    for row in _each(batches):
        own = [*missing(row["places"], row["height"], row["size"]), (row["height"], 0)]
        top = [*missing([row["top_place"]], row["top_height"], row["top_size"]), (row["top_height"], 0)]
        yield _batch([(row["tree"], row["block"], of, *n) for of, nodes in ((row["tree"], own), (TOP, top)) for n in nodes], schema)


def _expanded(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            fetched = {(n["of"] == TOP, n["level"], n["place"]): n["digest"] for n in row["fetched"]}
            own = {(level, place): d for (top, level, place), d in fetched.items() if not top}
            over = {(level, place): d for (top, level, place), d in fetched.items() if top}
            subroot, root = own[row["height"], 0], over[row["top_height"], 0]
            own |= {(0, place): d for place, d in zip(row["places"], row["leaves"], strict=True)}
            derive(own, row["places"], row["height"], row["size"])
            above, out = siblings(over, row["top_place"], row["top_height"], row["top_size"]), []
            for place, key, leaf, changed in zip(row["places"], row["keys"], row["leaves"], row["changed"], strict=True):
                proof = siblings(own, place, row["height"], row["size"])
                folded = fold(fold(changed or leaf, place, proof), row["top_place"], above)
                out.append((row["tree"], place, key, leaf, subroot, root, [*proof, *above], folded))
            yield _batch(out, schema)

    return run


def proofs(made: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """(tree, place, key, leaf, subroot, root, proof, folded) of the wanted leaves (tree, place), or of all.

    proof is an array of digests from the leaf's level up through the subroot to the root,
    empty where a node is alone. folded is the root recomputed from the changed leaf, where
    there is one, else from the leaf, with that proof.
    """
    leaves = made.leaves if wanted is None else made.leaves.join(wanted.select("tree", "place").distinct(), ["tree", "place"], "left_semi")
    by_block = leaves.join(made.groups, "tree").groupBy("tree", "height", "size", "top_place", "top_height", "top_size", F.shiftright("place", made.tier).alias("block"))
    rows = F.array_sort(F.collect_list(F.struct("place", "leaf", "changed", "key")))
    blocks = keep(by_block.agg(rows.alias("_rows")).select("*", F.col("_rows.place").alias("places")))
    # A node is asked for once by a block, so by at most one in 2**tier of the rows under its sibling.
    asked = blocks.drop("_rows").mapInArrow(_asked, "tree string, block long, of string, level int, place long")
    found = asked.join(made.nodes.withColumnRenamed("tree", "of"), ["of", "level", "place"])
    found = found.groupBy("tree", "block").agg(F.collect_list(F.struct("of", "level", "place", "digest")).alias("fetched"))
    packed = blocks.join(found, ["tree", "block"]).select(
        "tree", "height", "size", "top_place", "top_height", "top_size", "places", "fetched",
        F.col("_rows.leaf").alias("leaves"), F.col("_rows.changed").alias("changed"), F.col("_rows.key").alias("keys"),
    )
    kind = made.leaves.schema["key"].dataType.simpleString()
    schema = f"tree string, place long, key {kind}, leaf string, subroot string, root string, proof array<string>, folded string"
    fields = made.leaves.sparkSession.createDataFrame([], schema).schema
    return packed.mapInArrow(_expanded(to_arrow_schema(fields)), schema)


# --- the query ---------------------------------------------------------------------


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the manifest of documents with the proof of each row, some of them tampered with."""
    docs = table(spark, sf_dir, "documents")
    struck = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    more = F.when(struck, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    found = proofs(manifest(docs, altered={"n_chars": more}))
    return found.select(
        F.col("key").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"),
        F.col("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def _enc(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"


ORACLE_SQL = f"""
WITH RECURSIVE told AS (
  SELECT doc_id, lang, source, n_chars, text,
    CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 7 = 0 THEN n_chars::HUGEINT + 1 ELSE n_chars END AS other
  FROM documents),
hashed AS (
  SELECT doc_id, lang, sha256({" || ".join(_enc(f) for f in FIELDS)}) AS leaf,
    sha256({" || ".join(_enc(f if f != "n_chars" else "other") for f in FIELDS)}) AS given
  FROM told),
leafs AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, leaf) AS id,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n
  FROM hashed),
nodes AS (
  SELECT lang, 0 AS level, pos, leaf AS h, n FROM leafs
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2
  FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 2),
subs AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, pos, h, n FROM subs
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2
  FROM tops WHERE n > 1 GROUP BY level, pos // 2),
steps AS (
  SELECT l.id, s.level, l.pos >> s.level AS pos, o.h
  FROM leafs l JOIN nodes s ON s.lang IS NOT DISTINCT FROM l.lang AND s.pos = l.pos >> s.level AND s.n > 1
  LEFT JOIN nodes o ON o.lang IS NOT DISTINCT FROM l.lang AND o.level = s.level AND o.pos = xor(s.pos, 1)
  UNION ALL
  SELECT l.id, 1000 + s.level, g.pos >> s.level, o.h
  FROM leafs l JOIN subs g ON g.lang IS NOT DISTINCT FROM l.lang
  JOIN tops s ON s.pos = g.pos >> s.level AND s.n > 1
  LEFT JOIN tops o ON o.level = s.level AND o.pos = xor(s.pos, 1)),
ways AS (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY level) AS k, pos, h FROM steps),
folds AS (
  SELECT id, 0::BIGINT AS k, given AS h FROM leafs
  UNION ALL
  SELECT f.id, w.k, sha256(CASE WHEN w.pos % 2 = 1 THEN coalesce(w.h, '') || f.h ELSE f.h || coalesce(w.h, '') END)
  FROM folds f JOIN ways w ON w.id = f.id AND w.k = f.k + 1),
ends AS (SELECT id, arg_max(h, k) AS h FROM folds GROUP BY id),
asked AS (SELECT id, sha256(coalesce(string_agg(h, '' ORDER BY k), '')) AS h FROM ways GROUP BY id)
SELECT l.doc_id, l.leaf, g.h AS subroot, r.h AS root, coalesce(a.h, sha256('')) AS proof_sha256,
  e.h AS folded_root, e.h = r.h AS verified
FROM leafs l JOIN subs g ON g.lang IS NOT DISTINCT FROM l.lang
JOIN ends e ON e.id = l.id LEFT JOIN asked a ON a.id = l.id
CROSS JOIN (SELECT h FROM tops WHERE n = 1) r
"""
