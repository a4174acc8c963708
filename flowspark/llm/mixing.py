"""Mixing sources to target weights by capped water-filling. DataFrame functions only.

Targets: all sources share the budget by weight; a source that would pass its cap
(maximum epochs times its size) is clamped there, and the excess goes to the others by
weight until none is above. Each round is one sum over the table of sources; only two
numbers come back. Sampling: every document is taken floor(target / source size) times,
and the rest of the target is filled by whole documents in a seeded order, so that the
words taken end within half a document of the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, table, word_count

#: Documents that share one piece of the seeded order, about; bounds a window's group.
PER_BUCKET = 256


def rank_by_text(values: DataFrame, column: str) -> DataFrame:
    """Adds _rank, from 0, by code point with null last. One row for each value is expected.

    A distributed sort numbers the rows within its partitions; offsets of partitions are
    summed over one row for each partition.
    """
    placed = keep(values.orderBy(F.col(column).asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(starts, "_part").withColumn("_rank", F.col("_start") + within).drop("_at", "_part", "_start")


def water_level(sources: DataFrame, budget: float) -> float:
    """The level v with sum(min(weight * v, cap)) = budget, for sources (weight, cap)."""
    level = 0.0
    while True:
        clamped = F.col("weight") * F.lit(level) > F.col("cap")
        got = sources.agg(
            F.sum(F.when(clamped, F.col("cap")).otherwise(0)).alias("fixed"),
            F.sum(F.when(clamped, 0).otherwise(F.col("weight"))).alias("weights"),
        ).first()
        if not got["weights"]:
            return level
        risen = max(0.0, budget - got["fixed"]) / got["weights"]
        if risen <= level:
            return level
        level = risen


def source_targets(sized: DataFrame, weights: tuple[int, ...], max_epochs: int, share: float = 1.0) -> DataFrame:
    """(source, n_docs, source_size, weight, target): one row for each source, null included."""
    sums = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    ranked = rank_by_text(sums, "source")
    choices = F.array(*[F.lit(w) for w in weights])
    sources = keep(
        ranked.withColumn("weight", F.element_at(choices, (F.col("_rank") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .drop("_rank")
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(sources, total * share)
    target = F.least(F.col("weight") * F.lit(level), F.col("cap").cast("double"))
    return sources.withColumn("target", target).drop("cap")


def mix_sources(
    docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, share: float = 1.0, seed: int = 42
) -> DataFrame:
    """docs (doc_id, source, text, ...) plus size, source_size, target, repeats, taken.

    repeats is how often the mix takes the document, taken its words in all. Null text has
    size 0; a null source is a source of its own, last in order. Rows that repeat are each
    a document. Documents without words get repeats as their source's whole epochs. Columns
    of these five names in docs are replaced; any other column stays. An empty table gives
    an empty one.
    """
    new = ("size", "source_size", "target", "repeats", "taken")
    docs = docs.drop(*new).withColumn("size", word_count(F.col("text")))
    targets = source_targets(docs.select("source", "size"), weights, max_epochs, share)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary"))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    name, gone = F.coalesce("source", F.lit("")), F.col("source").isNull()
    docs = docs.withColumns({"_name": name, "_gone": gone, "_draw": draw})
    targets = targets.withColumns({"_name": name, "_gone": gone}).drop("source")
    pieces = F.greatest(F.lit(1), F.col("n_docs") / PER_BUCKET).cast("long")
    piece = F.floor(F.col("_draw") * pieces / F.lit(float(1 << 32)))
    docs = docs.join(targets, ["_name", "_gone"]).withColumn("_piece", piece)
    key = ["_name", "_gone", "_piece"]
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    docs = docs.withColumn("_whole", whole).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    sums = docs.groupBy(*key).agg(F.sum("size").alias("_words"))
    earlier = Window.partitionBy("_name", "_gone").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_words").over(earlier), F.lit(0))).drop("_words")
    inside = Window.partitionBy(*key).orderBy("_draw", F.col("doc_id").asc_nulls_first(), "size")
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    docs = docs.withColumn("_upto", upto).join(offsets, key)
    middle = 2.0 * (F.col("_offset") + F.col("_upto")) - F.col("size")
    extra = ((F.col("_rest") > 0) & (F.col("size") > 0) & (middle <= 2.0 * F.col("_rest"))).cast("long")
    docs = docs.withColumn("repeats", F.col("_whole") + extra)
    docs = docs.withColumn("taken", F.col("repeats") * F.col("size"))
    return docs.drop("_name", "_gone", "_draw", "_piece", "_whole", "_rest", "_upto", "_offset", "n_docs", "weight")


def repeated_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it is taken, numbered from 1 in epoch."""
    return mixed.where("repeats > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           ('0x' || substr(md5('42' || coalesce(':' || doc_id, '')), 1, 8))::BIGINT AS draw
    FROM documents
), sums AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
    FROM sized GROUP BY source
), filled AS (
    SELECT *, 3 * source_size AS cap,
           sum(3 * source_size) OVER w - 3 * source_size AS cap_before, sum(weight) OVER w - weight AS weight_before,
           sum(weight) OVER () AS all_weight, sum(source_size) OVER () AS budget
    FROM sums WINDOW w AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), levels AS (
    SELECT *, (budget - cap_before)::DOUBLE / (all_weight - weight_before)::DOUBLE AS level FROM filled
), level AS (
    SELECT max(level) FILTER (weight * level <= cap) AS v FROM levels
), targets AS (
    SELECT source, source_size, least(weight * v, cap::DOUBLE) AS target FROM sums, level,
           LATERAL (SELECT 3 * source_size AS cap)
), placed AS (
    SELECT s.*, t.source_size, t.target,
           CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS whole,
           sum(size) OVER (PARTITION BY s.source ORDER BY draw, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN target - whole * source_size > 0 AND size > 0
                             AND 2.0 * upto - size <= 2.0 * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""
