"""A bounded sample of labelled documents, for classifiers that are trained in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_fold(doc_id: Column, parts: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; a null id is in no fold."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == fold, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: dict[int, int], max_bytes: int
) -> DataFrame:
    """(label, text, share): at most per_class rows of each label and about max_bytes of text a label.

    learn: a condition on labels that rows must meet. Rows are taken in the order of a hash
    of their id, whole texts always. share is the label's part of all rows that meet the
    condition. Labels other than those of per_class, null labels and null texts are left out.
    """
    usable = labels.where(learn).select("doc_id", F.col(label).cast("int").alias("label"))
    usable = usable.where(F.col("label").isin(list(per_class)))
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    total = sum(counts.values()) or 1
    chosen = None
    for value, limit in per_class.items():
        rows = usable.where(F.col("label") == value).withColumn("_turn", F.xxhash64("doc_id")).orderBy("_turn", "doc_id").limit(limit)
        rows = rows.withColumn("share", F.lit(counts.get(value, 0) / total))
        chosen = rows if chosen is None else chosen.unionByName(rows)
    found = docs.select("doc_id", "text").where("text is not null").join(chosen, "doc_id")
    upto = Window.partitionBy("label").orderBy("_turn", "doc_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length("text").cast("long")).over(upto), F.lit(0))
    return found.withColumn("_before", before).where(F.col("_before") < max_bytes).select("label", "text", "share")
