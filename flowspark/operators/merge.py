"""Snapshot deduplication and the change-detecting merge.

Neither step sorts or collects the rows of one key: first, last and last-differing
values come from aggregates that combine before the shuffle (or from a two-row
window limit, which Spark also applies before it). A third of a snapshot may be
copies of one key without a slow task.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHANGE = "_change"
ROWS = "_rows"
CONFLICT = "_conflict"
OLD = "_old"
#: Size of the set of bits that marks keys whose rows are read again.
MARK_BITS = 1 << 20


def _pack(columns: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in columns])


def first_per_key(rows: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """The first row of every key in snapshot order."""
    values = [c for c in rows.columns if c not in key and c != ordinal]
    return (
        rows.groupBy(*key)
        .agg(F.min_by(_pack(values), F.col(ordinal)).alias("_first"))
        .select(*key, "_first.*")
    )


def _summarise_last(snapshot: DataFrame, key: list[str], values: list[str], ordinal: str) -> DataFrame:
    """Per key: first and last value, how many rows there were, and whether they differ."""
    return snapshot.groupBy(*key).agg(
        F.min_by(_pack(values), F.col(ordinal)).alias("_first"),
        F.max_by(_pack(values), F.col(ordinal)).alias("_last"),
        F.count("*").alias(ROWS),
        (~F.min(_pack(values)).eqNullSafe(F.max(_pack(values)))).alias(CONFLICT),
    )


def _summarise_differing(
    snapshot: DataFrame, key: list[str], values: list[str], ordinal: str
) -> DataFrame:
    """As above, plus the last value that differs from the last one.

    Those two are enough to find the last value that differs from any stored value:
    it is the last one, unless that equals the stored value, and then the other.

    One shuffle by key gives the first and the last value and the number of rows, which tell
    all of a key of one row, or of two in a known order. The rows of all other keys are read
    again: a set of bits of fixed size says which rows those may be, and decided keys that it
    lets through give the same answer twice.
    """
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in key])
    rows = snapshot.filter(known)
    heads = rows.groupBy(*key).agg(
        F.min_by(_pack(values), F.col(ordinal)).alias("_first"),
        F.max(F.struct(F.col(ordinal).alias("at"), _pack(values).alias("value"))).alias("_newest"),
        F.min(ordinal).alias("_low"),
        F.count("*").alias(ROWS),
    )
    newest, two = F.col("_newest.value"), F.col(ROWS) == 2
    ordered = F.coalesce(F.col("_low") < F.col("_newest.at"), F.lit(False))
    undecided = (F.col(ROWS) > 2) | (two & ~ordered)
    # Reads all of the heads, as the join below does, so that both are planned as one shuffle; no harm if a hash is 0.
    whole = F.xxhash64("_first", "_newest") == 0
    again = rows.filter(_marked(heads.filter(undecided | whole), key))
    tails = _last_two(again, key, values, ordinal)
    before = F.when(two & ordered & ~newest.eqNullSafe(F.col("_first")), F.col("_first"))
    summary = heads.join(tails, key, "left").select(
        *key,
        "_first",
        F.coalesce(F.col("_tail"), F.when(F.col("_newest.at").isNotNull(), newest)).alias("_last"),
        F.coalesce(F.col("_before"), before).alias("_previous"),
        ROWS,
    )
    return summary.withColumn(CONFLICT, F.col("_previous").isNotNull())


def _marked(heads: DataFrame, key: list[str]) -> Column:
    """Whether a row's key may be one of these heads, by a set of MARK_BITS bits, which a subquery makes."""

    def word() -> Column:
        return F.call_function("shiftright", bit, F.lit(6))

    bit = F.pmod(F.xxhash64(*key), F.lit(MARK_BITS))
    place = (bit % 64).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), place)
    none = heads.sparkSession.range(MARK_BITS // 64).select("id", F.lit(0).cast("bigint").alias("bits"))
    words = none.unionByName(heads.select(word().alias("id"), one.alias("bits"))).groupBy("id").agg(F.bit_or("bits").alias("bits"))
    marks = words.agg(F.sort_array(F.collect_list(F.struct("id", "bits")))["bits"].alias("marks")).scalar()
    return F.getbit(F.get(marks, word().cast("int")), place) == 1


def _last_two(rows: DataFrame, key: list[str], values: list[str], ordinal: str) -> DataFrame:
    """The last value of a key in _tail, and the last one that differs from it in _before."""
    distinct = rows.groupBy(*key, *values).agg(F.max(ordinal).alias("_max"))
    newest = Window.partitionBy(*key).orderBy(F.col("_max").desc())
    ranked = distinct.withColumn("_rank", F.row_number().over(newest)).filter("_rank <= 2")
    last, previous = (F.col("_rank") == 1) & F.col("_max").isNotNull(), F.col("_rank") == 2
    return ranked.groupBy(*key).agg(
        F.max(F.when(last, _pack(values))).alias("_tail"), F.max(F.when(previous, _pack(values))).alias("_before")
    )


def _null_flag(column: str) -> str:
    return f"_null_{column}"


def _without_null_keys(df: DataFrame, nullable: tuple[str, ...]) -> DataFrame:
    """Replace nulls of nullable key columns by a flag and a fixed value.

    Groupings and joins then share one plain equality key, and so one shuffle.
    """
    columns = {}
    for name in nullable:
        fixed = "1970-01-01" if isinstance(df.schema[name].dataType, T.DateType) else "0"
        value = F.lit(fixed).cast(df.schema[name].dataType)
        columns[name] = F.coalesce(name, value)
        columns[_null_flag(name)] = F.col(name).isNull()
    return df.withColumns(columns) if columns else df


def merge_snapshot(
    current: DataFrame,
    snapshot: DataFrame,
    key: list[str],
    values: list[str],
    ordinal: str,
    keep: tuple[str, ...] = (),
    on_existing: str = "last_differing",
    nullable: tuple[str, ...] = (),
    details: bool = False,
) -> DataFrame:
    """Merge a snapshot into the current table.

    `nullable` names the key parts that may be null; two nulls are then equal.

    A new key takes its first row. A stored key takes, by `on_existing`, its last
    row ('last') or the last row that differs from the stored values
    ('last_differing'). `keep` are value columns that never change once stored.
    Further columns of `current` (such as ids) are carried and null on new rows.

    Adds _change ('insert', 'update', 'unchanged', or 'kept' for keys the snapshot
    lacks) and _rows, the number of snapshot rows of the key. With `details` also _old,
    the values that an update replaces, and _conflict: the snapshot's rows of the key
    differ, so that merging the same snapshot again may change the key again.
    """
    compared = [v for v in values if v not in keep]
    carried = [c for c in current.columns if c not in key + values]
    full_key = key + [_null_flag(k) for k in nullable]
    current, snapshot = (_without_null_keys(df, nullable) for df in (current, snapshot))
    if on_existing == "last":
        summary = _summarise_last(snapshot, full_key, values, ordinal)
        incoming = F.col("_last")
    elif on_existing == "last_differing":
        summary = _summarise_differing(snapshot, full_key, values, ordinal)
        same_as_stored = F.lit(True)
        for v in compared:
            same_as_stored &= F.col(f"_last.{v}").eqNullSafe(F.col(f"_stored.{v}"))
        previous = F.struct(*[F.col(f"_previous.{v}").alias(v) for v in values])
        incoming = F.when(same_as_stored & F.col("_previous").isNotNull(), previous).otherwise(F.col("_last"))
    else:
        raise ValueError(f"unknown on_existing: {on_existing!r}")

    stored = current.select(*full_key, _pack(values).alias("_stored"), *carried)
    joined = stored.join(summary, full_key, "full_outer").withColumn("_incoming", incoming)

    is_new, is_kept = F.col("_stored").isNull(), F.col("_first").isNull()
    unchanged = F.lit(True)
    for v in compared:
        unchanged &= F.col(f"_incoming.{v}").eqNullSafe(F.col(f"_stored.{v}"))
    change = (
        F.when(is_new, "insert")
        .when(is_kept, "kept")
        .when(unchanged, "unchanged")
        .otherwise("update")
    )

    def value(v: str) -> Column:
        old, new = F.col(f"_stored.{v}"), F.col(f"_incoming.{v}")
        later = old if v in keep else new
        return F.when(is_new, F.col(f"_first.{v}")).when(is_kept, old).otherwise(later).alias(v)

    def key_part(k: str) -> Column:
        return F.when(~F.col(_null_flag(k)), F.col(k)).alias(k) if k in nullable else F.col(k)

    more = [
        F.when(change == "update", F.col("_stored")).alias(OLD),
        F.coalesce(F.col(CONFLICT), F.lit(False)).alias(CONFLICT),
    ]
    return joined.select(
        *carried,
        *[key_part(k) for k in key],
        *[value(v) for v in values],
        change.alias(CHANGE),
        F.coalesce(F.col(ROWS), F.lit(0)).alias(ROWS),
        *(more if details else []),
    )


def change_counts(merged: DataFrame) -> DataFrame:
    """Keys and snapshot rows per outcome."""
    return merged.groupBy(F.col(CHANGE).alias("change")).agg(
        F.count("*").alias("key_count"), F.sum(ROWS).alias("row_count")
    )
