"""Versioned Parquet tables with one publish log.

A load writes what it changes into its own folders, checks their unique keys, and then
appends one row to the publish log. Readers resolve table folders through the newest log
row, so they see all tables of a load or none; a load that dies earlier leaves only
unreferenced folders. The log row also is the load record: time, rows processed, source
version, counts.

Facts and aggregates are kept in parts, one for each market period (valuations: year). A
part is told by the key of a row, so a key never moves between parts. A version of a table
is a list of parts, its manifest: those that the load wrote, and those of earlier loads
that it left as they were. Only touched parts are ever written.
"""

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark import schemas
from flowspark.functions import seasons
from flowspark.operators.aggregates import duplicate_keys
from flowspark.operators.merge import CHANGE, OLD, ROWS

LOG_SCHEMA = T.StructType(
    [
        T.StructField("sequence", T.LongType()),
        T.StructField("last_ingestion_at", T.TimestampType()),
        T.StructField("records_processed", T.LongType()),
        T.StructField("source_commit_hash", T.StringType()),
        T.StructField("versions", T.MapType(T.StringType(), T.StringType())),
        T.StructField("counts", T.MapType(T.StringType(), T.LongType())),
        T.StructField("sources", T.MapType(T.StringType(), T.StringType())),
    ]
)

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("folder", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("settled", T.BooleanType()),
        T.StructField("present", T.BooleanType()),
        T.StructField("row_count", T.LongType()),
    ]
)

PART = "_part"
_NEAR = "_near"
#: Part of a row, by its key columns alone. Tables that are not named here are one part.
_PARTS: dict[str, Callable[[], Column]] = {
    "transfers": lambda: seasons.dated_window_key(F.col("transfer_date")),
    "player_valuations": lambda: F.coalesce(F.year("valuation_date"), F.lit(-1)),
    "country_transfer_flows": lambda: F.coalesce("window_key", F.lit(-1)),
    "club_transfer_summaries": lambda: F.coalesce("window_key", F.lit(-1)),
}

# Order of the rows in a file, for row-group skipping on the usual filters.
_SORT = {
    "transfers": ["player_id", "window_key"],
    "player_valuations": ["player_id", "valuation_date"],
    "country_transfer_flows": ["from_country_id", "to_country_id"],
    "club_transfer_summaries": ["club_id"],
}
# Ids of this many neighbouring players share files, so that one player is in few of them.
_NEAR_BITS = 12
# Columns whose row groups carry a Bloom filter, for ids that the sort order does not cluster.
_BLOOM = {"transfers": ["from_club_id", "to_club_id", "player_id"]}


@dataclass(frozen=True)
class Part:
    """One folder of a table version.

    digest tells the snapshot rows that were last merged into it; settled, that merging
    the same rows again changes nothing; present, that the version's snapshot has rows of it.
    """

    table: str
    part: int | None
    folder: str
    digest: str | None = None
    settled: bool = False
    present: bool = True
    row_count: int | None = None


def part_of(table: str) -> Column:
    """The part of a row, as in PART."""
    return _PARTS[table]()


class DuplicateKeyError(RuntimeError):
    """A table version has two rows of one unique key."""


class PublishConflictError(RuntimeError):
    """Another load was published in between."""


class TableStore:
    """Tables under one base folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base.rstrip("/")
        self._unpublished: dict[tuple[str, str], list[Part]] = {}
        self._manifests: dict[str, list[Part]] = {}

    def path(self, table: str, version: str) -> str:
        return f"{self.base}/{table}/{version}"

    def load_log(self) -> DataFrame:
        """All published loads; empty before the first one."""
        log = f"{self.base}/_published"
        file_system, hadoop_path = self._hadoop(log)
        if not file_system.exists(hadoop_path):
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).parquet(log)

    def latest(self) -> DataFrame:
        """The newest load record, or no row."""
        return self.load_log().orderBy(F.col("sequence").desc()).limit(1)

    def versions(self) -> dict[str, str]:
        row = self.latest().first()
        return dict(row["versions"]) if row else {}

    # --- parts -------------------------------------------------------------------

    def parts(self, table: str, version: str) -> list[Part]:
        """The parts of a version: from its manifest, or else as they lie in its folder."""
        if (table, version) in self._unpublished:
            return self._unpublished[table, version]
        named = self._manifest(version)
        if any(p.table == table for p in named):
            return [p for p in named if p.table == table and p.folder]
        return self._listed(table, version)

    def _manifest(self, version: str) -> list[Part]:
        """A manifest has a row for each period of each table, so it is read as a whole."""
        if version not in self._manifests:
            path = f"{self.base}/_manifests/{version}"
            file_system, hadoop_path = self._hadoop(path)
            if not file_system.exists(hadoop_path):
                return []
            rows = self.spark.read.schema(MANIFEST_SCHEMA).parquet(path).collect()
            self._manifests[version] = [Part(*r) for r in rows]
        return self._manifests[version]

    def _listed(self, table: str, version: str) -> list[Part]:
        folder = f"{table}/{version}"
        if table not in _PARTS:
            return [Part(table, None, folder)]
        names = [n for n in self._children(f"{self.base}/{folder}") if n.startswith(f"{PART}=")]
        return [Part(table, int(n.partition("=")[2]), f"{folder}/{n}") for n in sorted(names)]

    def _children(self, path: str) -> dict[str, int]:
        """Names in a folder, with their times of change in milliseconds; none if there is no folder."""
        file_system, hadoop_path = self._hadoop(path)
        if not file_system.exists(hadoop_path):
            return {}
        return {f.getPath().getName(): f.getModificationTime() for f in file_system.listStatus(hadoop_path)}

    def set_parts(self, table: str, version: str, parts: list[Part]) -> None:
        """Name the parts of a version that is not published yet."""
        self._unpublished[table, version] = parts

    def carry(self, table: str, version: str, published: str) -> None:
        """Make a published version's parts those of a new version, unchanged."""
        self.set_parts(table, version, self.parts(table, published))

    def written(self, table: str, version: str) -> list[Part]:
        """The parts that the version itself wrote."""
        return [p for p in self.parts(table, version) if p.folder.startswith(f"{table}/{version}")]

    # --- reading and writing -----------------------------------------------------

    def read(self, table: str, version: str, only: list[int] | None = None) -> DataFrame:
        """One version, or some of its parts, with the schema's columns only."""
        return self._frame(table, [p for p in self.parts(table, version) if only is None or p.part in only])

    def _frame(self, table: str, parts: list[Part], extra: tuple[T.StructField, ...] = ()) -> DataFrame:
        schema = T.StructType([*schemas.TABLES[table].fields, *extra])
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.base}/{p.folder}" for p in parts])

    def read_current(self, table: str) -> DataFrame:
        """The published version; an empty table before the first load."""
        versions = self.versions()
        if table not in versions:
            return self.spark.createDataFrame([], schemas.TABLES[table])
        return self.read(table, versions[table])

    def write(
        self, table: str, version: str, rows: DataFrame, observation: Observation | None = None, metrics: list[Column] = ()
    ) -> DataFrame:
        """Write one version, in parts where the table has them, and read it back.

        Columns beyond the schema (merge outcomes) are stored with the version; PART and
        _conflict are only for `metrics`, which are observed while the rows are written, after
        the last shuffle, so that each row counts once. The read-back cuts the lineage: later
        steps start from files, not from the plan.
        """
        fields = schemas.TABLES[table].fields
        extra = [c for c in rows.columns if c not in [f.name for f in fields]]
        given = {c: F.col(c) for c in rows.columns}
        typed = rows.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields], *extra)
        if table in _PARTS:
            typed = typed.withColumn(PART, part_of(table))
            if "player_id" in typed.columns:
                # Skewed parts are split by the planner; a part's neighbouring players stay together.
                typed = typed.withColumn(_NEAR, F.shiftright("player_id", _NEAR_BITS)).hint("rebalance", PART, _NEAR)
            else:
                typed = typed.hint("rebalance", PART)
            typed = typed.sortWithinPartitions(PART, *_SORT[table])
        if observation is not None:
            typed = typed.observe(observation, *metrics)
        writer = typed.drop(_NEAR, "_conflict").write.mode("errorifexists")
        for column in _BLOOM.get(table, ()):
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        if table in _BLOOM:
            writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
        (writer.partitionBy(PART) if table in _PARTS else writer).parquet(self.path(table, version))
        self.set_parts(table, version, self._listed(table, version))
        return self.read(table, version)

    def stage(self, name: str, version: str, rows: DataFrame) -> DataFrame:
        """Write an intermediate result of a load and read it back.

        Used where several later steps need it: the raw files are parsed once, and a
        lost executor costs a re-read of files, not the whole plan.
        """
        path = f"{self.base}/_staging/{version}/{name}"
        rows.write.mode("errorifexists").parquet(path)
        return self.spark.read.parquet(path)

    def outcomes(self, table: str, version: str) -> DataFrame:
        """A version with its merge outcome columns.

        Of parts that the load carried over the snapshot had the same rows as before, so that
        their keys are unchanged, or kept if it lacked them; or it had none, and all are kept.
        """
        extra = (T.StructField(CHANGE, T.StringType()), T.StructField(ROWS, T.LongType()))
        own = self.written(table, version)
        carried = [p for p in self.parts(table, version) if p not in own]
        same = self._frame(table, [p for p in carried if p.present], extra)
        absent = self._frame(table, [p for p in carried if not p.present], extra)
        still = F.when(F.col(CHANGE) == "kept", F.col(CHANGE)).otherwise("unchanged")
        return (
            self._frame(table, own, extra)
            .unionByName(same.withColumn(CHANGE, still))
            .unionByName(absent.withColumns({CHANGE: F.lit("kept"), ROWS: F.lit(0).cast("bigint")}))
        )

    def changes(self, table: str, version: str) -> DataFrame:
        """Rows that the version inserted or updated, with the values that updates replaced (_old).

        Only parts that the version wrote are read.
        """
        old = T.StructType([f for f in schemas.TABLES[table].fields if f.name in ("fee_eur", "fee_is_loan", "transfer_window", "season")])
        extra = (T.StructField(CHANGE, T.StringType()), T.StructField(OLD, old))
        return self._frame(table, self.written(table, version), extra).filter(F.col(CHANGE).isin("insert", "update"))

    def check_unique(self, versions: dict[str, str]) -> None:
        """Raise if any of the table versions repeats a unique key; one query for all.

        Only what the versions wrote is read: equal keys lie in one part.
        """
        checks = [
            self._repeats(table, version, key).select(
                F.lit(table).alias("table_name"), F.lit(", ".join(key)).alias("key")
            )
            for table, version in versions.items()
            if self.written(table, version)
            for key in schemas.UNIQUE_KEYS[table]
        ]
        if not checks:
            return
        repeated = [f"{r['table_name']} ({r['key']})" for r in reduce(DataFrame.unionByName, checks).collect()]
        if repeated:
            raise DuplicateKeyError(f"repeated keys: {repeated}")

    def _repeats(self, table: str, version: str, key: list[str]) -> DataFrame:
        """One row if the key repeats. A null in a key of one column is no value."""
        rows = self._frame(table, self.written(table, version))
        if len(key) == 1:
            rows = rows.filter(F.col(key[0]).isNotNull())
        return duplicate_keys(rows, key).limit(1)

    def sequence(self) -> int:
        """Number of the newest log row; 0 before the first one."""
        newest = self.latest().first()
        return newest["sequence"] if newest else 0

    def publish(
        self,
        versions: dict[str, str],
        records: int,
        source_version: str | None,
        at: datetime,
        based_on: int | None = None,
        counts: dict[str, int] | None = None,
        sources: dict[str, str] | None = None,
    ) -> None:
        """Check the new versions, then make them current in one step.

        Their manifests are written first. `counts` and `sources` (digests of the snapshot's
        files) stay with the log row.

        `based_on` is the sequence that a load read its stored tables from. If another
        load has published since, or takes the same number now, this one raises and
        leaves the published tables as they are.
        """
        self.check_unique(versions)
        newest = self.latest().first()
        last = newest["sequence"] if newest else 0
        if based_on is not None and based_on != last:
            raise PublishConflictError(f"based on load {based_on}, but {last} is published")
        self._claim(last + 1)
        self._write_manifests(versions)
        everything = {**(newest["versions"] if newest else {}), **versions}
        row = self.spark.createDataFrame(
            [(last + 1, at, records, source_version, everything, counts or {}, sources or {})], LOG_SCHEMA
        )
        row.coalesce(1).write.mode("append").parquet(f"{self.base}/_published")

    def _write_manifests(self, versions: dict[str, str]) -> None:
        """One small file for each version; a table without parts has a row without a folder."""
        for version in sorted(set(versions.values())):
            rows = []
            for table in sorted(t for t, v in versions.items() if v == version):
                parts = self.parts(table, version)
                rows += [(p.table, p.part, p.folder, p.digest, p.settled, p.present, p.row_count) for p in parts]
                rows += [] if parts else [(table, *[None] * 6)]
            manifest = self.spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1)
            manifest.write.mode("overwrite").parquet(f"{self.base}/_manifests/{version}")
        for table, version in versions.items():
            self._unpublished.pop((table, version), None)
            self._manifests.pop(version, None)

    def retain(self, loads: int = 5, older_than: timedelta = timedelta(days=1)) -> list[str]:
        """Delete the folders that none of the newest `loads` log rows names; returns them.

        Folders changed within `older_than` stay, as a load that is still running may be
        writing them. Log rows stay; tables of older ones can no longer be read.
        """
        kept = self.load_log().orderBy(F.col("sequence").desc()).limit(loads).collect()
        versions = {(t, v) for row in kept for t, v in row["versions"].items()}
        named = {p.folder for t, v in versions for p in self.parts(t, v)}
        before = int((datetime.now(timezone.utc) - older_than).timestamp() * 1000)
        gone = []

        def drop(folder: str, changed: int) -> None:
            if changed < before:
                file_system, path = self._hadoop(f"{self.base}/{folder}")
                file_system.delete(path, True)
                gone.append(folder)

        for table in schemas.TABLES:
            for version, changed in self._children(f"{self.base}/{table}").items():
                folder = f"{table}/{version}"
                held = [n for n in named if n == folder or n.startswith(f"{folder}/")]
                if not held:
                    drop(folder, changed)
                elif table in _PARTS:
                    for name, at in self._children(f"{self.base}/{folder}").items():
                        if name.startswith(f"{PART}=") and f"{folder}/{name}" not in named:
                            drop(f"{folder}/{name}", at)
        current = {v for _, v in versions}
        for version, changed in self._children(f"{self.base}/_staging").items():
            drop(f"_staging/{version}", changed)
        for version, changed in self._children(f"{self.base}/_manifests").items():
            if version not in current:
                drop(f"_manifests/{version}", changed)
        return sorted(gone)

    def _claim(self, sequence: int) -> None:
        """Take a sequence number, as a file that only one publisher can create.

        A publisher that dies between its claim and its log row leaves the claim; the
        next load then raises until `release` is called for that number.
        """
        file_system, path = self._hadoop(self._claim_path(sequence))
        if not file_system.createNewFile(path):
            raise PublishConflictError(f"load {sequence} is being published or was left unfinished")

    def release(self, sequence: int) -> None:
        """Give back the claim of a publisher known to be dead."""
        if sequence <= self.sequence():
            raise PublishConflictError(f"load {sequence} is published")
        file_system, path = self._hadoop(self._claim_path(sequence))
        file_system.delete(path, False)

    def _claim_path(self, sequence: int) -> str:
        return f"{self.base}/_claims/{sequence:012d}"

    def _hadoop(self, path: str):
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        return hadoop_path.getFileSystem(conf), hadoop_path


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table name, in one query."""
    counts = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def freshness(latest: DataFrame, as_of: datetime, stale_after_days: int = 45) -> DataFrame:
    """The newest load record with its age; stale when older than the limit."""
    age = F.unix_timestamp(F.lit(as_of)) - F.unix_timestamp("last_ingestion_at")
    days = age / F.lit(86400.0)
    return latest.select(
        "last_ingestion_at",
        "records_processed",
        "source_commit_hash",
        days.alias("age_days"),
        (days > stale_after_days).alias("is_stale"),
    )
