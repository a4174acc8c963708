"""The full load: snapshot files to published tables."""

import logging
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from flowspark import schemas
from flowspark.functions.ids import transfer_row_id
from flowspark.functions.seasons import window_key
from flowspark.operators import aggregates, merge, numbering, resolve
from flowspark.operators.lookups import with_both_clubs
from flowspark.plans import quality
from flowspark.plans.tables import Tables
from flowspark.session import compiled_methods
from flowspark.sources import contract, seeds
from flowspark.sources.snapshot import ORDINAL, digest_text, multiset_digest, read_snapshot, source_digest
from flowspark.sources.store import PART, Part, TableStore, part_of

logger = logging.getLogger(__name__)

PLAYER_VALUES = ["name", "date_of_birth", "position", "position_group", "nationality", "transfermarkt_url"]
CLUB_VALUES = ["name", "country_id", "current_league_id", "transfermarkt_url"]
TRANSFER_KEY = ["player_id", "transfer_date", "from_club_id", "to_club_id"]
TRANSFER_VALUES = ["fee_eur", "fee_is_loan", "transfer_window", "season"]
VALUATION_KEY = ["player_id", "valuation_date"]
EXTERNAL_KEY = ["transfermarkt_id"]
MERGED_TABLES = ("players", "clubs", "transfers", "player_valuations")


# --- merges ----------------------------------------------------------------------


def number_new(merged: DataFrame, current: DataFrame) -> DataFrame:
    """Give inserted dimension rows the ids after the highest stored one.

    `merged` is read several times (old rows, new rows, their counts by bucket), so stage it.
    """
    last = current.agg(F.coalesce(F.max("id"), F.lit(0).cast("bigint"))).scalar()
    is_new = F.col(merge.CHANGE) == "insert"
    fresh = numbering.dense_ids(merged.filter(is_new).drop("id"), "transfermarkt_id", last)
    return merged.filter(~is_new).unionByName(fresh)


def merge_players(current: DataFrame, raw: DataFrame) -> DataFrame:
    """Upsert by external id; the last row of a stored player wins, else the first. New ids are null."""
    rows = resolve.player_rows(raw, ORDINAL)
    return merge.merge_snapshot(
        current, rows, EXTERNAL_KEY, PLAYER_VALUES, ORDINAL, on_existing="last", details=True
    )


def merge_clubs(current: DataFrame, resolved_clubs: DataFrame) -> DataFrame:
    """Upsert by external id; a stored club keeps its country. New ids are null."""
    return merge.merge_snapshot(
        current, resolved_clubs, EXTERNAL_KEY, CLUB_VALUES, ORDINAL,
        keep=("country_id",), on_existing="last", details=True,
    )


def merge_transfers(current: DataFrame, accepted: DataFrame, first_load: bool = False) -> DataFrame:
    """Upsert by natural key with change detection.

    On a first load there is nothing to differ from, so the cheaper summary will do.
    """
    rows = accepted.select(*TRANSFER_KEY, *TRANSFER_VALUES, ORDINAL)
    stored = current.select(*TRANSFER_KEY, *TRANSFER_VALUES)
    merged = merge.merge_snapshot(
        stored, rows, TRANSFER_KEY, TRANSFER_VALUES, ORDINAL,
        on_existing="last" if first_load else "last_differing", nullable=("transfer_date",), details=True,
    )
    return merged.withColumn(
        "id", transfer_row_id(*[F.col(c) for c in TRANSFER_KEY])
    ).withColumn("window_key", window_key(F.col("transfer_window")))


def merge_valuations(current: DataFrame, accepted: DataFrame, first_load: bool = False) -> DataFrame:
    rows = accepted.select(*VALUATION_KEY, "valuation_eur", ORDINAL)
    return merge.merge_snapshot(
        current, rows, VALUATION_KEY, ["valuation_eur"], ORDINAL,
        on_existing="last" if first_load else "last_differing", details=True,
    )


# --- the job ---------------------------------------------------------------------


@dataclass(frozen=True)
class LoadResult:
    """What a load did; the tables read the published versions."""

    version: str
    records: int
    counts: dict[str, int]
    tables: Tables
    report: DataFrame


def seed(store: TableStore, at: datetime | None = None, countries: DataFrame | None = None,
         leagues: DataFrame | None = None) -> None:
    """Publish the seed dimensions, before the first load."""
    version = _new_version()
    frames = {
        "countries": countries if countries is not None else seeds.seed_countries(store.spark),
        "leagues": leagues if leagues is not None else seeds.seed_leagues(store.spark),
    }
    for table, frame in frames.items():
        store.write(table, version, frame)
    store.publish(dict.fromkeys(frames, version), 0, None, at or _now())


def _new_version() -> str:
    return f"v-{uuid.uuid4().hex}"


def _now() -> datetime:
    return datetime.now(timezone.utc)


@dataclass
class _Load:
    """One running load: its store, snapshot and version, what was published, and what it has counted."""

    store: TableStore
    folder: str
    version: str
    options: dict
    published: dict[str, str]
    before: dict[str, int]  # counts of the published load
    old_sources: dict[str, str]
    sources: dict[str, str]
    counts: dict[str, int]
    inserted: dict[str, int]

    def raw(self, name: str) -> DataFrame:
        return read_snapshot(self.store.spark, self.folder, name, **self.options)

    def same_file(self, *names: str) -> bool:
        """Whether the published load read the same files; never told of quoted line breaks."""
        return all(self.sources.get(n) is not None and self.sources[n] == self.old_sources.get(n) for n in names)

    def settled(self, table: str) -> bool:
        """Whether merging the same snapshot rows again would leave the published table as it is."""
        return table in self.published and all(p.settled for p in self.store.parts(table, self.published[table]))

    def carry(self, *tables: str) -> None:
        """Take tables over as they are, with the counts of the load that told them."""
        for table in tables:
            self.store.carry(table, self.version, self.published[table])
            self.inserted[table] = 0
            self.counts.update({k: n for k, n in self.before.items() if k == table or k.startswith(f"{table}.")})

    def stored(self, table: str, only: list[int] | None = None) -> DataFrame:
        if table not in self.published:
            return self.store.spark.createDataFrame([], schemas.TABLES[table])
        return self.store.read(table, self.published[table], only)

    def mark(self, table: str, parts: list[Part]) -> None:
        self.store.set_parts(table, self.version, parts)


def _begin(store: TableStore, folder: str, version: str, options: dict) -> _Load:
    newest = store.latest().first()
    old = newest.asDict() if newest else {}
    sources = {}
    if not options.get("multi_line"):
        sources = {name: source_digest(store.spark, folder, name) for name in contract.REQUIRED_COLUMNS}
    return _Load(
        store, folder, version, options, store.versions(), old.get("counts") or {}, old.get("sources") or {}, sources, {}, {}
    )


def _dimension(run: _Load, table: str, merged: DataFrame, current: DataFrame) -> None:
    """Stage a merged dimension, number its new rows, write it; the counts are observed on the way."""
    seen = Observation()
    staged = merged.observe(
        seen, F.count("*").alias("rows"), F.sum(merge.ROWS).alias("processed"),
        F.count_if(F.col(merge.CHANGE) == "insert").alias("inserted"), F.count_if(merge.CONFLICT).alias("conflicts"),
    )
    staged = run.store.stage(f"merged_{table}", run.version, staged)
    run.store.write(table, run.version, number_new(staged.drop(merge.OLD, merge.CONFLICT), current))
    told = {k: v or 0 for k, v in seen.get.items()}
    run.mark(table, [replace(p, settled=told["conflicts"] == 0) for p in run.store.parts(table, run.version)])
    run.counts |= {table: told["rows"], f"{table}.processed": told["processed"]}
    run.inserted[table] = told["inserted"]


def _load_dimensions(run: _Load) -> None:
    """Countries, leagues, players and clubs of a snapshot; those whose files are as before are taken over."""
    store, version = run.store, run.version
    if run.same_file("competitions.csv", "clubs.csv") and run.settled("clubs"):
        run.carry("countries", "leagues", "clubs")
    else:
        competitions, club_file = run.raw("competitions.csv"), run.raw("clubs.csv")
        by_competition = resolve.competition_countries(competitions, ORDINAL)
        club_names = resolve.club_rows(club_file, by_competition, ORDINAL)

        stored_countries = run.stored("countries")
        needed = store.stage(
            "needed_countries", version, resolve.needed_countries(competitions, club_names, ORDINAL)
        )
        added = resolve.new_countries(
            store.spark, needed, stored_countries, lambda name, rows: store.stage(name, version, rows)
        )
        countries = store.write("countries", version, stored_countries.unionByName(added))
        leagues = store.write("leagues", version, resolve.match_leagues(run.stored("leagues"), competitions, ORDINAL))
        clubs, current = resolve.club_keys(club_names, countries, leagues), run.stored("clubs")
        _dimension(run, "clubs", merge_clubs(current, clubs), current)

    if run.same_file("players.csv") and run.settled("players"):
        run.carry("players")
    else:
        current = run.stored("players")
        _dimension(run, "players", merge_players(current, run.raw("players.csv")), current)


def stage_counted(
    stage: Callable[[str, DataFrame], DataFrame], table: str, resolved: DataFrame, outcomes: tuple[str, ...]
) -> tuple[DataFrame, dict[str, int]]:
    """Stage resolved rows, without their raw ids, and observe how many have each outcome."""
    rows = resolved.drop(*[c for c in resolved.columns if c.startswith("raw_")])
    seen = Observation()
    with compiled_methods(resolved.sparkSession):
        staged = stage(table, rows.observe(seen, *resolve.outcome_metrics(rows.columns, outcomes)))
    told = seen.get
    if sum(told[o] for o in outcomes) != told["rows"]:
        raise RuntimeError(f"{table}: rows with an unknown outcome")
    return staged, {o: told[o] for o in outcomes if told[o]}


def _resolved(run: _Load, table: str, resolved: DataFrame, outcomes: tuple[str, ...]) -> DataFrame:
    staged, told = stage_counted(lambda name, rows: run.store.stage(name, run.version, rows), table, resolved, outcomes)
    run.counts |= {f"{table}.{o}": n for o, n in told.items()}
    run.counts[f"{table}.processed"] = sum(n for o, n in told.items() if o.startswith("accepted"))
    return staged


def part_digests(accepted: DataFrame, table: str, columns: list[str]) -> dict[int, str]:
    """A digest of the accepted rows of each part; there is a part for a market period or a year."""
    rows = accepted.select(part_of(table).alias(PART), *columns).groupBy(PART).agg(*multiset_digest(columns))
    return {row[PART]: digest_text(row) for row in rows.collect()}


def _merge_parts(
    run: _Load, table: str, accepted: DataFrame, columns: list[str], merge_rows: Callable[[DataFrame, DataFrame, bool], DataFrame]
) -> None:
    """Merge and write the parts whose rows differ from those that were merged last; the others are taken over.

    A part is also merged again where the snapshot's rows of one key differ: the rule then
    depends on what is stored.
    """
    digests = part_digests(accepted, table, columns)
    known = {p.part: p for p in run.store.parts(table, run.published[table])} if table in run.published else {}
    touched = sorted(
        part for part, digest in digests.items()
        if part not in known or not known[part].settled or known[part].digest != digest
    )
    parts = {part: replace(p, present=part in digests) for part, p in known.items() if part not in touched}
    run.counts[table], run.inserted[table] = run.before.get(table, 0), 0
    if touched:
        rows = accepted if len(touched) == len(digests) else accepted.filter(part_of(table).isin(touched))
        merged = merge_rows(run.stored(table, touched), rows, not any(t in known for t in touched))
        seen = Observation()
        metrics = [
            F.count_if(F.col(merge.CHANGE) == "insert").alias("inserted"),
            F.collect_set(F.when(F.col(merge.CONFLICT), F.col(PART))).alias("conflicts"),
        ]
        run.store.write(table, run.version, merged, seen, metrics)
        told = seen.get
        unsettled = set(told["conflicts"])
        parts |= {
            p.part: replace(p, digest=digests.get(p.part), settled=p.part not in unsettled)
            for p in run.store.parts(table, run.version)
        }
        run.inserted[table] = told["inserted"]
        run.counts[table] += told["inserted"]
    run.mark(table, [parts[k] for k in sorted(parts)])


def _load_facts(run: _Load) -> None:
    """Transfers and valuations, on the dimensions of the same version."""
    players, clubs = run.store.read("players", run.version), run.store.read("clubs", run.version)
    same_players, same_clubs = run.inserted["players"] == 0, run.inserted["clubs"] == 0

    if run.same_file("transfers.csv") and same_players and same_clubs and run.settled("transfers"):
        run.carry("transfers")
    else:
        typed = resolve.transfer_rows(run.raw("transfers.csv"), ORDINAL)
        resolved = resolve.resolve_transfers(typed, players, clubs, ORDINAL)
        resolved = _resolved(run, "transfers", resolved, resolve.TRANSFER_OUTCOMES)

        def merged(stored: DataFrame, rows: DataFrame, first_load: bool) -> DataFrame:
            return with_both_clubs(merge_transfers(stored, rows, first_load), clubs, "country_id")

        _merge_parts(run, "transfers", resolve.accepted(resolved), [*TRANSFER_KEY, *TRANSFER_VALUES], merged)

    if run.same_file("player_valuations.csv") and same_players and run.settled("player_valuations"):
        run.carry("player_valuations")
    else:
        typed = resolve.valuation_rows(run.raw("player_valuations.csv"), ORDINAL)
        resolved = resolve.resolve_valuations(typed, players, ORDINAL)
        resolved = _resolved(run, "player_valuations", resolved, resolve.VALUATION_OUTCOMES)
        _merge_parts(run, "player_valuations", resolve.accepted(resolved), [*VALUATION_KEY, "valuation_eur"], merge_valuations)


# --- aggregates ------------------------------------------------------------------

AGGREGATES = {
    "country_transfer_flows": (aggregates.FLOW_MEASURES, aggregates.FLOW_COUNTS),
    "club_transfer_summaries": (aggregates.CLUB_MEASURES, aggregates.CLUB_COUNTS),
}


def _count_parts(windows: list[int]) -> list[Column]:
    """Rows of each window, as aggregates; a window is a market period."""
    return [F.count_if(F.col(PART) == w).alias(f"rows_{w}") for w in windows]


def _update_aggregates(run: _Load) -> None:
    """Apply the load's changes to both aggregates: replaced values are taken off, new ones added.

    Reads the changed transfers and the stored sums of their windows, and writes those windows.
    """
    store, version = run.store, run.version
    if not store.written("transfers", version) and all(t in run.published for t in AGGREGATES):
        run.carry(*AGGREGATES)
        return
    signed = aggregates.signed_changes(store.changes("transfers", version))
    deltas = {
        "country_transfer_flows": aggregates.flow_deltas(signed, store.read("clubs", version)),
        "club_transfer_summaries": aggregates.club_deltas(signed),
    }
    for table, (measures, counts) in AGGREGATES.items():
        delta = store.stage(f"delta_{table}", version, deltas[table])
        windows = sorted(r[PART] for r in delta.select(part_of(table).alias(PART)).distinct().collect())
        known = {p.part: p for p in store.parts(table, run.published[table])} if table in run.published else {}
        parts = {w: p for w, p in known.items() if w not in windows}
        if windows:
            seen, stored = Observation(), run.stored(table, windows)
            store.write(table, version, aggregates.with_deltas(stored, delta, measures, counts), seen, _count_parts(windows))
            rows = seen.get
            parts |= {p.part: replace(p, row_count=rows[f"rows_{p.part}"], settled=True) for p in store.parts(table, version)}
        run.mark(table, [parts[w] for w in sorted(parts)])
        run.counts[table] = sum(p.row_count or 0 for p in parts.values())
        logger.info("%s: %d windows written, %d rows", table, len(windows), run.counts[table])


def rebuild_aggregates(store: TableStore, source: str, version: str) -> dict[str, int]:
    """Build both aggregates anew from one version of the facts; returns their row counts."""
    transfers, clubs = store.read("transfers", source), store.read("clubs", source)
    frames = {
        "country_transfer_flows": aggregates.country_flows_by_window(transfers, clubs),
        "club_transfer_summaries": aggregates.club_summaries_by_window(transfers),
    }
    counts = {}
    for table, frame in frames.items():
        seen = Observation()
        store.write(table, version, frame, seen, [F.count("*").alias("rows")])
        counts[table] = seen.get["rows"]
        logger.info("%s rebuilt: %d rows", table, counts[table])
    return counts


def current_tables(store: TableStore) -> Tables:
    """The published tables; all come from the same log row."""
    versions = store.versions()
    frames = {
        name: store.read(name, versions[name])
        if name in versions
        else store.spark.createDataFrame([], schemas.TABLES[name])
        for name in schemas.TABLES
    }
    return Tables(**frames)


def run_load(
    store: TableStore,
    folder: str,
    source_version: str | None = None,
    at: datetime | None = None,
    **read_options,
) -> LoadResult:
    """Load one snapshot folder in dependency order and publish all tables at once.

    Work follows what changed: a file like the published load's is not parsed again, a
    period whose rows are as before is neither merged nor written, and aggregates take up
    the changed transfers only. An unchanged snapshot writes no table.

    Quality checks run on the published tables and are returned, never raised.
    """
    at = at or _now()
    version = _new_version()
    based_on = store.sequence()
    run = _begin(store, folder, version, read_options)
    _load_dimensions(run)
    _load_facts(run)
    _update_aggregates(run)

    records = sum(run.counts[f"{table}.processed"] for table in MERGED_TABLES)
    store.publish(
        dict.fromkeys(schemas.TABLES, version), records, source_version, at, based_on, run.counts, run.sources
    )
    tables = current_tables(store)
    report = quality.quality_report(tables, at.date())
    logger.info("Load %s published: %d records", version, records)
    return LoadResult(version, records, run.counts, tables, report)


def log_report(report: DataFrame) -> None:
    """Log the summary and every failed check; a report has 13 rows."""
    totals = quality.summary(report).first()
    logger.info(
        "Quality: %d of %d passed, %d errors, %d warnings",
        totals["passed"], totals["total"], totals["errors"], totals["warnings"],
    )
    for row in report.filter(~F.col("passed")).collect():
        level = logging.ERROR if row["severity"] == "error" else logging.WARNING
        logger.log(level, "%s: %s", row["name"], row["message"])
