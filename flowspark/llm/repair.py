r"""Conversation structure repair by Knuth's lightest derivations.

A conversation should read `(s?(ua)+)?` by the initials of its roles. Edits keep, re-role or
delete its rows or insert empty ones, each at a cost; wanted is the cheapest sequence of edits
and, of equally cheap ones, the one whose initials are least in ASCII order.

The search is a weighted hypergraph. Items are prefixes (step, state of the role automaton)
and facts of rows; deductions have one or more antecedents, a cost and the letters they add.
`lightest` is Knuth's agenda: the lightest unfinished item by (cost, audit) is final when
popped, since no deduction makes its conclusion lighter than an antecedent. Of derivations
of one item at equal cost none is a proper prefix of another (what is longer costs more), so
adding letters keeps their order.

The sequence is cut into chunks, so that no conversation has to be searched in one task.
A chunk is solved from each state it may be entered in; chunks are then deductions of a
coarser search, in tiers, until one is left for each conversation. Texts take no part until
the end, when they stream past the chosen edits.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_sql, keep, table
from .places import placed

#: Rows that one search takes, and searches that one search of the next tier takes, in bits.
CHUNK_BITS, TIER_BITS = 8, 6
BLANK_CHARS = " \t\n\x0b\x0c\r"
RETYPE, DROP, ADD, CUT_OFF = 1, 2, 5, 5
#: States: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = "0sua"
STATES = (START, SYSTEM, USER, ASSISTANT)
#: The role that an inserted or re-roled row takes in a state, and the state after it.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
ENDS = (START, ASSISTANT)
#: Codes of a row's first fault.
FINE, BLANK, DUPLICATE, TRUNCATED = "kbdt"

Item = tuple[str, int, str]
Weight = tuple[int, str]
#: (state before, state after, cost, letters)
Way = tuple[str, str, int, str]


# --- the search --------------------------------------------------------------------


@dataclass
class Deduction:
    """From all of `needs` follows `gives`; cost and letters are added to the first one's weight."""

    needs: tuple[Item, ...]
    gives: Item
    cost: int
    letters: str


def lightest(axioms: dict[Item, Weight], deductions: list[Deduction], goals: set[Item]) -> dict[Item, Weight]:
    """Knuth's algorithm: final weights of items, in order of weight, until all goals have theirs or none is left.

    A deduction is applied when its last antecedent becomes final. Antecedents after the
    first are facts; their weight is the least there is.
    """
    waiting, left = defaultdict(list), [len(d.needs) for d in deductions]
    for k, d in enumerate(deductions):
        for item in d.needs:
            waiting[item].append(k)
    agenda = [(*weight, item) for item, weight in axioms.items()]
    heapq.heapify(agenda)
    final: dict[Item, Weight] = {}
    open_goals = set(goals)
    while agenda and open_goals:
        cost, audit, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = (cost, audit)
        open_goals.discard(item)
        for k in waiting[item]:
            left[k] -= 1
            if left[k] == 0 and (d := deductions[k]).gives not in final:
                base, letters = final[d.needs[0]]
                heapq.heappush(agenda, (base + d.cost, letters + d.letters, d.gives))
    return final


def _at(step: int, state: str) -> Item:
    return ("at", step, state)


def row_ways(code: str) -> list[Way]:
    """The edits of one row, given its role's initial and its fault."""
    initial, fault = code
    ways = [(q, q, DROP, "D") for q in STATES]
    if fault in (BLANK, DUPLICATE):
        return ways
    more = CUT_OFF if fault == TRUNCATED else 0
    ways += [(q, NEXT[q], RETYPE + more, "R") for q in STATES]
    ways += [(q, NEXT[q], more, "K") for q in STATES if NEXT[q] == initial]
    return [*ways, (START, SYSTEM, more, "K")] if initial == SYSTEM else ways


def best_ways(steps: list[list[Way]], enters: tuple[str, ...], inserts: bool) -> list[Way]:
    """The lightest way through all steps from each state to enter to each state at the end."""
    facts = {("fact", i, ""): (0, "") for i in range(len(steps))}
    deductions = [Deduction((_at(i, q), ("fact", i, "")), _at(i + 1, r), cost, letters) for i, ways in enumerate(steps) for q, r, cost, letters in ways]
    if inserts:
        deductions += [Deduction((_at(i, q),), _at(i, NEXT[q]), ADD, "I") for i in range(len(steps) + 1) for q in STATES]
    ends, found = {_at(len(steps), q) for q in STATES}, []
    for enter in enters:
        final = lightest({**facts, _at(0, enter): (0, "")}, deductions, ends)
        found += [(enter, q, *final[_at(len(steps), q)]) for q in STATES if _at(len(steps), q) in final]
    return found


def chosen(ways: list[Way]) -> Weight:
    """The goal item: the lightest way from the start to a state where a conversation may end."""
    goals = {q: ("goal", 0, "") for q in ENDS}
    deductions = [Deduction((_at(1, q),), goal, 0, "") for q, goal in goals.items()]
    axioms = {_at(1, q): (cost, audit) for enter, q, cost, audit in ways if enter == START}
    return lightest(axioms, deductions, {("goal", 0, "")})["goal", 0, ""]


# --- over Spark --------------------------------------------------------------------

_FIGURES = "blank long, duplicate long, truncated long, illegal long, head string, tail string"
_WAYS = "ways array<struct<enter:string,leave:string,cost:bigint,audit:string>>"
_FIGURE_FIELDS = [*[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")], ("head", pa.string()), ("tail", pa.string())]
_WAY_TYPE = pa.list_(pa.struct([("enter", pa.string()), ("leave", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))


def _legal(first: str, second: str) -> bool:
    return first + second in ("su", "ua", "au")


def _way_structs(ways: list[Way]) -> list[dict]:
    return [dict(zip(("enter", "leave", "cost", "audit"), w, strict=True)) for w in ways]


def _solve_chunk(row: dict) -> dict:
    codes = [row["codes"][i : i + 2] for i in range(0, len(row["codes"]), 2)]
    enters = (START,) if row["chunk"] == 0 else STATES
    initials, faults = row["codes"][::2], row["codes"][1::2]
    return {
        "conv_id": row["conv_id"], "chunk": row["chunk"],
        "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
        "illegal": sum(not _legal(a, b) for a, b in zip(initials, initials[1:])),
        "head": initials[0], "tail": initials[-1],
        "ways": _way_structs(best_ways([row_ways(c) for c in codes], enters, inserts=True)),
    }


def _join_chunks(row: dict) -> dict:
    parts = row["parts"]
    steps = [[(w["enter"], w["leave"], w["cost"], w["audit"]) for w in p["ways"]] for p in parts]
    enters = (START,) if row["chunk"] == 0 else STATES
    return {
        "conv_id": row["conv_id"], "chunk": row["chunk"],
        **{c: sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated")},
        "illegal": sum(p["illegal"] for p in parts) + sum(not _legal(a["tail"], b["head"]) for a, b in zip(parts, parts[1:])),
        "head": parts[0]["head"], "tail": parts[-1]["tail"],
        "ways": _way_structs(best_ways(steps, enters, inserts=False)),
    }


def _mapped(make: Callable[[dict], dict]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("chunk", pa.int64()), *_FIGURE_FIELDS, ("ways", _WAY_TYPE)])
            for start in range(0, batch.num_rows, 64):
                yield pa.RecordBatch.from_pylist([make(r) for r in batch.slice(start, 64).to_pylist()], schema)

    return run


def with_faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) to (conv_id, turn, digest, place, code), without the texts.

    digest tells (role, text) apart; place is the row's number in its conversation; code has
    the role's initial and the first fault that counts.
    """
    last = F.substring(F.rtrim(F.col("text"), F.lit(BLANK_CHARS)), -1, 1)
    light = rows.select(
        "conv_id", "turn", "role", digest_of("role", "text").alias("digest"),
        F.when(last == "", BLANK).when(last.isin(".", "!", "?"), FINE).otherwise(TRUNCATED).alias("fault"),
    )
    light = keep(placed(keep(light), ["conv_id"], ["turn", "role", "digest"]))
    # Copies of one text may be most of a conversation: they are grouped and joined, never gathered.
    firsts = light.groupBy("conv_id", "digest").agg(F.min("place").alias("first")).toDF("_conv", "_digest", "first")
    joined = light.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")))
    fault = F.when(F.col("fault") == BLANK, BLANK).when(F.col("place") > F.col("first"), DUPLICATE).otherwise(F.col("fault"))
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin(SYSTEM, USER, ASSISTANT), initial).otherwise("x")
    return joined.select("conv_id", "turn", "digest", "place", F.concat(known, fault).alias("code"))


def digest_of(role: str, text: str) -> Column:
    """A digest of both, which also orders rows of one turn and role."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), F.col(role), F.col(text)), 256))


def solved(rows: DataFrame, *, chunk_bits: int = CHUNK_BITS, tier_bits: int = TIER_BITS) -> DataFrame:
    """rows of with_faults to one row for each conversation: its faults and its ways, as if one chunk."""
    kind = dict(rows.dtypes)["conv_id"]
    schema = f"conv_id {kind}, chunk long, {_FIGURES}, {_WAYS}"
    by_chunk = rows.groupBy("conv_id", F.shiftright("place", chunk_bits).alias("chunk"))
    coded = by_chunk.agg(F.array_join(F.array_sort(F.collect_list(F.struct("place", "code")))["code"], "").alias("codes"))
    chunks = keep(coded.mapInArrow(_mapped(_solve_chunk), schema))
    while not chunks.where("chunk > 0").isEmpty():
        parts = F.collect_list(F.struct("chunk", *[c for c, _ in _FIGURE_FIELDS], "ways"))
        grouped = chunks.groupBy("conv_id", F.shiftright("chunk", tier_bits).alias("_chunk")).agg(F.sort_array(parts).alias("parts"))
        chunks = keep(grouped.withColumnRenamed("_chunk", "chunk").mapInArrow(_mapped(_join_chunks), schema))
    return chunks


class _Repaired:
    """The digest of one repaired conversation, from its rows in order and its audit."""

    def __init__(self, head: dict):
        self.head, self.at, self.state, self.hash, self.empty = head, 0, START, hashlib.sha256(), True

    def add(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.empty = False

    def insert(self) -> None:
        while self.head["audit"][self.at : self.at + 1] == "I":
            self.state, self.at = NEXT[self.state], self.at + 1
            self.add(ROLE[self.state], "")

    def row(self, role: str, text: str) -> None:
        self.insert()
        edit, self.at = self.head["audit"][self.at], self.at + 1
        if edit == "D":
            return
        self.state = SYSTEM if edit == "K" and role[:1] == SYSTEM else NEXT[self.state]
        self.add(role if edit == "K" else ROLE[self.state], text)

    def done(self) -> dict:
        self.insert()
        return {**self.head, "repaired_sha256": self.hash.hexdigest()}


OUT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _streamed(kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("conv_id", kind), *[(c, pa.int64()) for c in OUT[1:7]], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Repaired | None = None
        for batch in batches:
            done = []
            for start in range(0, batch.num_rows, 64):
                for r in batch.slice(start, 64).to_pylist():
                    if r["found"] is None:
                        now.row(r["role"], r["text"])
                        continue
                    done += [now.done()] if now else []
                    now = _Repaired({"conv_id": r["conv_id"], **r["found"]})
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if now:
            yield pa.RecordBatch.from_pylist([now.done()], schema)

    return run


def _goals(kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("conv_id", kind), *[(c, pa.int64()) for c in OUT[2:7]], ("audit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                cost, audit = chosen([(w["enter"], w["leave"], w["cost"], w["audit"]) for w in r["ways"]])
                out.append({**{c: r[c] for c in ("conv_id", *OUT[2:6])}, "cost": cost, "audit": audit})
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def repair(rows: DataFrame, ids: DataFrame | None = None, *, chunk_bits: int = CHUNK_BITS, tier_bits: int = TIER_BITS) -> DataFrame:
    """The cheapest repair of each conversation of rows (conv_id, turn, role, text).

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256;
    ids (conv_id) adds conversations that have no row. rows must be the same each time they
    are read. Rows stand by turn, nulls first, those of one turn by role and a digest of role
    and text, so equal rows are neighbours; all rows with a null conv_id are one
    conversation. Null roles and texts read as one space. A role whose initial is not s, u or a
    can only be re-roled or deleted. Texts may be empty or of any length; an empty table gives no
    row. Other columns are ignored. The digest of one conversation's text streams through one
    task, in bounded memory.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    arrow = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    rows = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    known = with_faults(rows)
    figures = solved(known, chunk_bits=chunk_bits, tier_bits=tier_bits)
    goal = figures.mapInArrow(_goals(arrow), f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    turns = known.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    every = (rows if ids is None else ids).select(F.col("conv_id").alias("_id")).distinct()
    for part in (turns, goal):
        part = part.withColumnRenamed("conv_id", "_c")
        every = every.join(part, F.col("_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in OUT[1:7]]
    found = F.struct(*zero, F.coalesce("audit", F.lit("")).alias("audit"))
    heads = keep(every.select(F.col("_id").alias("conv_id"), found.alias("found")))
    lines = rows.withColumn("digest", digest_of("role", "text"))
    both = heads.unionByName(lines, allowMissingColumns=True)
    order = ["conv_id", F.col("found").isNull(), "turn", "role", "digest"]
    streams = both.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "found", "role", "text")
    return streams.mapInArrow(_streamed(arrow), f"conv_id {kind}, {', '.join(f'{c} long' for c in OUT[1:7])}, audit string, repaired_sha256 string")


# --- the query ---------------------------------------------------------------------


def damaged(turns: DataFrame) -> DataFrame:
    """The rows after the damage of op12, told by a checksum of conversation and turn."""
    spoken = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(spoken[0], F.lit(":"), spoken[1])) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return turns.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(1), copies)).alias("_copy"),
    ).drop("_copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: conversations are damaged, then repaired."""
    turns = table(spark, sf_dir, "conversations")
    return repair(damaged(turns), turns)


ORACLE_SQL = rf"""
WITH RECURSIVE told AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind
  FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM told WHERE kind <> 0),
ordered AS (
  SELECT *, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last,
    row_number() OVER (PARTITION BY conv_id
      ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text), copy) AS i
  FROM hurt),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM ordered),
lines AS (
  SELECT conv_id, turn, role, text, i, role[1] AS ini, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN last = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM seen),
figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM lines GROUP BY conv_id),
ins(q, r, cost, letters, made) AS (VALUES
  ('0', '0', 0, '', ''), ('0', 'u', 5, 'I', chr(10) || 'user:'), ('0', 'a', 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  ('s', 's', 0, '', ''), ('s', 'u', 5, 'I', chr(10) || 'user:'), ('s', 'a', 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  ('u', 'u', 0, '', ''), ('u', 'a', 5, 'I', chr(10) || 'assistant:'), ('a', 'a', 0, '', ''), ('a', 'u', 5, 'I', chr(10) || 'user:')),
edits(q, r, edit, cost, role) AS (VALUES
  ('0', 's', 'K', 0, 's'), ('0', 'u', 'K', 0, 'u'), ('s', 'u', 'K', 0, 'u'), ('u', 'a', 'K', 0, 'a'), ('a', 'u', 'K', 0, 'u'),
  ('0', 'u', 'R', 1, 'user'), ('s', 'u', 'R', 1, 'user'), ('u', 'a', 'R', 1, 'assistant'), ('a', 'u', 'R', 1, 'user'),
  ('0', '0', 'D', 2, ''), ('s', 's', 'D', 2, ''), ('u', 'u', 'D', 2, ''), ('a', 'a', 'D', 2, '')),
ways AS (
  SELECT conv_id, 0::BIGINT AS i, '0' AS q, {{'cost': 0, 'audit': '', 'made': ''}} AS best FROM figures
  UNION ALL
  SELECT l.conv_id, l.i, e.r, min({{
    'cost': (w.best.cost + n.cost + e.cost + CASE WHEN e.edit <> 'D' AND l.fault = 'truncated' THEN 5 ELSE 0 END)::INTEGER,
    'audit': w.best.audit || n.letters || e.edit,
    'made': w.best.made || n.made || CASE e.edit WHEN 'K' THEN chr(10) || l.role || ':' || l.text
      WHEN 'R' THEN chr(10) || e.role || ':' || l.text ELSE '' END}})
  FROM ways w JOIN lines l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.i = w.i + 1
  JOIN ins n ON n.q = w.q JOIN edits e ON e.q = n.r
  WHERE (e.edit <> 'K' OR e.role = l.ini) AND (e.edit = 'D' OR l.fault NOT IN ('blank', 'duplicate'))
  GROUP BY l.conv_id, l.i, e.r),
goal AS (
  SELECT w.conv_id, min({{'cost': w.best.cost + n.cost, 'audit': w.best.audit || n.letters, 'made': w.best.made || n.made}}) AS best
  FROM ways w JOIN figures f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.i
  JOIN ins n ON n.q = w.q AND n.r IN ('0', 'a') GROUP BY w.conv_id)
SELECT c.conv_id, coalesce(f.gaps, 0)::BIGINT AS gaps, coalesce(f.blank, 0)::BIGINT AS blank,
  coalesce(f.duplicate, 0)::BIGINT AS duplicate, coalesce(f.truncated, 0)::BIGINT AS truncated,
  coalesce(f.illegal, 0)::BIGINT AS illegal, coalesce(g.best.cost, 0)::BIGINT AS cost,
  coalesce(g.best.audit, '') AS audit, sha256(coalesce(g.best.made[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN goal g ON g.conv_id IS NOT DISTINCT FROM c.conv_id
"""
