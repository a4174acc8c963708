"""Conversation repair against all edit sequences, in one chunk and in many; edge rows and empty tables."""

import hashlib
import itertools
import random
import re

import pytest

from flowspark.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, place string, found string"
LEGAL = re.compile(r"(s?(ua)+)?")


def faults_of(rows):
    """First fault of each (role, text)."""
    seen, found = set(), []
    for role, text in rows:
        kept = text.strip(" \t\n\x0b\x0c\r")
        found.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def brute(rows, inserts=3):
    """The least (cost, audit) over all edit sequences with few inserts, and the repaired lines."""
    faults, best = faults_of(rows), None
    made = [[("I", "user", "", 5)], [("I", "assistant", "", 5)]]
    choices = []
    for (role, text), fault in zip(rows, faults):
        more = 5 if fault == "truncated" else 0
        options = [("D", None, None, 2)]
        if fault not in ("blank", "duplicate"):
            options += [("K", role, text, more), ("R", "user", text, 1 + more), ("R", "assistant", text, 1 + more)]
        choices.append(options)
    for picked in itertools.product(*choices):
        for n in range(inserts + 1):
            for where in itertools.combinations_with_replacement(range(len(rows) + 1), n):
                for kinds in itertools.product(made, repeat=n):
                    edits = []
                    for i in range(len(rows) + 1):
                        edits += [kinds[k][0] for k in range(n) if where[k] == i]
                        edits += [picked[i]] if i < len(rows) else []
                    kept = [(r, t) for e, r, t, _ in edits if e != "D"]
                    if LEGAL.fullmatch("".join((r[:1] or "x") for r, _ in kept)):
                        found = (sum(e[3] for e in edits), "".join(e[0] for e in edits), kept)
                        best = found if best is None or found[:2] < best[:2] else best
    return best


def dp(rows):
    """The same by a plain table over states, for long conversations."""
    table = {"0": (0, "")}

    def inserted(table):
        for _ in range(3):
            for q in list(table):
                cost, audit = table[q]
                r = repair.NEXT[q]
                table[r] = min(table.get(r, (10**9, "")), (cost + 5, audit + "I"))
        return table

    for (role, _), fault in zip(rows, faults_of(rows)):
        out = {}
        for q, (cost, audit) in inserted(table).items():
            options = [(q, 2, "D")]
            more = 5 if fault == "truncated" else 0
            if fault not in ("blank", "duplicate"):
                options.append((repair.NEXT[q], 1 + more, "R"))
                if role[:1] == repair.NEXT[q] or (q == "0" and role[:1] == "s"):
                    options.append((role[:1], more, "K"))
            for r, add, letter in options:
                out[r] = min(out.get(r, (10**9, "")), (cost + add, audit + letter))
        table = out
    table = inserted(table)
    return min(table[q] for q in ("0", "a") if q in table)


def random_rows(rng, n):
    texts = ["Fine.", "Yes!", "Why?", "cut off", "", " \t", "Same. ", "Other.\n"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "Umpire", "u2"]
    return [(rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"Text {rng.random()}.") for _ in range(n)]


def test_search_equals_all_edit_sequences():
    rng = random.Random(4)
    for _ in range(60):
        rows = random_rows(rng, rng.randint(0, 4))
        codes = [((role[:1] if role[:1] in "sua" and role else "x") + {"": "k", "blank": "b", "duplicate": "d", "truncated": "t"}[f]) for (role, _), f in zip(rows, faults_of(rows))]
        ways = repair.best_ways([repair.row_ways(c) for c in codes], ("0",), inserts=True)
        cost, audit, _ = brute(rows)
        assert repair.chosen(ways) == (cost, audit) == dp(rows)


def test_agenda_finishes_items_in_order_of_weight():
    rng = random.Random(6)
    codes = [rng.choice("suax") + rng.choice("kkkbdt") for _ in range(40)]
    steps = [repair.row_ways(c) for c in codes]
    deductions = [repair.Deduction((repair._at(i, q),), repair._at(i + 1, r), cost, letters) for i, ways in enumerate(steps) for q, r, cost, letters in ways]
    final = repair.lightest({repair._at(0, "0"): (0, "")}, deductions, {repair._at(40, q) for q in repair.STATES})
    assert list(final.values()) == sorted(final.values())


def expected(turns):
    """Rows of a conversation in the operator's order, nulls as one space."""
    rows = [(t is not None, t or 0, " " if r is None else r, " " if x is None else x, t) for t, r, x in turns]
    rows.sort(key=lambda r: (r[0], r[1], r[2].encode(), hashlib.sha256(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).digest()))
    pairs, turn = [(r[2], r[3]) for r in rows], [r[4] for r in rows if r[4] is not None]
    faults, initials = faults_of(pairs), [p[0][:1] for p in pairs]
    cost, audit = dp(pairs)
    lines, at, state = [], 0, "0"
    for role, text in [*pairs, (None, None)]:
        while audit[at : at + 1] == "I":
            state, at = repair.NEXT[state], at + 1
            lines.append(repair.ROLE[state] + ":")
        if role is None:
            break
        edit, at = audit[at], at + 1
        if edit == "K":
            state = role[:1]
            lines.append(f"{role}:{text}")
        elif edit == "R":
            state = repair.NEXT[state]
            lines.append(f"{repair.ROLE[state]}:{text}")
    return (
        max(turn) - min(turn) + 1 - len(set(turn)) if turn else 0,
        faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


@pytest.mark.parametrize("bits", [(1, 1), (3, 2), (repair.CHUNK_BITS, repair.TIER_BITS)])
def test_repair_over_chunks(spark, bits):
    rng = random.Random(sum(bits))
    convs = {1: 0, 2: 1, 3: 5, 4: 23, 5: 120, 6: 9, None: 14}
    rows, told = [], {}
    for c, n in convs.items():
        told[c] = []
        for role, text in random_rows(rng, n):
            turn = rng.choice([None, rng.randint(-3, 40), rng.randint(0, 10)])
            row = (c, turn, rng.choice([role, role, None]), rng.choice([text, text, text, None]))
            rows += [(*row, "clash", "clash")] * (2 if rng.random() < 0.1 else 1)
            told[c] += [row[1:]] * (len(rows) - sum(len(v) for v in told.values()))
    rows.append((6, 3, "user", "long " * 50_000, None, None))
    told[6].append((3, "user", "long " * 50_000))
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    ids = spark.createDataFrame([(c,) for c in convs] + [(99,)], "conv_id long")
    found = {r["conv_id"]: tuple(r[c] for c in repair.OUT[1:]) for r in repair.repair(df, ids, chunk_bits=bits[0], tier_bits=bits[1]).collect()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found == {**{c: expected(t) if t else nothing for c, t in told.items()}, 99: nothing}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repair(empty, empty).isEmpty()


def test_damage(spark):
    turns = spark.createDataFrame([(c, t, "assistant", "One. Two!") for c in range(40) for t in range(5)] + [(None, None, None, None)], "conv_id long, turn long, role string, text string")
    import zlib

    kinds = {(c, t): zlib.crc32(f"{c}:{t}".encode()) % 20 for c in range(40) for t in range(5)}
    found = {}
    for c, t, role, text in repair.damaged(turns).where("conv_id is not null").collect():
        found.setdefault((c, t), []).append((role, text))
    plain = ("assistant", "One. Two!")
    made = {1: [("assistant", "")], 2: [("assistant", "One Two")], 3: [plain] * 2, 4: [("user", "One. Two!")]}
    assert found == {k: made.get(kind, [plain]) for k, kind in kinds.items() if kind != 0}
