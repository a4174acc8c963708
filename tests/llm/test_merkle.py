"""The Merkle manifest against a plain Python one: groups, lone nodes, tampering, subsets, edge rows."""

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from flowspark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place string, leaf string"


def h(s):
    return sha256(s.encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    """All levels of a tree."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return levels


def proof(levels, at):
    found = []
    for level in levels[:-1]:
        found.append(level[at ^ 1] if at ^ 1 < len(level) else "")
        at >>= 1
    return found


def brute(rows):
    """Sorted (doc_id, leaf, subroot, root, proof) of rows as dicts."""
    by_lang = {}
    for r in rows:
        leaf = h("".join(enc(r[f]) for f in merkle.FIELDS))
        by_lang.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf, r["doc_id"]))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = [tree([leaf for _, _, leaf, _ in sorted(by_lang[g], key=lambda x: x[:3])]) for g in langs]
    top = tree([t[-1][0] for t in trees])
    out = []
    for i, g in enumerate(langs):
        for at, (_, _, leaf, key) in enumerate(sorted(by_lang[g], key=lambda x: x[:3])):
            out.append((key, leaf, trees[i][-1][0], top[-1][0], [*proof(trees[i], at), *proof(top, i)]))
    return sorted(out, key=repr)


def rows_of(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "en", "é", "de", None, "", "zz"])
        text = rng.choice(["", None, "x" * 70_000, f"text {i} ü", "same"])
        rows.append((i, text, lang, rng.choice(["a", None, ""]), rng.choice([None, i, -5, 2**62]), "clash", "clash"))
    rows += [(None, "a", "en", None, 1, "c", "c"), (None, "b", "en", None, 1, "c", "c"), (None, None, None, None, None, None, None)]
    rows += [rows[0]] * 5 + [(rows[0][0], "another text", rows[0][2], None, 2, "c", "c"), (7777, "alone", "only", "s", 5, "c", "c")]
    return rows


def as_dicts(rows):
    return [dict(zip(["doc_id", "text", "lang", "source", "n_chars"], r[:5], strict=True)) for r in rows]


def gathered(df):
    return sorted([(r["key"], r["leaf"], r["subroot"], r["root"], r["proof"]) for r in df.collect()], key=repr)


@pytest.mark.parametrize("tier", [1, 3, merkle.TIER])
def test_manifest_equals_brute_force(spark, tier):
    rows = rows_of(90)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    made = merkle.manifest(docs, tier=tier)
    found = merkle.proofs(made)
    expected = brute(as_dicts(rows))
    assert gathered(found) == expected
    assert found.where("folded <> root").isEmpty()
    assert [r["root"] for r in made.root().collect()] == [expected[0][3]]


def test_tampered_leaves_do_not_fold_to_the_root(spark):
    rows = rows_of(60, 8)
    docs = spark.createDataFrame(rows, SCHEMA)
    struck = F.col("doc_id") % 4 == 1
    altered = {"n_chars": F.when(struck, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))}
    found = merkle.proofs(merkle.manifest(docs, altered=altered, tier=2)).select("key", (F.col("folded") == F.col("root")).alias("ok"))
    told = {}
    for key, ok in found.collect():
        told.setdefault(key, set()).add(ok)
    for r in rows:
        if r[0] is not None and r[0] % 4 == 1:
            assert (r[4] is None) in told[r[0]]
        elif r[0] is not None:
            assert told[r[0]] == {True}


def test_wanted_subset_asks_for_the_least_nodes_and_folds(spark):
    rows = rows_of(120, 9)
    made = merkle.manifest(spark.createDataFrame(rows, SCHEMA), tier=4)
    wanted = made.leaves.where("place % 5 = 2")
    found = merkle.proofs(made, wanted)
    assert 0 < found.count() == wanted.count()
    every = {repr(x) for x in brute(as_dicts(rows))}
    assert all(repr(x) in every for x in gathered(found))
    assert found.where("folded <> root").isEmpty()


def test_missing_is_minimal():
    rng = random.Random(1)
    for _ in range(200):
        size = rng.randint(1, 40)
        height = (size - 1).bit_length()
        places = rng.sample(range(size), rng.randint(1, size))
        asked = merkle.missing(places, height, size)
        whole = tree([h(str(i)) for i in range(size)])
        known = {(0, p): whole[0][p] for p in places} | {(level, p): whole[level][p] for level, p in asked}
        merkle.derive(known, places, height, size)
        assert known[height, 0] == whole[-1][0]
        assert len(set(asked)) == len(asked)
        for node in asked:  # no asked node stands over a wanted leaf, and none over another asked one
            assert not any(p >> node[0] == node[1] for p in places)
            assert not any(o != node and o[0] < node[0] and o[1] >> (node[0] - o[0]) == node[1] for o in asked)


def test_empty_table_and_one_row(spark):
    empty = merkle.manifest(spark.createDataFrame([], SCHEMA))
    assert merkle.proofs(empty).isEmpty() and empty.root().isEmpty()
    one = rows_of(0)[2:3]
    assert gathered(merkle.proofs(merkle.manifest(spark.createDataFrame(one, SCHEMA)))) == brute(as_dicts(one))
