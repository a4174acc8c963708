"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items form one automaton. Each training text is streamed
through it: the state tells the longest suffix of the words so far that occurs in an item.
Where that is a whole window (WINDOW words, or a whole shorter item), its words are hit.

Test items go to the tasks in shards of bounded size, one automaton each; hits of several
shards are united. With one shard a single pass over the texts does everything.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import encoded, table

WINDOW = 13
#: Bytes of item text in one automaton at most (a single longer item stands alone).
SHARD_BYTES = 4 << 20
#: A word: digits, letters a-z (after lower-casing) and every byte beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def normal_words(text: object) -> list[bytes]:
    return WORD.findall(encoded(text).lower())


class SuffixAutomaton:
    """All substrings of several word sequences; words are numbered."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.number = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, str]] = []  # states in which a sequence of an item ends, with the item
        short: dict[int, set[str]] = {}
        for name, words in items:
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, self.number.setdefault(w, len(self.number)))
                if i + 1 >= window:
                    ends.append((last, name))
            if 0 < len(words) < window:
                short.setdefault(last, set()).add(name)
        # Items in which the window that ends in a state occurs: those of the state and of all longer ones.
        self.items: dict[int, set[str]] = {}
        for state, name in ends:
            while state > 0 and self.length[state] >= window:
                known = self.items.setdefault(state, set())
                if name in known:
                    break
                known.add(name)
                state = self.link[state]
        self.short = short
        self.near = self._nearest_short()
        self.base = self._window_states()

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def _by_length(self) -> list[int]:
        return sorted(range(1, len(self.next)), key=self.length.__getitem__)

    def _nearest_short(self) -> list[int]:
        """For each state the nearest state up its links (itself excluded) that is a whole short item."""
        near = [0] * len(self.next)
        for s in self._by_length():
            up = self.link[s]
            near[s] = up if up in self.short else near[up]
        return near

    def _window_states(self) -> list[int]:
        """For each state of at least a window's length the state that holds its last window."""
        base = [0] * len(self.next)
        for s in self._by_length():
            if self.length[s] >= self.window:
                up = self.link[s]
                base[s] = base[up] if self.length[up] >= self.window else s
        return base

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans (start, end) of words that are hit, and the items of their windows."""
        nxt, link, length, short, near, window = self.next, self.link, self.length, self.short, self.near, self.window
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        state = size = 0
        for i, c in enumerate(map(self.number.get, words)):
            if c is None:
                state = size = 0
                continue
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            if c not in nxt[state]:
                continue
            state = nxt[state][c]
            size += 1
            if size >= window:
                spans.append((i + 1 - window, i + 1))
                found.add(self.base[state])
            s = state if state in short and size >= length[state] else near[state]
            while s:
                spans.append((i + 1 - length[s], i + 1))
                found.add(-s)
                s = near[s]
        names: set[str] = set()
        for s in found:
            names |= self.items[s] if s > 0 else short[-s]
        return spans, names


def item_shards(items: DataFrame) -> list[list[tuple[str, bytes]]]:
    """Items (item_id, text) by order of id, cut into shards of SHARD_BYTES; repeated rows count once.

    Items without text give no window. One shard at a time is read to the driver.
    """
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text").where("text is not null").distinct()
    size = F.octet_length("text").cast("long")
    if (named.agg(F.sum(size)).first()[0] or 0) <= SHARD_BYTES:
        shards = [named]
    else:
        upto = Window.partitionBy("_part").orderBy("name", "text").rowsBetween(Window.unboundedPreceding, -1)
        parts = named.withColumn("_part", F.pmod(F.xxhash64("name"), F.lit(64)))
        parts = parts.withColumn("_shard", F.floor(F.coalesce(F.sum(size).over(upto), F.lit(0)) / SHARD_BYTES))
        keys = parts.select("_part", "_shard").distinct().orderBy("_part", "_shard").collect()
        shards = [parts.where((F.col("_part") == k[0]) & (F.col("_shard") == k[1])).select("name", "text") for k in keys]
    return [[(r["name"], r["text"]) for r in s.orderBy("name", "text").toLocalIterator()] for s in shards]


def find_contamination(docs: DataFrame, items: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text, ...) plus n_words, n_hit, hit_items, hit_spans.

    hit_items: the distinct item ids as sorted strings (without null ids), hit_spans: hit
    stretches (start, end) in words, merged. Null and empty texts have no words and no hit;
    items without words give no window. Columns of these names are replaced.
    """
    docs = docs.drop("n_words", "n_hit", "hit_items", "hit_spans")
    shards = item_shards(items)
    for at, shard in enumerate(shards or [[]]):
        docs = _one_shard(docs, shard, window, at > 0)
    return docs


def _one_shard(docs: DataFrame, items: list[tuple[str, str]], window: int, more: bool) -> DataFrame:
    given = docs.sparkSession.sparkContext.broadcast(items)
    names = [c for c in docs.columns if c not in ("n_words", "n_hit", "hit_items", "hit_spans")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = SuffixAutomaton([(n, normal_words(t)) for n, t in given.value], window)
        for batch in batches:
            counts, hit, found, stretches = [], [], [], []
            for i, text in enumerate(batch["text"]):
                words = normal_words(text)
                spans, of = automaton.hits(words)
                if more:
                    spans += [(s["start"], s["end"]) for s in batch["hit_spans"].iloc[i]]
                    of |= set(batch["hit_items"].iloc[i])
                merged = _merged(spans)
                counts.append(len(words))
                hit.append(sum(b - a for a, b in merged))
                found.append(sorted(of - {""}))
                stretches.append([{"start": a, "end": b} for a, b in merged])
            out = batch[names].assign(n_words=counts, n_hit=hit)
            yield out.assign(hit_items=pd.Series(found, index=out.index, dtype=object), hit_spans=pd.Series(stretches, index=out.index, dtype=object))

    return docs.mapInPandas(run, f"{kinds}, n_words long, n_hit long, hit_items array<string>, hit_spans array<struct<start:int,end:int>>")


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def is_contaminated() -> F.Column:
    """A twentieth of the words or more is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def _without_spans(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Cuts from the first to the last hit word of each stretch, with what stands between."""
    out = []
    for text, found in zip(texts, spans, strict=True):
        if found is not None and len(found):
            raw = encoded(text)
            at = [m.span() for m in WORD.finditer(raw.lower())]
            kept, done = [], 0
            for s in found:
                kept.append(raw[done : at[s["start"]][0]])
                done = at[s["end"] - 1][1]
            text = b"".join([*kept, raw[done:]]).decode("utf-8", "surrogatepass")
        out.append(text)
    return pd.Series(out, dtype=object)


#: A stretch is cut out of a clean document where it is at least so long, in words.
CUT_LENGTH = WINDOW


def _cut_spans(spans: F.Column, length: int) -> F.Column:
    return F.filter(spans, lambda s: s["end"] - s["start"] >= length)


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, cut_length: int = CUT_LENGTH) -> DataFrame:
    """Drops contaminated documents and cuts long hit stretches out of the others' text.

    A document goes when a twentieth of its words or more is hit. Of a document that stays,
    stretches of cut_length words or more are cut; shorter ones, which only items below a
    window's length can make, stay, as they are common phrases and the document is clean. Null
    and empty texts stay as they are, equal rows are judged alike, texts may be of any length; an
    empty table gives an empty one, and without items all stay. Other columns are kept as they
    are, whatever their names.
    """
    cut = F.pandas_udf(_without_spans, "string")
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"]
    own = docs.select(F.struct(F.lit(0).alias("_"), *others).alias("_doc"), "text")
    judged = find_contamination(own, items, window=window).where(~is_contaminated())
    long = _cut_spans(F.col("hit_spans"), cut_length)
    judged = judged.withColumn("text", F.when(F.size(long) > 0, cut("text", long)).otherwise(F.col("text")))
    return judged.select(*[F.col("text") if c == "text" else F.col("_doc")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = find_contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH docs AS (
    SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS k
    FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM items WHERE len(w) > 0)
), places AS (
    SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS k
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), found AS (
    SELECT p.r, p.i, p.n, x.item_id FROM places p JOIN windows x ON p.n = x.n AND p.k = x.k
), hit AS (
    SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r
), names AS (
    SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM found GROUP BY r
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(len(n.ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(n.ids, ','), '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hit h USING (r) LEFT JOIN names n USING (r)
"""
