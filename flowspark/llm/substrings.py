"""Substring dedup over a compacted de Bruijn graph of token k-mers.

Repeated spans of SPAN words or more are found without shuffling every window:

1. In each SPAN-word window the K-mer with the smallest hash is chosen. Consecutive windows
   with the same choice form a cell; equal windows choose equal K-mers. A cell is a graph
   edge: its K-mer, a hash of all its words, and the place it comes from.
2. Only cells whose K-mer occurs again go on. Equal cells are one edge, with its number of
   places, the first of them, and a digest of all places and of all ends.
3. A join links each edge to the edge that starts where it ends. Where both have the same
   number of places and the ends of the one are the places of the other, the path doesn't
   branch there; such links are compacted to paths along the document of their first place.
   Every place of a path's first edge is one occurrence of the whole repeated span, and the
   path's first place is its source.
4. Cells that share a K-mer but differ in words are branching ends. Their first places are
   compared window by window, so that ends are exact to the word.

A word goes if a window over it has the same words as a window that starts earlier.
Words are told apart by 64-bit hashes; cells and windows by 128 bits made from them.

Places are those of rows: the id with a hash of the text, so that rows of one id with other
texts are documents of their own, and equal rows are one.

Two bitmaps of fixed size tell the scans which cells and places may matter, so that the rest
isn't shuffled. They only spare work: on more data than they are made for they let more rows
pass, and the joins behind them decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import encoded, keep, release, table

SPAN, K = 20, 6
#: Bits of a bitmap, as a power of two (16 MB).
FILTER_BITS = 27
#: Odd factors for positions.
_FACTORS = np.array([xxhash.xxh64_intdigest(bytes([i])) | 1 for i in range(16)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: Random values for bytes (blanks count nothing), and odd ones for places in a word.
_BYTES = np.array([xxhash.xxh64_intdigest(b"byte%d" % i) for i in range(256)], np.uint64)
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
_BYTES[_BLANK] = 0
_ODD = _mixed(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) | np.uint64(1)


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text, without cutting the words out."""
    data = np.frombuffer(raw, np.uint8)
    turns = np.flatnonzero(np.diff(~_BLANK[data], prepend=False, append=False))
    starts, ends = turns[::2], turns[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    place = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(starts, append=len(data)))
    factor = _ODD[place & 0xFFFF]
    if len(data) > 1 << 16:  # places in longer words take further factors, odd ones too
        factor = factor + (place >> 16).astype(np.uint64) * (_FACTORS[14] << np.uint64(1))
    value = _BYTES[data[starts[0] :]] * factor
    return _mixed(np.add.reduceat(value, starts - starts[0]) + (ends - starts).astype(np.uint64) * _FACTORS[15])


def kmer_hashes(words: np.ndarray) -> np.ndarray:
    n = len(words) - K + 1
    h = words[:n] * _FACTORS[0]
    for j in range(1, K):
        h += words[j : j + n] * _FACTORS[j]
    return _mixed(h)


def window_hashes(kmers: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each SPAN-word window that starts at a place, from K-mers that cover it."""
    one, two = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for i, off in enumerate([*range(0, SPAN - K, K), SPAN - K]):
        part = kmers[at + off]
        one += part * _FACTORS[8 + i]
        two += (part ^ _FACTORS[12]) * _FACTORS[i]
    return _mixed(one), _mixed(two)


def cells_of(kmers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the K-mer, start and number of windows of each cell of a document."""
    windows = sliding_window_view(kmers, SPAN - K + 1)
    picks = windows.argmin(axis=1) + np.arange(len(windows))
    start = np.flatnonzero(np.diff(picks, prepend=-1))
    return picks[start], start, np.diff(start, append=len(picks))


def cell_contents(kmers: np.ndarray, pick: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of all words of each cell: its first and last window overlap or touch, so they cover it."""
    shape = (n * 64 + (pick - start)).astype(np.uint64)
    return _mixed(_mixed(window_hashes(kmers, start)[0] + shape) * _FACTORS[1] + window_hashes(kmers, start + n - 1)[1])


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _places(doc_id: np.ndarray, twin: np.ndarray, start: np.ndarray) -> np.ndarray:
    row = doc_id.astype(np.int64).view(np.uint64) * _FACTORS[3] + twin.astype(np.int64).view(np.uint64) * _FACTORS[5]
    return _mixed(row + start.astype(np.uint64) * _FACTORS[4])


def bitmap(rows: DataFrame, column: str) -> Broadcast:
    """The hashes of a column as bits, for every task; 2 ** FILTER_BITS bits at any size.

    Tasks set the bits of one block each; the driver joins the blocks, which have a fixed size.
    """
    block_bits = 19

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch["h"].to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - FILTER_BITS)
            of = (at >> np.uint64(block_bits)).astype(np.int64)
            for block in np.unique(of).tolist():
                flags = blocks.setdefault(block, np.zeros(1 << block_bits, bool))
                flags[(at[of == block] & np.uint64((1 << block_bits) - 1)).astype(np.int64)] = True
        for block, flags in blocks.items():
            yield pd.DataFrame({"block": [block], "bits": [np.packbits(flags, bitorder="little").tobytes()]})

    block = F.shiftrightunsigned(column, 64 - FILTER_BITS + block_bits)
    dealt = rows.select(F.col(column).alias("h")).repartition(block)
    bits = np.zeros((1 << (FILTER_BITS - block_bits), 1 << (block_bits - 3)), np.uint8)
    for row in dealt.mapInPandas(fill, "block long, bits binary").toLocalIterator():
        bits[row["block"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return rows.sparkSession.sparkContext.broadcast(bits.view(np.uint64).ravel())


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - FILTER_BITS)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _scan(docs: DataFrame, columns: str, rows_of: Callable, given: Broadcast | None = None) -> DataFrame:
    """rows_of((doc_id, twin), K-mer hashes, bits) for every text of SPAN words or more, as arrays by column."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = given.value if given else None
        for batch in batches:
            parts, size = [], 0
            for doc_id, twin, text in zip(batch["doc_id"], batch["twin"], batch["text"], strict=True):
                words = word_hashes(encoded(text))
                if len(words) >= SPAN:
                    parts.append(rows_of((doc_id, twin), kmer_hashes(words), bits))
                    size += len(parts[-1][0])
                if size > 200_000:
                    yield pd.DataFrame({c: np.concatenate([p[i] for p in parts]) for i, c in enumerate(names)})
                    parts, size = [], 0
            if parts:
                yield pd.DataFrame({c: np.concatenate([p[i] for p in parts]) for i, c in enumerate(names)})

    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), _twin().alias("twin"), "text")
    return known.mapInPandas(run, columns)


def _twin() -> F.Column:
    """Tells rows of one id apart by their texts."""
    return F.xxhash64("text")


Row = tuple[int, int]


def _kmers_only(row: Row, kmers: np.ndarray, bits: object) -> list[np.ndarray]:
    return [_signed(kmers[cells_of(kmers)[0]])]


def _whole_cells(row: Row, kmers: np.ndarray, bits: np.ndarray) -> list[np.ndarray]:
    pick, start, n = cells_of(kmers)
    on = _in(bits, kmers[pick])
    pick, start, n = pick[on], start[on], n[on]
    return [_signed(kmers[pick]), _signed(cell_contents(kmers, pick, start, n)), np.full(len(n), row[0]), np.full(len(n), row[1]), start, n]


def _chosen_windows(row: Row, kmers: np.ndarray, bits: np.ndarray) -> list[np.ndarray]:
    _, start, n = cells_of(kmers)
    on = _in(bits, _places(np.full(len(start), row[0]), np.full(len(start), row[1]), start))
    start, n = start[on], n[on]
    at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    one, two = window_hashes(kmers, at)
    return [_signed(one), _signed(two), np.full(len(at), row[0]), np.full(len(at), row[1]), at]


def repeated_cells(docs: DataFrame) -> DataFrame:
    """(kmer, content, doc_id, twin, start, n): the cells whose K-mer is chosen at two places or more."""
    kmers = _scan(docs, "kmer long", _kmers_only)
    again = bitmap(kmers.groupBy("kmer").count().where("count > 1"), "kmer")
    cells = keep(_scan(docs, "kmer long, content long, doc_id long, twin long, start int, n int", _whole_cells, again))
    again.destroy()
    return cells


def _sums(name: str, *place: object) -> list[F.Column]:
    """Two sums that tell a multiset of places, for every occurrence counts; null beyond 2**31 places."""
    h = F.xxhash64(*place)
    return [F.try_sum(F.shiftright(h, 32)).alias(f"{name}_high"), F.try_sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"{name}_low")]


_ENDS, _STARTS = ("ends_high", "ends_low"), ("starts_high", "starts_low")


def graph_edges(cells: DataFrame) -> DataFrame:
    """(kmer, content, times, doc_id, twin, start, n, starts_*, ends_*): equal cells once, with their first place."""
    end = F.col("start") + F.col("n")
    edges = cells.groupBy("kmer", "content").agg(
        F.min(F.struct("doc_id", "twin", "start", "n")).alias("first"), F.count("*").alias("times"),
        *_sums("starts", "doc_id", "twin", "start"), *_sums("ends", "doc_id", "twin", end),
    )
    return keep(edges.select("kmer", "content", "times", "first.*", *_STARTS, *_ENDS))


def compacted_paths(edges: DataFrame) -> DataFrame:
    """(kmer, content, n_windows, n_edges, source_doc, source_twin, source_start): each nonbranching path
    of edges that occur twice or more, under the K-mer and content of its first edge."""
    again = edges.where("times > 1")
    before = again.select(
        "doc_id", "twin", (F.col("start") + F.col("n")).alias("start"), F.col("times").alias("_times"), *[F.col(c).alias(f"_{c}") for c in _ENDS]
    )
    linked = again.join(before.distinct(), ["doc_id", "twin", "start"], "left")
    same = F.col("_times") == F.col("times")
    for one, other in zip(_ENDS, _STARTS, strict=True):
        same &= F.col(f"_{one}") == F.col(other)
    linked = linked.groupBy("kmer", "content", "doc_id", "twin", "start", "n").agg(F.max(F.coalesce(same, F.lit(False))).alias("goes_on"))
    order = Window.partitionBy("doc_id", "twin").orderBy("start", "kmer", "content")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    linked = linked.withColumn("path", F.sum((~F.col("goes_on")).cast("int")).over(upto))
    head = F.min(F.struct("start", "kmer", "content")).alias("head")
    paths = linked.groupBy("doc_id", "twin", "path").agg(head, F.sum("n").alias("n_windows"), F.count("*").alias("n_edges"))
    source = [F.col("doc_id").alias("source_doc"), F.col("twin").alias("source_twin"), F.col("head.start").alias("source_start")]
    return keep(paths.select("head.kmer", "head.content", "n_windows", "n_edges", *source))


def path_spans(cells: DataFrame, paths: DataFrame) -> DataFrame:
    """(doc_id, twin, start, n_windows, source_doc, source_twin, source_start): all occurrences of all paths."""
    source = ("source_doc", "source_twin", "source_start")
    return cells.drop("n").join(paths, ["kmer", "content"]).select("doc_id", "twin", "start", "n_windows", *source)


def branching_windows(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, twin, start, n_windows): windows in branching cells whose words start earlier elsewhere."""
    forks = edges.groupBy("kmer").count().where("count > 1").select("kmer")
    place = F.pandas_udf(lambda d, t, s: pd.Series(_signed(_places(d.to_numpy(), t.to_numpy(), s.to_numpy()))), "long")
    ends = edges.join(forks, "kmer", "left_semi").select(place("doc_id", "twin", "start").alias("place"))
    columns = "one long, two long, doc_id long, twin long, start int"
    chosen = bitmap(ends, "place")
    windows = keep(_scan(docs, columns, _chosen_windows, chosen))
    chosen.destroy()
    at = F.struct("doc_id", "twin", "start")
    first = windows.groupBy("one", "two").agg(F.min(at).alias("first"), F.count("*").alias("times")).where("times > 1")
    later = windows.join(first.drop("times"), ["one", "two"]).where(F.col("first") != at)
    return later.select("doc_id", "twin", "start", F.lit(1).cast("long").alias("n_windows"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, twin, start, n_windows): every window whose words start earlier elsewhere lies in one of them."""
    cells = repeated_cells(docs)
    edges = graph_edges(cells)
    paths = compacted_paths(edges)
    spans = path_spans(cells, paths)
    later = spans.where("doc_id <> source_doc OR twin <> source_twin OR start <> source_start")
    found = later.select("doc_id", "twin", "start", "n_windows").unionByName(branching_windows(edges, docs))
    # Equal rows tell the same spans.
    found = keep(found.distinct())
    release(cells, edges, paths)
    return found


def covered(n: int, spans: np.ndarray | None) -> np.ndarray:
    """Which of n words lie under a window of the spans, each start * 2**32 + number of windows."""
    step = np.zeros(n + 1, np.int64)
    if spans is not None:
        start = spans >> 32
        np.add.at(step, start, 1)
        np.add.at(step, start + (spans & 0xFFFFFFFF) + SPAN - 1, -1)
    return np.cumsum(step[:n]) > 0


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with the kept text, plus n_words, n_removed, kept_sha256.

    The text stays as it is where nothing is removed; else it is the kept words joined by
    single spaces. n_words counts the words before, kept_sha256 is the digest of the kept
    words joined by single spaces. Null and empty texts have no words and stay as they are.
    Documents without an id are left whole. Rows that share an id are documents of their own
    where their texts differ, in the order of a hash of the text; equal rows count as one.
    Texts below SPAN words never lose a word; texts may be of any length, an empty table gives
    an empty one. Columns of the three names are replaced; ids are whole numbers.
    """
    docs = docs.drop("n_words", "n_removed", "kept_sha256")
    spans = repeated_spans(docs.select("doc_id", "text"))
    # Gathered by row, different spans are an array of numbers no longer than the text.
    span = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("n_windows"))
    by_doc = spans.groupBy(F.col("doc_id").alias("_span_doc"), F.col("twin").alias("_span_twin")).agg(F.collect_list(span).alias("_spans"))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items())

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield batch.assign(text=[squeeze(encoded(t)) if isinstance(t, str) else None for t in batch["text"]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, len(batch), 500):
                rows = batch.iloc[at : at + 500]
                counts, gone, texts, digests = [], [], [], []
                for packed, found in zip(rows["text"], rows["_spans"], strict=True):
                    raw = release(packed) if packed is not None else None
                    words = (raw or b"").split()
                    out = covered(len(words), found)
                    counts.append(len(words))
                    gone.append(int(out.sum()))
                    kept = b" ".join([w for w, o in zip(words, out.tolist(), strict=True) if not o] if gone[-1] else words)
                    digests.append(hashlib.sha256(kept).hexdigest())
                    texts.append(None if raw is None else (kept if gone[-1] else raw).decode("utf-8", "surrogatepass"))
                yield rows[list(kinds)].assign(text=texts, n_words=counts, n_removed=gone, kept_sha256=digests)

    told = docs.withColumn("_text_twin", _twin())
    packed = told.mapInPandas(pack, f"{schema}, _text_twin long".replace("`text` string", "`text` binary"))
    same = (F.col("doc_id").cast("long") == F.col("_span_doc")) & (F.col("_text_twin") == F.col("_span_twin"))
    joined = packed.join(by_doc, same, "left").drop("_span_doc", "_span_twin", "_text_twin")
    return joined.mapInPandas(run, f"{schema}, n_words long, n_removed long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", "kept_sha256")
