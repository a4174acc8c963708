"""Reader of raw CSV snapshots."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.sources import contract

ORDINAL = "_ordinal"
MALFORMED = "_malformed"
_RECORD = "_corrupt_record"
_PLACE, _RANK, _FILE = "_place", "_rank", "_file"
#: Bits of an ordinal for the place in a file; the file's number stands above them.
_PLACE_BITS = 44


class AmbiguousFileError(RuntimeError):
    """Two forms of one file in a snapshot."""


def _is_malformed(fields: int) -> Column:
    """More fields than the header, or a quoted field cut by a line break.

    Spark keeps the text of rows whose field count is wrong. Short rows are no fault:
    their missing fields are null.
    """
    outside_quotes = F.regexp_replace(_RECORD, '"(?:[^"]|"")*"', "")
    too_many = F.length(F.regexp_replace(outside_quotes, "[^,]", "")) >= fields
    return F.col(_RECORD).isNotNull() & (too_many | F.contains(outside_quotes, F.lit('"')))


def _with_rank(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, Column]:
    """The columns of file rows, and a number that follows files by name and rows by place.

    A row's place is the byte where its block starts plus the row's number in the task,
    which stays below the next block's start: a row has a byte at least, and a task that
    reads a whole block reads no other. Files are numbered by a join with their list, as small as
    the snapshot has files; a single file needs none.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    place = (F.col("_metadata.file_block_start") + row).alias(_PLACE)
    files = sorted(rows.inputFiles())
    if len(files) == 1:
        return rows.select(*columns, place), F.col(_PLACE)
    ranks = rows.sparkSession.createDataFrame(list(enumerate(files)), f"{_RANK} long, {_FILE} string")
    placed = rows.select(*columns, place, F.input_file_name().alias(_FILE))
    named = placed.join(F.broadcast(ranks), _FILE, "left").drop(_FILE)
    return named, F.shiftleft(F.coalesce(_RANK, F.lit(len(files)).cast("long")), _PLACE_BITS) + F.col(_PLACE)


def read_csv(spark: SparkSession, path: str, file_name: str, multi_line: bool = False) -> DataFrame:
    """The required columns of a snapshot as strings, with their place in the file.

    `path` is one file, a folder of part files, or a glob; gzip is read directly.
    Types are never inferred: one header read fixes the columns, and every further
    part file is checked against them. Set multi_line=True when quoted fields hold
    line breaks; such files are not split.

    Rows of facts with too many fields, or cut by such a line break, are marked in
    `_malformed`; in other files they raise when they are read.

    The ordinal, one bigint, sorts rows by file, then by place in the file, so the first
    row of a key can be told without a global sort.
    """
    options = {"header": True, "escape": '"', "multiLine": multi_line}
    header = spark.read.options(**options).csv(path).columns
    contract.check_columns(file_name, header)
    schema = T.StructType([T.StructField(name, T.StringType()) for name in [*header, _RECORD]])
    # Field counts are only seen by a parser that takes whole rows.
    options |= {"enforceSchema": False, "columnPruning": False}
    rows = spark.read.options(**options).schema(schema).csv(path)
    wanted = [c for c in header if c in contract.REQUIRED_COLUMNS.get(file_name, header)]
    rows, ordinal = _with_rank(rows, [*header, _RECORD])
    malformed = _is_malformed(len(header))
    if file_name in contract.FACT_FILES:
        return rows.select(*wanted, malformed.alias(MALFORMED), ordinal.alias(ORDINAL))
    # Naming the row's first field also keeps the check in plans that need no column.
    message = F.concat_ws(" ", F.lit(f"{file_name}: malformed row"), header[0], _RECORD)
    return rows.filter(F.when(malformed, F.raise_error(message).cast("boolean")).otherwise(True)).select(
        *wanted, ordinal.alias(ORDINAL)
    )


def read_snapshot(
    spark: SparkSession, folder: str, file_name: str, partitions: int | None = None, **options
) -> DataFrame:
    """Read one contract file of a snapshot folder, plain or gzipped.

    The name may also be a folder of part files, as Spark writes it. One gzip file
    is read by one task; pass `partitions` to spread its rows for the later steps.
    """
    path = f"{folder.rstrip('/')}/{file_name}{{,.gz}}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if len(file_system.globStatus(hadoop_path)) > 1:
        raise AmbiguousFileError(f"{folder}: both {file_name} and {file_name}.gz")
    rows = read_csv(spark, path, file_name, **options)
    return rows if partitions is None else rows.repartition(partitions)


def source_digest(spark: SparkSession, folder: str, file_name: str) -> str:
    """A digest of the lines of a contract file and their places, for telling whether it changed.

    The file is read as plain text, without parsing. Another split of the same file (another
    number of files or another block size) may give another digest, never the same digest for
    other lines.
    """
    lines = spark.read.text(f"{folder.rstrip('/')}/{file_name}{{,.gz}}", lineSep="\n")
    at = [F.element_at(F.split("_metadata.file_name", "/"), -1), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    figures = lines.select("value", *[c.alias(f"_{i}") for i, c in enumerate(at)]).agg(*multiset_digest(["value", "_0", "_1", "_2"]))
    return digest_text(figures.first())


_PIECES = ((0, 21), (21, 21), (42, 22))


def multiset_digest(columns: list[str]) -> list[Column]:
    """Aggregates that together tell a multiset of rows: its size and sums of two 64-bit hashes.

    Hashes are summed in pieces, so that no sum overflows below 2**41 rows.
    """
    sums = [F.count("*").alias("_n")]
    for seed in (1, 2):
        h = F.xxhash64(F.lit(seed), *columns)
        for start, bits in _PIECES:
            piece = F.shiftrightunsigned(h, start).bitwiseAND(F.lit((1 << bits) - 1))
            sums.append(F.sum(piece).alias(f"_s{seed}_{start}"))
    return sums


def digest_text(row) -> str:
    """A digest row as text; its fields are those of multiset_digest."""
    return ":".join(str(row[f"_s{seed}_{start}"] or 0) for seed in (1, 2) for start, _ in _PIECES) + f":{row['_n']}"
