"""Helpers shared by the text operators: tables, intermediate results, word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and the five ASCII controls 9 to 13.
BLANKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small_batches(spark: SparkSession) -> None:
    """Rows of whole texts are large: a Python task gets fewer of them at a time than by default."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="flowspark-llm-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    This cuts the lineage at files that survive a lost executor, and gives the planner
    the table's true size, so that it broadcasts only what is small.
    """
    path = f"{shared_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def release(*tables: DataFrame | None) -> None:
    """Delete kept tables whose last reader has been written; others, and None, are left alone."""
    for df in tables:
        path = getattr(df, "_kept_at", None)
        if path:
            spark = df.sparkSession
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(hadoop, True)
            df._kept_at = None


def with_row_number(docs: DataFrame, name: str) -> DataFrame:
    """docs with a different long for each row, the same each time they are read.

    Rows of Parquet files are numbered by file and place in the file, which hold however tasks
    are cut; the list of files is all that the driver sees. Other tables are kept first.
    """
    try:
        at = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    except AnalysisException:
        return keep(docs.withColumn(name, F.monotonically_increasing_id()))
    files = sorted(r[0] for r in at.select("_file").distinct().collect())
    ranks = docs.sparkSession.createDataFrame(list(enumerate(files)), "_rank long, _file string")
    return at.join(F.broadcast(ranks), "_file").withColumn(name, F.shiftleft("_rank", 40) + F.col("_at")).select(*docs.columns, name)


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case; all other characters stay."""
    return F.translate(text, UPPER, LOWER)


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text of ASCII characters; null if it is null."""
    step = "list_reduce(list_concat([xor(c, b) & 255], range(8)), lambda d, k: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)"
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda c, b: xor(c >> 8, {step})), 4294967295)"


def word_count(text: Column) -> Column:
    """Number of words; null counts as an empty text."""
    words = F.split(F.coalesce(text, F.lit("")), BLANKS)
    edge = (words[0] == "").cast("int") + ((F.size(words) > 1) & (words[F.size(words) - 1] == "")).cast("int")
    return (F.size(words) - edge).cast("long")


def encoded(text: object) -> bytes:
    """UTF-8 of a text inside a task; anything that is no string (null, NaN) is empty."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def with_text_score(docs: DataFrame, make: Callable[[], Callable[[list[object]], list[float]]], rows: int = 250) -> DataFrame:
    """docs (text, ...) plus score double. make() gives a task its function from texts to scores.

    Texts become Python objects a few rows at a time; other columns pass through as Arrow data.
    """
    docs = docs.drop("score")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                scores = pa.array(score(part.column(at).to_pylist()), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, scores], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, f"{kinds}, score double")
