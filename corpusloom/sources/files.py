"""Text and CSV files, and saved tables and models."""

from __future__ import annotations

from pyspark.ml.util import MLReadable, MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.ordered import prefix_sum


FILE_ROWS = 1_000_000


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per text line: (file, line_no, text), line_no counted from 0 per file.

    Files are read in splits. Inside a split the reader's order is kept; the
    number of lines of the earlier splits is added, so one huge file is
    numbered without passing through one task.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("text"),
    )
    numbered = prefix_sum(raw, F.lit(1), order=["seq"], bucket="block", group=["file"], out="line_no")
    return numbered.select("file", (F.col("line_no") - 1).alias("line_no"), "text")


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ",") -> DataFrame:
    """Header CSV with an explicit schema; empty and ``NA`` are null. A quoted field may hold line breaks, so files are not split."""
    frame = spark.read.schema(schema).csv(
        path, header=True, sep=sep, nullValue="NA", quote='"', escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\n", multiLine=True,
    )
    strings = {f.name: F.nullif(F.col(f.name), F.lit("")) for f in frame.schema if isinstance(f.dataType, T.StringType)}
    return frame.withColumns(strings)


def read_csv2(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Semicolon CSV with decimal commas."""
    wanted = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    fractional = (T.DoubleType, T.FloatType, T.DecimalType)
    raw_fields = [
        T.StructField(f.name, T.StringType() if isinstance(f.dataType, fractional) else f.dataType) for f in wanted
    ]
    frame = read_csv(spark, path, T.StructType(raw_fields), sep=";")
    decimals = {
        f.name: F.regexp_replace(f.name, ",", ".").cast(f.dataType)
        for f in wanted if isinstance(f.dataType, fractional)
    }
    return frame.withColumns(decimals)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Header CSV with ``NA`` for null; files of bounded length, as they are read whole."""
    df.write.option("maxRecordsPerFile", FILE_ROWS).mode("overwrite").csv(
        path, header=True, sep=sep, nullValue="NA", quote='"', escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\n",
    )


def write_csv2(df: DataFrame, path: str) -> None:
    """Semicolon CSV with decimal commas."""
    fractional = (T.DoubleType, T.FloatType, T.DecimalType)
    texts = {
        f.name: F.regexp_replace(F.col(f.name).cast("string"), r"\.", ",")
        for f in df.schema if isinstance(f.dataType, fractional)
    }
    write_csv(df.withColumns(texts), path, sep=";")


def save_object(thing: DataFrame | MLWritable, path: str) -> None:
    """Store a table (Parquet) or a fitted model."""
    if isinstance(thing, DataFrame):
        thing.write.mode("overwrite").parquet(path)
    else:
        thing.write().overwrite().save(path)


def load_object(spark: SparkSession, path: str, kind: type[MLReadable] | None = None):
    """Load what ``save_object`` stored; ``kind`` is the model class, if any."""
    return spark.read.parquet(path) if kind is None else kind.load(path)
