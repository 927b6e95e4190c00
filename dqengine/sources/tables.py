"""Reading tables, their metadata and checks, and writing reports."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

READERS = {"csv": "csv", "tsv": "csv", "parquet": "parquet", "json": "json", "jsonl": "json", "ndjson": "json", "orc": "orc"}
MISSING_TEXT = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
"""Texts that a CSV reader takes for missing."""


class UnsupportedFile(ValueError):
    """The file's kind can't be read."""


class UnreadableFile(ValueError):
    """The file's content doesn't fit its kind, encoding or schema."""


class EmptyTable(ValueError):
    """The table has no rows or no columns."""


def kind_of(path: str) -> str:
    suffix = os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()
    if suffix in ("xlsx", "xls"):
        raise UnsupportedFile("a spreadsheet is no table of one kind: .xlsx is read by sources.workbook, .xls has to be saved as .xlsx or CSV")
    if suffix not in READERS:
        raise UnsupportedFile(f"can't read .{suffix}; known: {', '.join(READERS)}")
    return suffix


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sampling: float = 1.0, multiline: bool = True) -> DataFrame:
    """A table by its file's suffix. A given schema spares the pass that infers one. ``multiline=False`` lets a large CSV file whose
    values hold no line breaks be split over tasks."""
    suffix = kind_of(path)
    reader = spark.read.format(READERS[suffix])
    if READERS[suffix] == "csv":
        reader = reader.options(header=True, multiLine=multiline, escape='"', mode="FAILFAST", samplingRatio=sampling, sep="\t" if suffix == "tsv" else ",")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.load(path)
    return missing_text_to_null(df) if READERS[suffix] == "csv" else df


def missing_text_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~F.col(f"`{f.name}`").isin(MISSING_TEXT), F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema])


def normalize(df: DataFrame) -> DataFrame:
    """NaN to null in floating columns, so that every later count of nulls sees it."""
    return df.select(*[F.when(~F.isnan(f"`{f.name}`"), F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema])


def with_row_id(df: DataFrame, name: str = "_row_id") -> DataFrame:
    """Rows numbered in order of the scan (increasing, not dense); without a shuffle."""
    return df.withColumn(name, F.monotonically_increasing_id())


def check(df: DataFrame) -> DataFrame:
    """The table itself, if it has a column and a row."""
    if not df.columns:
        raise EmptyTable("the table has no columns")
    if readable(df).isEmpty():
        raise EmptyTable("the table has no rows")
    return df


BROKEN = ("MALFORMED", "FAILED_READ_FILE", "CANNOT_READ", "INVALID_UTF8", "BAD_RECORD", "CORRUPT")


def readable(df: DataFrame) -> DataFrame:
    """The table itself, if its first row can be read; damage further on is raised by the action that meets it."""
    try:
        df.isEmpty()
    except Exception as error:
        if any(word in str(error).upper() for word in BROKEN):
            raise UnreadableFile(str(error).splitlines()[0]) from error
        raise
    return df


def size_mb(spark: SparkSession, path: str) -> float:
    """Megabytes of a file or folder in any file system that Spark knows."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    summary = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(hadoop)
    return round(summary.getLength() / 1048576, 2)


def metadata(df: DataFrame, name: str = "table", size_mb: float = 0.0) -> DataFrame:
    """One row per column: position, name and type; with the table's name, rows and size."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)]
    columns = df.sparkSession.createDataFrame(rows, "position int, column string, type string")
    counted = df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), F.lit(float(size_mb)).alias("size_mb"))
    return columns.join(F.broadcast(counted))  # one row


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names, without the ones that are empty; of a text file only the first line is read."""
    kind = kind_of(path)
    if READERS[kind] != "csv":
        return read_table(spark, path).columns
    names = spark.read.csv(path, header=True, inferSchema=False, sep="\t" if kind == "tsv" else ",").columns
    return [c for c in (n.strip().strip('"') for n in names) if c]


def write_report(report: DataFrame, path: str, kind: str = "json", mode: str = "errorifexists") -> None:
    report.write.mode(mode).format(kind).save(path)
