"""Reading with bad rows and files set apart instead of failing the job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqengine.functions.lineage import cut
from dqengine.sources.tables import READERS, UnreadableFile, kind_of, missing_text_to_null

RECORD = "_bad_record"
REJECTED = "file string, reason string, record string"
REPLACED = "�"
"""What stands for bytes that are no UTF-8 after decoding."""


@dataclass
class Checked:
    """The rows of a table that could be read, and (file, reason, record) of what could not: ``malformed`` records don't fit the
    schema, those with reason ``encoding`` hold bytes that are no UTF-8, and files that are ``damaged`` have no record."""

    good: DataFrame
    rejected: DataFrame


def read_checked(spark: SparkSession, path: str, schema: T.StructType | None = None) -> Checked:
    """A table by its file's suffix, without what is broken in it. Without a schema one is inferred from the readable part. A file
    whose every part is broken raises ``UnreadableFile`` when no schema can be had."""
    kind = READERS[kind_of(path)]
    return _columnar(spark, path, kind, schema) if kind in ("parquet", "orc") else _rows(spark, path, kind, schema)


def _rows(spark: SparkSession, path: str, kind: str, schema: T.StructType | None) -> Checked:
    options = {"header": True, "escape": '"', "multiLine": True, "sep": "\t" if kind_of(path) == "tsv" else ","} if kind == "csv" else {}
    if schema is None:
        found = spark.read.format(kind).options(**options, mode="DROPMALFORMED", inferSchema=True).load(path).schema
        schema = T.StructType([f for f in found if f.name != "_corrupt_record"])
        if not schema.fields:
            raise UnreadableFile(f"no record of {path} can be read")
    name = RECORD
    while name in schema.names:
        name += "_"
    read = spark.read.format(kind).options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=name).schema(T.StructType([*schema.fields, T.StructField(name, T.StringType())])).load(path)
    rows = read.select(F.struct(*[F.col(f"`{c}`") for c in schema.names]).alias("row"), F.col(f"`{name}`").alias("record"), F.col("_metadata.file_path").alias("file"))
    # Null where the record is sound. The whole row is written down, since a parser that is asked for fewer columns judges less.
    broken = F.to_json("row").contains(REPLACED)
    rows = cut(rows.withColumn("reason", F.when(F.coalesce(F.col("record"), F.lit("")).contains(REPLACED) | broken, "encoding").when(F.col("record").isNotNull(), "malformed")))
    good = rows.where("reason is null").select("row.*")
    bad = rows.where("reason is not null").select("file", "reason", F.coalesce("record", F.to_json("row")).alias("record"))
    return Checked(missing_text_to_null(good) if kind == "csv" else good, bad)


def _columnar(spark: SparkSession, path: str, kind: str, schema: T.StructType | None) -> Checked:
    """Files are sound if every page can be read: as many rows as their footer says. Footers alone answer a plain count."""
    reader = lambda: spark.read.format(kind).option("ignoreCorruptFiles", True)
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind_of(path)}").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), "length")
    if schema is None:
        try:
            schema = reader().load(path).schema
        except Exception as error:
            raise UnreadableFile(f"no file of {path} can be read: {str(error).splitlines()[0]}") from error
    table = reader().schema(schema).load(path)
    named = table.select(F.col("_metadata.file_path").alias("_file"), *[F.col(f"`{c}`") for c in schema.names])
    promised = named.groupBy(F.col("_file").alias("_p")).agg(F.count(F.lit(1)).alias("promised"))
    values = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if isinstance(schema[c].dataType, (T.MapType, T.VariantType)) else F.col(f"`{c}`") for c in schema.names])
    read = named.groupBy(F.col("_file").alias("_r")).agg(F.count(F.lit(1)).alias("read"), F.bit_xor(values).alias("_all"))
    judged = files.join(promised, F.col("file") == F.col("_p"), "left").join(read, F.col("file") == F.col("_r"), "left")
    # A file without rows is sound if it has a footer, which only its own reading can tell; such files are few and small.
    judged = cut(judged.select("file", "length", F.coalesce("promised", F.lit(0)).alias("promised"), F.coalesce("read", F.lit(0)).alias("read"), "_all"))  # else no value is read
    silent = [r.file for r in judged.where("promised = 0 and length < 1048576").limit(1000).collect()]
    sound = {f for f in silent if _has_footer(spark, kind, f)}
    bad = judged.where((F.col("promised") != F.col("read")) | (F.col("promised") == 0)).where(~F.col("file").isin(list(sound)) if sound else F.lit(True))
    bad = cut(bad.select("file", F.lit("damaged").alias("reason"), F.lit(None).cast("string").alias("record")))
    good = named.join(F.broadcast(bad.select(F.col("file").alias("_bad"))), F.col("_file") == F.col("_bad"), "left_anti").drop("_file")
    return Checked(good, bad)


def _has_footer(spark: SparkSession, kind: str, file: str) -> bool:
    try:
        spark.read.format(kind).load(file).isEmpty()
    except Exception:  # whatever is wrong with it, it is no table
        return False
    return True
