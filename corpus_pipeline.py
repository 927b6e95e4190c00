"""From raw documents to training tokens in five stages, each one operator of the training-data subpackage.

Every stage gets the documents that its predecessor kept and returns their columns; the last returns tokens. Columns beyond the
known ones travel along in a struct, so their names can't clash with the operators' own. Stages take null ids, texts and sources, empty
and very long texts, repeated rows and empty tables; what becomes of them is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dqengine.llm import bpe, minhash, mixing, substring_index, toxicity
from dqengine.llm.common import materialize, table

ROW = "_dq_row"


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and source, and all columns but the text in one struct."""
    return docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias(ROW))


def _unpacked(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    def value(c: str) -> Column:
        return changed[c] if c in changed else F.col("text") if c == "text" else F.col(ROW).getField(c)

    return rows.select(*[value(c).alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from labels of documents that are not held out. Null and empty texts
    score as texts without words; equal texts score alike, so repeated rows stay or go together. Without labels all stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(_packed(docs), model, keep=["text", ROW])
    return _unpacked(scored.where("predicted = 0"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of least id: five-word shingles, similarity 0.8. Null and empty texts
    are like nothing and stay. Of repeated ids the first row by text stays, of equal rows one; null ids come last."""
    found = minhash.near_duplicates(_packed(docs), shingle=5, percent=80, keep=["text", ROW])
    return _unpacked(found.where("kept"), docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that stand anywhere else too go from the text; texts that lose nothing, null and empty ones among them,
    stay as they are. Equal rows repeat each other: both lose their passages. The documents come as one batch."""
    found = substring_index.dedup(_packed(docs), keep=["text", ROW], batches=1)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(ROW).getField("n_chars"))
    return _unpacked(found, docs.columns, **changed)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice. Null and empty texts have no words and are not taken; a
    null source is a source; equal rows are documents of their own."""
    mixed = mixing.mix(_packed(docs), keep=["text", ROW])
    copies = mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return _unpacked(copies, docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token ids of every row, repeated ones too; null and empty texts have no tokens."""
    tokens = bpe.encode(docs, bpe.ranks_path())
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("byte_bpe", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
