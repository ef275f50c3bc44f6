"""The corpus pipeline: quality rules, near duplicates, decontamination, pseudonyms, packing.

Each stage works on all that the one before it kept, from what that one wrote. The first
four return the columns of documents; the last returns the packed pieces.

Null texts have no words, so the first stage rejects them, as it does empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import decontam, packing, pii, repetition, superminhash
from cloakframe.llm.common import free_prefix, new_path
from cloakframe.llm.queries import PACKED, PII_KEY, first_line, word_tokenizer


def own(docs: DataFrame) -> list:
    """The columns that docs has."""
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go; the verdict is each row's own. Null and empty texts are rejected."""
    p = free_prefix(docs)
    return repetition.annotate(docs, prefix=p).where(repetition.verdicts(prefix=p)[1]).select(*own(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id; of rows with equal ids and texts, one.

    Texts are near duplicates from a Jaccard similarity of 0.85 on, as in op5, for which the 20
    bands of 5 rows are sized; pairs from 0.80 to below 0.85 both stay. Rows with one id and
    different texts are different documents. Rows without an id, and texts without words, stay.
    """
    p = free_prefix(docs)
    gone = superminhash.classified(docs).where("not stays").select(
        F.col("doc_id").alias(p + "id"),
        F.col("text_hash").alias(p + "gone"),
    ).distinct()
    keyed = docs.withColumn(p + "hash", superminhash.text_hash("text"))
    left = keyed.join(gone, (F.col("doc_id") == F.col(p + "id")) & (F.col(p + "hash") == F.col(p + "gone")), "left_anti")
    return left.where("doc_id is not null").dropDuplicates(["doc_id", p + "hash"]).union(left.where("doc_id is null")).select(*own(docs))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word inside a benchmark window go. Null and empty texts have no words and stay; so does everything if the benchmark is empty."""
    benchmark, p = spark.read.parquet(f"{sf_dir}/benchmark.parquet"), free_prefix(docs)
    return decontam.annotate(docs, benchmark, prefix=p).where(F.size(p + "runs") == 0).select(*own(docs))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses in texts are replaced by their pseudonyms; n_chars follows, where there is such a column. Null texts stay null."""
    out = pii.pseudonymize(docs, PII_KEY, found_col=free_prefix(docs) + "pii").select(*own(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, with their ids; a first line of several bears no loss.

    Null texts are the end id alone; an empty table gives no rows. Workers live on between
    stages, so their word tables are small here.
    """
    return packing.pack(docs, word_tokenizer(), PACKED, prompt=first_line("text"), table_words=200_000)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("pii", pseudonyms),
    ("packing", packed),
]

#: Encoding and packing can't be expressed in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
