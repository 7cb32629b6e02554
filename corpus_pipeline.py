"""From raw documents to token ids: filter, keep one of each near copy, redact, mix, encode.

Every stage takes all rows that its predecessor kept; all but the last return the columns of
documents. A stage's own behaviour on nulls, empty and very long texts, repeated rows and
empty tables is its operator's, stated there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm import bpe, mixing, neardup, quality, secrets
from tallyforge.llm.common import read_table, written
from tallyforge.llm.tokens import vocabulary_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept."""
    return quality.score(docs).where("__quality.kept").drop("__quality")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each near-duplicate class; of rows equal in id and text, one."""
    keys = [F.coalesce("doc_id", F.lit(0)).alias("__k"), F.col("doc_id").isNull().alias("__null")]
    kept = neardup.classes(docs).where("kept").select(*keys, F.col("th").alias("__th")).distinct()
    joined = docs.select("*", *keys, F.xxhash64("text").alias("__th")).join(kept, ["__k", "__null", "__th"], "left_semi")
    first = F.row_number().over(Window.partitionBy("__k", "__null", "__th").orderBy("__th"))
    return joined.withColumn("__n", first).where("__n = 1").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets cut out of the text; n_chars follows."""
    return secrets.redact(docs, size_col="n_chars" if "n_chars" in docs.columns else None)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate takes it."""
    return mixing.mixed(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's token count and the digests of its ids and of what they decode to."""
    return bpe.encode(docs, vocabulary_path("word_bpe_49k.json"), digest=True)


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_texts),
]

#: Shingle joins with pruning, layered decoding and BPE have no SQL form; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
