"""A training corpus from raw documents, in five stages.

Each stage is a function of (spark, docs, sf_dir). run() writes each one's result as Parquet into the shared checkpoint folder
and gives it, read again, to the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusloom.llm import line_minhash, line_quality, mixing, partenum, pieces
from locusloom.llm.common import shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the share of content lines reject."""
    field = line_quality.fit(docs, table(spark, sf_dir, "labels"))
    # Under other names, no column of the documents is taken for one of the operator's.
    own = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    marked = line_quality.score_documents(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()]), field, text=own["text"])
    return marked.where("kept").select(*[F.col(n).alias(c) for c, n in own.items()])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are fuzzy copies of earlier ones; n_chars is counted anew."""
    out = line_minhash.without_copies(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of similar ones; documents without a doc_id stay."""
    copies = partenum.classes(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_copy")).distinct()
    return docs.join(copies, F.col("doc_id") == F.col("_copy"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document."""
    encoder = pieces.Encoder(pieces.read_vocabulary())
    return pieces.encode(docs, encoder, keep=["doc_id", "lang", "source"]).withColumn("n_pieces", F.when(F.col("ids").isNull(), F.lit(0)).otherwise(F.size("ids")))


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", join), ("source mixing", mix), ("piece encoding", encode)]

#: SQL can't express the conditional random field; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/corpus-{uuid.uuid4()}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:  # a stage's result has been read by the next one
            _delete(spark, f"{folder}/{k - 1}")
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
