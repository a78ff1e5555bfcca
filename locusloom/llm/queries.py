"""The thin queries over the driver's tables: each applies one operator, with its usual parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusloom.llm import fixity, katz, language_crf, lattice, line_minhash, line_quality, mixing, partenum, pieces, toxicity_kn
from locusloom.llm.common import fold, table


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    field = line_quality.fit(documents, table(spark, sf_dir, "labels"))
    return line_quality.score_documents(documents, field, keep=["doc_id"])


def op2_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 3) == 1)
    field = language_crf.fit(documents, among=~F.col("held_out"))
    return language_crf.label_documents(documents, field, keep=["doc_id", "held_out"])


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.audit(table(spark, sf_dir, "documents"), pieces.Encoder(pieces.read_vocabulary()))


def op4_toxicity_kn(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 5) == 0)
    model = toxicity_kn.fit(documents, table(spark, sf_dir, "labels"), among=fold(F.col("doc_id"), 5) != 0)
    return toxicity_kn.score_documents(documents, model, keep=["doc_id", "held_out"]).select("doc_id", "held_out", "score", "predicted")


def op5_line_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_minhash.deduplicate(table(spark, sf_dir, "documents"))


def op6_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = fixity.audit(fixity.plant(fixity.manifest(pages), fixity.manifest(fixity.damaged(pages))))
    return found.select(F.col("key").alias("page_id"), "url", "status", *[f"{c}_{side}" for c in ("offset", "length", "copies", "digest") for side in "ab"])


def op7_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    marked = mixing.apply_plan(documents, mixing.plan(documents, mixing.repeating))
    return marked.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 10) == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_quality": op1_line_quality,
    "op2_language_crf": op2_language_crf,
    "op3_pieces": op3_pieces,
    "op4_toxicity_kn": op4_toxicity_kn,
    "op5_line_minhash": op5_line_minhash,
    "op6_fixity": op6_fixity,
    "op7_lattice": op7_lattice,
    "op8_partenum": op8_partenum,
    "op9_mixing": op9_mixing,
    "op10_katz": op10_katz,
}

#: Queries that SQL can express; the others are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {"op6_fixity": fixity.SQL, "op8_partenum": partenum.SQL, "op9_mixing": mixing.SQL}
