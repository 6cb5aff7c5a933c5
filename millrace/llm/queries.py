"""The operators applied to the test tables, with the columns that are compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import covertree, decontam, langid, license, linededup, packing, pii, simhash, sql, suffixdedup, toxicity


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _remainder(of: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % of


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    parser = langid.fit(docs.where(_remainder(3) != 1))
    found = langid.predict(docs, parser)
    return found.withColumnRenamed("id", "doc_id").select("doc_id", (_remainder(3) == 1).alias("held_out"), F.col("lang").alias("lang_pred"), "score", "phrases")


def op2_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup(_docs(spark, sf_dir))
    return found.select("row.doc_id", "n_lines", "n_removed", "n_runs", F.md5(F.coalesce("kept", F.lit("")).cast("binary")).alias("kept_md5"))


def op3_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.dedup(_docs(spark, sf_dir)).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_docs(spark, sf_dir))
    counts = [pii.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS]
    digest = F.sha2(pii.joined(F.col("base")).cast("binary"), 256)
    return found.select(F.col("id").alias("doc_id"), *counts, digest.alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)
    return packed.select(
        F.col("id").alias("doc_id"), "piece", "start", F.col("length").cast("long").alias("length"), F.col("crc32").alias("ids_crc32"), F.col("sequence").alias("sequence_id"), "offset"
    )


def op6_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = covertree.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cos_min=0.95)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_shingles", "n_shared", "containment")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(_docs(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model | None:
    """Trained on labelled rows outside the held-out fold; which ones is decided on the narrow table first."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(_remainder(5) != 0)
    chosen = labels.where("toxic is not null and doc_id is not null").select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(toxicity.TRAIN_ROWS)
    return toxicity.fit(docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    found = toxicity.score(docs, toxicity_model(spark, docs, sf_dir)).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(_docs(spark, sf_dir)).withColumnRenamed("id", "doc_id").drop("matches")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_linededup": op2_linededup,
    "op3_suffixdedup": op3_suffixdedup,
    "op4_pii": op4_pii,
    "op5_packing": op5_packing,
    "op6_covertree": op6_covertree,
    "op7_decontam": op7_decontam,
    "op8_simhash": op8_simhash,
    "op9_toxicity": op9_toxicity,
    "op10_license": op10_license,
}

#: DuckDB's equivalents, where SQL can express them.
ORACLE_SQL: dict[str, str] = {
    "op2_linededup": sql.OP2,
    "op3_suffixdedup": sql.OP3,
    "op6_covertree": sql.OP6,
    "op7_decontam": sql.OP7,
}
