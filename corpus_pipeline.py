"""From raw documents to packed sequences: five stages, each written and read again.

Every stage takes null, empty and very long texts, null and repeated ids, repeated rows, empty tables and extra columns
of any name; what becomes of them is stated at the stage, or else with its operator:

* toxicity: a null or empty text, or one without a letter, is not toxic and stays; each row is judged by its own text.
* line dedup: a null text stays null; rows that agree in id and text are one text and lose the same lines.
* simhash: null and empty texts are near copies of each other; of the rows with one id those stay whose own group's
  least id is that id; rows that agree in id and text are not told apart and stay or go together.
* decontamination: texts without a word hold no item and stay; each row is judged by its own text.
* packing: a null or empty text is the end token alone; each row is packed, repeated ones too.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontam, linededup, packing, simhash, toxicity
from millrace.llm._store import written
from millrace.llm.queries import toxicity_model
from millrace.session import ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, scores at 0.5 or more go."""
    ship_package(spark)
    return toxicity.clean(docs, toxicity_model(spark, docs, sf_dir))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the runs of lines that stand earlier; n_chars follows. Documents stay, even where nothing is left of them."""
    ship_package(spark)
    found = linededup.dedup(docs)
    row = F.col("row")
    changed = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_runs") > 0, F.length("kept")).otherwise(row.getField("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[changed.get(c, row.getField(c)).alias(c) for c in docs.columns])


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id stays. Rows that repeat an id and text are one document."""
    ship_package(spark)
    return simhash.least_of_groups(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's shingles go."""
    ship_package(spark)
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    ship_package(spark)
    found = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)
    return found.select(
        F.col("id").alias("doc_id"), "piece", "start", F.col("length").cast("long").alias("length"), F.col("crc32").alias("ids_crc32"), F.col("sequence").alias("sequence_id"), "offset"
    )


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("simhash", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: SQL has neither the classifier nor the packing's search; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
