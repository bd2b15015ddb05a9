"""The pipeline over ``documents``: every stage reads what its predecessor has written and keeps."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanseek.llm import decontaminate, jaccard_join, mixing, pii, toxicity
from spanseek.llm.common import table
from spanseek.session import scratch_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIX = {"good": 0.90, "poor": 0.08, "toxic": 0.02}  # what the first stage leaves has few toxic documents


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half. The labels of ``sf_dir`` train; the texts that they name are read from ``docs``."""
    model = toxicity.fit(docs, toxicity.training_marks(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model, COLUMNS).where(F.col("score") < 0.5).select(*COLUMNS)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of all documents joined by links of similarity 0.8 on five words, and of all equal ones, the one with the least doc_id stays."""
    return jaccard_join.one_of_each(docs.select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage within its edit budget leave."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind; n_chars follows where a text changes. All documents stay."""
    changed = pii.redact(docs.select(*COLUMNS, F.col("text").alias("_before")))
    size = F.when(F.col("text").eqNullSafe(F.col("_before")), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return changed.withColumn("n_chars", size.cast("long")).select(*COLUMNS)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the number of copies that the target weights give them; those with none leave."""
    rated = mixing.mixed(docs, table(spark, sf_dir, "labels"), COLUMNS, MIX)
    return rated.where(F.col("copies") > 0).select(*COLUMNS, "n_tokens", "rate", "copies")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("jaccard_join", one_of_each_class),
    ("decontaminate", drop_leaks),
    ("pii", redact_personal_data),
    ("mix", mix_domains),
]

ORACLE_SQL = None  # the stages train and align; tests/llm checks each against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        path = f"{scratch_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
