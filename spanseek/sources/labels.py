"""Labelled question files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanseek.schemas import LABEL_FILE


def label_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per label file (JSON), with its questions nested."""
    return spark.read.schema(LABEL_FILE).option("multiLine", True).json(path)


def labelled_queries(files: DataFrame, split: str = "all") -> DataFrame:
    """(repo, commit, query_id, split, category, query, gold) of the chosen split."""
    if split not in ("all", "dev", "holdout"):
        raise ValueError(f"split must be all, dev or holdout, got {split!r}")
    rows = files.select("repo", "commit", F.explode("queries").alias("q")).select(
        "repo", "commit", F.xxhash64("repo", "q.id").alias("query_id"), F.col("q.id").alias("label_id"), "q.split", "q.category",
        "q.query", "q.gold")
    return rows if split == "all" else rows.where(F.col("split") == split)


def commit_mismatches(files: DataFrame, meta: DataFrame) -> DataFrame:
    """Label files whose commit is not the one that was indexed: labelled, indexed."""
    indexed = meta.select("commit").distinct()
    return files.select(F.col("commit").alias("labelled")).join(indexed, F.col("labelled") == F.col("commit"), "left_anti")
