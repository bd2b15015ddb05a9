"""What came out of splitting a corpus: sizes, kinds, coverage, copies and broken invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanseek.functions import text as tx
from spanseek.operators.order_stats import clipped_position, order_statistics


def sizes(units: DataFrame) -> DataFrame:
    """One row: units, pieces, p50, p95, max and mean characters, approximate tokens (characters / 4)."""
    sized = units.select(F.length("text").alias("chars"), "part")
    n = F.col("n")
    quantiles = order_statistics(sized, "chars", {"p50": clipped_position(0.5, n), "p95": clipped_position(0.95, n)})
    whole = sized.agg(F.count(F.lit(1)).alias("units"), F.count_if(F.col("part") > 0).alias("pieces"),
                      F.coalesce(F.max("chars"), F.lit(0)).alias("max_chars"),
                      F.coalesce(F.avg("chars"), F.lit(0.0)).alias("mean_chars"),
                      (F.coalesce(F.sum("chars"), F.lit(0)) / 4).alias("approx_tokens"))
    p = {c: F.coalesce(quantiles.select(c).scalar(), F.lit(0)).alias(c) for c in ("p50", "p95")}
    return whole.select("units", "pieces", p["p50"], p["p95"], "max_chars", "mean_chars", "approx_tokens")


def count_by(units: DataFrame, column: str) -> DataFrame:
    return units.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def file_key(rows: DataFrame) -> list[str]:
    """Columns that name a file: with several checkouts, the root too."""
    return [c for c in ("root", "path") if c in rows.columns]


def files_by_language(units: DataFrame) -> DataFrame:
    return units.select("language", *file_key(units)).distinct().groupBy("language").agg(F.count(F.lit(1)).alias("files"))


def copied_texts(units: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """Texts found under more than one path: (text_sha, first_path, last_path, copies). Only hashes and paths move."""
    return (units.select(F.sha2(F.col(text), 256).alias("text_sha"), F.col(path).alias("_p")).groupBy("text_sha")
            .agg(F.min("_p").alias("first_path"), F.max("_p").alias("last_path"), F.count(F.lit(1)).alias("copies"))
            .where(F.col("first_path") != F.col("last_path")))


def line_coverage(files: DataFrame, units: DataFrame) -> DataFrame:
    """Per file: non-blank lines, how many of them lie in a unit, and the share. Files without units count as uncovered.

    The spans of one file meet its lines in one row; both are bounded by the file size limit.
    """
    key = [c for c in file_key(files) if c in units.columns]
    spans = units.groupBy(*key).agg(F.collect_list(F.struct(F.col("start_line").alias("s"), F.col("end_line").alias("e"))).alias("spans"))
    lines = F.split(F.col("text"), "\n")
    numbered = F.transform(lines, lambda line, i: F.struct((i + 1).alias("n"), tx.is_blank(line).alias("blank")))
    filled = F.filter(numbered, lambda x: ~x["blank"])
    covered = F.size(F.array_intersect(
        F.transform("filled", lambda x: x["n"]),
        F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["s"], s["e"]))))))
    return (files.select(*key, F.transform(filled, lambda x: F.struct(x["n"].alias("n"))).alias("filled"))
            .join(spans, key, "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<s:int,e:int>>")))
            .select(*key, F.size("filled").alias("non_blank"), covered.alias("covered"))
            .withColumn("share", F.when(F.col("non_blank") > 0, F.col("covered") / F.col("non_blank"))))


def total_coverage(per_file: DataFrame) -> DataFrame:
    return per_file.agg(F.sum("non_blank").alias("lines"), F.sum("covered").alias("covered"),
                        (100 * F.sum("covered") / F.greatest(F.sum("non_blank"), F.lit(1))).alias("percent"))


def lowest_coverage(per_file: DataFrame, n: int = 5, min_lines: int = 20) -> DataFrame:
    return per_file.where(F.col("non_blank") >= min_lines).orderBy("share", "path").limit(n)


def largest_units(units: DataFrame, n: int = 5) -> DataFrame:
    return units.withColumn("chars", F.length("text")).orderBy(F.desc("chars"), "path", "start_line", "part").limit(n)


def sample_units(units: DataFrame, n: int = 5, seed: int = 7) -> DataFrame:
    """A fixed pseudo-random handful: smallest hashes win, whatever the partitioning."""
    return units.orderBy(F.xxhash64(F.lit(seed), "path", "start_line", "end_line", "part"), "path", "start_line").limit(n)


def broken_spans(files: DataFrame, units: DataFrame) -> DataFrame:
    """Units whose text is not exactly the lines of their span."""
    lines = F.split(F.col("_file"), "\n")
    expected = F.array_join(F.slice(lines, F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    key = [c for c in file_key(files) if c in units.columns]
    return units.join(files.select(*key, F.col("text").alias("_file")), key).where(F.col("text") != expected).drop("_file")
