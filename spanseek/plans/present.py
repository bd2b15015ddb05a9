"""Results for people: cards, permalinks and the result log."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanseek import fixed_values as fv
from spanseek.functions import paths as px
from spanseek.functions import text as tx
from spanseek.operators.evaluate import mark_hits, metric_columns
from spanseek.session import written


def cards(hits: DataFrame, label: str, commit: str, name: str = "name") -> DataFrame:
    """Hits joined with their unit become flat rows: where the unit is, its first lines, how many are hidden, a permalink."""
    def filled(c):
        return F.when(F.col(c) != "", F.col(c))

    path, text = F.col("path"), F.col("text")
    keep = [c for c in hits.columns if c not in ("path", "kind", name, "qualname", "start_line", "end_line", "text")]
    return hits.select(
        *keep, "path", px.directory(path).alias("dir"), px.file_name(path).alias("file"), F.col("start_line").alias("start"),
        F.col("end_line").alias("end"), "kind", F.coalesce(filled("qualname"), filled(name), F.lit(fv.MODULE_LABEL)).alias("name"),
        px.card_language(path).alias("lang"), tx.first_lines(text, fv.CARD_LINES).alias("code"),
        F.greatest(F.lit(0), tx.line_count(text) - fv.CARD_LINES).alias("hidden"),
        px.permalink(F.lit(label), F.lit(commit), path, F.col("start_line"), F.col("end_line")).alias("url"))


def result_log(results: DataFrame, hits: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """One row per query with its metrics and its top hits (marked, with the first lines of each) as an array.

    ``hits`` carries the unit columns; at most ``k`` of them are gathered per query.
    """
    marked = mark_hits(hits, gold).where(F.col("rank") <= k)
    entry = F.struct("rank", F.round("score", 4).alias("score"), "hit", "path", F.col("start_line").alias("start"),
                     F.col("end_line").alias("end"), "kind", "qualname", tx.first_lines(F.col("text"), fv.LOG_LINES).alias("snippet"))
    top = marked.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("top"))
    return results.join(top, "query_id", "left")


def timed(rows: DataFrame, stages: dict[str, Callable[[DataFrame], DataFrame]], batches: int = 1,
          by: str = "query_id") -> tuple[dict[str, DataFrame], dict[str, list[float]]]:
    """Run the stages one after the other, each on what the one before has written, over ``batches`` parts of the questions.

    Returns the written rows of every stage, and for every stage the milliseconds a question of each part, in the order of the parts. A part is a
    hash class of ``by``, so all parts are about equally large; empty parts are left out.
    """
    done: dict[str, DataFrame] = {}
    took: dict[str, list[float]] = {name: [] for name in stages}
    for b in range(batches):
        part = rows if batches == 1 else rows.where(F.pmod(F.xxhash64(by), F.lit(batches)) == b)
        n = part.count()
        if not n and batches > 1:
            continue
        for name, stage in stages.items():
            began = time.perf_counter()
            part = written(stage(part))
            took[name].append((time.perf_counter() - began) * 1000 / max(n, 1))
            done[name] = done[name].unionByName(part) if name in done else part
    return done, took


def latency(took: list[float]) -> tuple[float | None, float | None, float | None]:
    """Median, 95th percentile and largest of the measured times: of an even number the upper middle, and the time at or below the 95 % place."""
    if not took:
        return None, None, None
    ordered = sorted(took)
    return ordered[len(ordered) // 2], ordered[int(0.95 * (len(ordered) - 1))], ordered[-1]


def run_header(meta: DataFrame, results: DataFrame, took: dict[str, list[float]], source: str) -> DataFrame:
    """What a result log is about, as one row: the index's metadata, where the questions are from, their number, the times of each stage (ms a question)
    and the metrics of each split, whole and by category. ``results``: split, category, first_rank, gold_at_k."""
    per_group = results.groupingSets([["split"], ["split", "category"]], "split", "category").agg(*metric_columns())
    metrics = per_group.agg(F.sort_array(F.collect_list(F.struct("split", "category", *[c for c in per_group.columns if c not in ("split", "category")]))))
    spark = results.sparkSession
    rows = [(name, *latency(ms)) for name, ms in took.items()]
    times = F.array(*[F.struct(F.lit(n).alias("stage"), F.lit(p50).cast("double").alias("p50"), F.lit(p95).cast("double").alias("p95"),
                               F.lit(most).cast("double").alias("max")) for n, p50, p95, most in rows])
    index = meta.limit(1).select(F.struct(*meta.columns).alias("index"))
    return spark.range(1).select(index.scalar().alias("index"), F.lit(source).alias("queries_file"), results.agg(F.count(F.lit(1))).scalar().alias("n"),
                                 times.alias("latency_ms"), metrics.scalar().alias("metrics"))
