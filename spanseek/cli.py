"""Entry points for spark-submit: index, report, search, evaluate, ablate, two-stage and grid over stored indexes.

    spark-submit spanseek/cli.py index --root /shared/checkout --out /shared/index --cache /shared/cache
    spark-submit spanseek/cli.py search --index /shared/index --question "where are retries counted" --question "which test covers it"
    spark-submit spanseek/cli.py evaluate --index /shared/index --labels /shared/queries.json --out /shared/report
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from spanseek import fixed_values as fv  # noqa: E402
from spanseek.encoders import HashingEncoder, TransformerEncoder, encoder_of_index  # noqa: E402
from spanseek.models import CODE_MODEL, TEXT_MODEL  # noqa: E402
from spanseek.operators import evaluate as ev  # noqa: E402
from spanseek.operators import report  # noqa: E402
from spanseek.operators.units import decoded, outlines, split_units  # noqa: E402
from spanseek.plans import experiments as ex  # noqa: E402
from spanseek.plans.index_build import build_pair, vectors_for  # noqa: E402
from spanseek.plans.present import cards, result_log, run_header, timed  # noqa: E402
from spanseek.plans.search import fusion_search, rescored, retrieve  # noqa: E402
from spanseek.session import ship, written  # noqa: E402
from spanseek.sources.code_tree import source_files  # noqa: E402
from spanseek.sources.labels import commit_mismatches, label_files, labelled_queries  # noqa: E402
from spanseek.sources.store import StoredIndex, VectorCache  # noqa: E402


def encoders(kind: str):
    if kind == "hashing":
        return HashingEncoder(64, "a"), HashingEncoder(96, "b")
    return TransformerEncoder(TEXT_MODEL), TransformerEncoder(CODE_MODEL)


def index(spark: SparkSession, a) -> None:
    caches = tuple(VectorCache(spark, f"{a.cache}/{m}") for m in "ab") if a.cache else (None, None)
    pair = build_pair(spark, a.root, *encoders(a.encoder), caches, max_chars=a.max_chars, min_chars=a.min_chars)
    for name, one in zip("ab", pair):
        one.save(f"{a.out}/{name}")
        one.meta.show(truncate=False, vertical=True)


def split_report(spark: SparkSession, a) -> int:
    files = decoded(source_files(spark, a.root))
    read = written(outlines(files, a.max_chars))
    units = written(split_units(read, a.max_chars))
    coverage = written(report.line_coverage(files, units))
    bad = report.broken_spans(files, units).count()
    for frame in (report.files_by_language(units), report.count_by(units, "kind"), report.sizes(units), report.total_coverage(coverage),
                  read.agg(F.count_if("had_error").alias("files_with_errors")), report.copied_texts(units).agg(F.count("*").alias("copied_texts")),
                  report.lowest_coverage(coverage), report.largest_units(units).select("chars", "kind", "qualname", "path"),
                  report.sample_units(units).select("kind", "qualname", "path", "start_line")):
        frame.show(truncate=60)
    if a.out:
        units.write.mode("overwrite").json(a.out)
    return 1 if bad else 0


def _opened(spark: SparkSession, a) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    one, two = StoredIndex.load(spark, f"{a.index}/a"), StoredIndex.load(spark, f"{a.index}/b")
    q = written(_embedded(_labelled(spark, a, one), one, two))
    return q, one.units, vectors_for(one.units, two.units), ev.gold_rows(q)


def _labelled(spark: SparkSession, a, index: StoredIndex) -> DataFrame:
    files = label_files(spark, a.labels)
    for row in commit_mismatches(files, index.meta).collect():  # one row per label file
        print(f"labels were made at {row.labelled}, not at the indexed commit", file=sys.stderr)
    return labelled_queries(files, a.split)


def _embedded(q: DataFrame, one: StoredIndex, two: StoredIndex) -> DataFrame:
    """Questions with the vectors of both models, as the indexes name them."""
    first, second = (encoder_of_index(i.meta.first()) for i in (one, two))
    return q.withColumn("vector", first.embed(F.col("query"), "query")).withColumn("vector_b", second.embed(F.col("query"), "query"))


def search(spark: SparkSession, a) -> None:
    one, two = StoredIndex.load(spark, f"{a.index}/a"), StoredIndex.load(spark, f"{a.index}/b")
    q = spark.createDataFrame(list(enumerate(a.question)), "query_id long, query string")
    hits = fusion_search(_embedded(q, one, two), one.units, vectors_for(one.units, two.units), a.top, mode=a.tests)
    meta = one.meta.first()
    spans = one.units.select("unit_id", "path", "kind", F.col("name").alias("unit_name"), "qualname", "start_line", "end_line", "text")
    found = cards(hits.join(spans, "unit_id"), meta["repo"], meta["commit"], name="unit_name")
    if a.out:
        found.write.mode("overwrite").json(a.out)
    else:
        found.orderBy("query_id", "rank").select("query_id", "rank", "score", "path", "start", "end", "name").show(len(a.question) * a.top, truncate=80)


def evaluate(spark: SparkSession, a) -> None:
    """The result log goes to ``--out``, and one row about the run (index, times, metrics) beside it."""
    one, two = StoredIndex.load(spark, f"{a.index}/a"), StoredIndex.load(spark, f"{a.index}/b")
    units, vectors_b = one.units, written(vectors_for(one.units, two.units))
    done, took = timed(_labelled(spark, a, one), {
        "encode": lambda q: _embedded(q, one, two),
        "search": lambda q: fusion_search(q.select("query_id", "query", "vector", "vector_b"), units, vectors_b)}, a.batches)
    q, hits = done["encode"], done["search"]
    gold = ev.gold_rows(q)
    spans = units.select("unit_id", "path", "start_line", "end_line", "kind", "qualname", "text").join(hits, "unit_id")
    results = written(ev.query_results(q.drop("vector", "vector_b"), spans, gold))
    ev.rounded(ev.summary(results, ("category", "split"))).show(50)
    if a.out:
        result_log(results, spans, gold).write.mode("overwrite").json(a.out)
        run_header(one.meta, results, took, a.labels).write.mode("overwrite").json(f"{a.out.rstrip('/')}.run")


def compare(spark: SparkSession, a) -> None:
    q, units, vectors_b, gold = _opened(spark, a)
    asked = q.select("query_id", "query", "vector", "vector_b")
    if a.command == "ablate":
        hits, baseline = ex.ablation(asked, units), "dense"
    elif a.command == "two-stage":
        hits, baseline = ex.two_stage_systems(asked, units, vectors_b), "single"
    else:
        rows = rescored(retrieve(asked, units, depth=max(fv.GRID_POOLS)), units, vectors_b)
        hits, baseline = ex.fusion_grid(rows).withColumn("system", F.format_string("%02d N=%d beta=%.1f gamma=%.2f", "setting", "n", "beta", "gamma")), None
    hits = written(hits)
    ranks = written(ex.system_ranks(hits, q.select("query_id", "split", "category"), gold, units))
    ev.rounded(ranks.groupBy("system").agg(*ev.metric_columns()).orderBy("system")).show(50, truncate=False)
    if baseline:
        ev.better_worse(ranks.select("system", "query_id", "first_rank"), ranks.where(F.col("system") == baseline), by=("system",)).orderBy("system").show()
    if a.out:
        ranks.write.mode("overwrite").json(a.out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=["index", "report", "search", "evaluate", "ablate", "two-stage", "grid"])
    for name in ("root", "out", "cache", "index", "labels"):
        p.add_argument(f"--{name}")
    p.add_argument("--encoder", choices=["hashing", "transformer"], default="transformer", help="for index; the others follow the index")
    p.add_argument("--split", choices=["all", "dev", "holdout"], default="all")
    p.add_argument("--max-chars", type=int, default=fv.MAX_CHARS)
    p.add_argument("--min-chars", type=int, default=fv.INDEX_MIN_CHARS)
    p.add_argument("--batches", type=int, default=1, help="for evaluate: parts of the questions that are timed one by one")
    p.add_argument("--question", action="append", default=[], help="for search; may be given several times")
    p.add_argument("--top", type=int, default=fv.TOP_K)
    p.add_argument("--tests", choices=list(fv.SCOPE_MODES), default="auto")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"spanseek-{a.command}").getOrCreate()
    ship(spark)
    run = {"index": index, "report": split_report, "search": search, "evaluate": evaluate}.get(a.command, compare)
    return run(spark, a) or 0


if __name__ == "__main__":
    sys.exit(main())
