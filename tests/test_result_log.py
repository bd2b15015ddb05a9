"""Timed stages and the row about a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanseek.plans.present import latency, run_header, timed


def test_latency_takes_the_positions_of_the_log():
    assert latency([5.0, 1.0, 3.0, 2.0]) == (3.0, 3.0, 5.0) and latency([7.0]) == (7.0, 7.0, 7.0) and latency([]) == (None, None, None)


def test_stages_are_timed_part_by_part(spark):
    q = spark.range(20).select(F.col("id").alias("query_id"))
    done, took = timed(q, {"encode": lambda d: d.withColumn("x", F.col("query_id") * 2), "search": lambda d: d.where("x > 10").select("x")}, batches=3)
    assert sorted(r.x for r in done["search"].collect()) == list(range(12, 40, 2)) and done["encode"].count() == 20
    assert [len(v) for v in took.values()] == [3, 3] and all(t > 0 for v in took.values() for t in v)
    nothing, none = timed(q.limit(0), {"encode": lambda d: d}, batches=1)
    assert nothing["encode"].count() == 0 and len(none["encode"]) == 1


def test_the_header_names_index_times_and_metrics(spark):
    meta = spark.createDataFrame([("kitchen", 7)], "repo string, n_units long")
    results = spark.createDataFrame([("dev", "exact", 1, 1.0), ("dev", "vague", None, 0.0), ("holdout", "exact", 4, 0.5)],
                                    "split string, category string, first_rank int, gold_at_k double")
    row = run_header(meta, results, {"encode": [2.0, 4.0], "search": []}, "q.json").first()
    assert (row["index"].repo, row["index"].n_units, row.queries_file, row.n) == ("kitchen", 7, "q.json", 3)
    assert [tuple(t) for t in row.latency_ms] == [("encode", 4.0, 2.0, 4.0), ("search", None, None, None)]
    found = {(m.split, m.category): (m.n, m.mrr_at_10) for m in row.metrics}
    assert found == {("dev", None): (2, 0.5), ("dev", "exact"): (1, 1.0), ("dev", "vague"): (1, 0.0), ("holdout", None): (1, 0.25), ("holdout", "exact"): (1, 0.25)}
