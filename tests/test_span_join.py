"""The binned join of line ranges against all pairs, and its largest key."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanseek.operators import evaluate as ev
from spanseek.session import BROADCAST_BYTES, sized_join, skew_join


@pytest.mark.parametrize("lines", [1, 7, 64, 10_000])
def test_equal_to_all_pairs(spark, lines):
    rng = random.Random(lines)

    def spans(n, top):
        return [(rng.randrange(3), i, f"f{rng.randrange(2)}", (a := rng.randrange(top)), a + rng.choice([0, 3, 200, -2])) for i in range(n)]
    hits, gold = spans(60, 500), spans(90, 500)
    got = ev.span_matches(spark.createDataFrame(hits, "query_id int, rank int, path string, start_line int, end_line int"),
                          spark.createDataFrame(gold, "query_id int, gold_id int, path string, start int, end int"), lines)
    want = sorted((q, r, g) for q, r, p, a, b in hits for q2, g, p2, c, d in gold if q == q2 and p == p2 and a <= d and c <= b)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50


def test_a_file_with_very_many_ranges_makes_no_large_key(spark):
    gold = spark.range(50_000).select(F.lit(1).alias("query_id"), F.col("id").alias("gold_id"), F.lit("f").alias("path"), F.col("id").alias("start"),
                                      F.col("id").alias("end"))
    keys = ev.binned(gold, "start", "end").groupBy("query_id", "path", "bin").count()
    assert keys.agg(F.max("count")).first()[0] == ev.BIN_LINES
    hits = spark.createDataFrame([(1, 1, "f", 100, 49_000), (1, 2, "f", 49_990, 60_000)], "query_id int, rank int, path string, start_line int, end_line int")
    counts = {r.rank: r["count"] for r in ev.span_matches(hits, gold).groupBy("rank").count().collect()}
    assert counts == {1: 48_901, 2: 10}


def test_a_line_in_a_third_of_the_documents_is_spread(spark, monkeypatch):
    import spanseek.session as session

    found = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("line"))
    wanted = spark.createDataFrame([(1, "same"), (2, "same"), (3, "7")], "query_id int, line string")
    want = sorted(map(tuple, found.join(wanted, "line").collect()))
    assert sorted(map(tuple, sized_join(found, wanted, "line", "doc_id").collect())) == want
    monkeypatch.setattr(session, "estimated_bytes", lambda df: BROADCAST_BYTES + 1)
    assert sorted(map(tuple, session.sized_join(found, wanted, "line", "doc_id").collect())) == want
    assert sorted(map(tuple, skew_join(found, wanted, "line", "doc_id", hot_rows=100).collect())) == want
