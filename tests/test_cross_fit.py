"""Weights fitted on one corpus and tested on another."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from spanseek.catalogue import corpus as c
from spanseek.plans import experiments as ex
from spanseek.plans.search import searchable


def test_acceptance_needs_both_metrics_and_ignores_the_last_digits(spark):
    base = spark.createDataFrame([(0.5, 0.8)], "mrr_at_10 double, recall_at_10 double")
    tried = spark.createDataFrame([(1, 0.5 - 1e-13, 0.8), (2, 0.6, 0.7), (3, 0.4, 0.9), (4, 0.6, 0.9)], "setting int, mrr_at_10 double, recall_at_10 double")
    assert {r.setting for r in ex.accepted(tried, base).where("accepted").collect()} == {1, 4}


def test_fits_agree_within_one_grid_step(spark):
    schema = "pool int, beta double, gamma double"
    left = spark.createDataFrame([(10, 0.5, 0.0), (20, 0.5, 0.25), (50, 0.7, 0.0)], schema)
    right = spark.createDataFrame([(10, 0.7, 0.25), (20, 1.0, 0.25), (50, 0.7, 0.5)], schema)
    assert {r.pool: r.stable for r in ex.stable(left, right).collect()} == {10: True, 20: False, 50: False}


def corpus(spark, name, texts, labelled=True):
    rows = [(i, f"lib/{name}{i}.py", "", t) for i, t in enumerate(texts)]
    units = searchable(spark.createDataFrame(rows, "unit_id long, path string, qualname string, text string"))
    units = units.withColumn("vector", c.MODEL_A.embed(F.col("text"), "document")).withColumn("vector_b", c.MODEL_B.embed(F.col("text"), "document"))
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id long, query string")
    asked = asked.withColumn("vector", c.MODEL_A.embed(F.col("query"), "query")).withColumn("vector_b", c.MODEL_B.embed(F.col("query"), "query"))
    relevant = asked.select("query_id", F.col("query_id").alias("unit_id")).where(F.lit(labelled))
    return ex.LabelledCorpus(name, asked, units, relevant)


def test_both_directions_and_a_side_without_labels(spark):
    left = corpus(spark, "a", ["the oldest tide came in", "another green kettle boiled", "no one heard the bell", "stones on the shore"])
    right = corpus(spark, "b", ["rivers run north here", "a letter was sent at noon", "she counted ten candles"])
    rows = ex.cross_fit(left, right).collect()
    assert {(r.fit, r.test, r.pool) for r in rows} == {(x, y, n) for x, y in (("a", "b"), ("b", "a")) for n in (10, 20, 50)}
    for r in rows:  # every text is its own best match, so nothing can change and the first of the equal settings is chosen
        assert (r.mrr_at_10, r.alone_mrr_at_10, r.staged_mrr_at_10, r.better, r.worse, r.accepted, r.stable) == (1.0, 1.0, 1.0, 0, 0, True, True)
        assert (r.beta, r.gamma, r.n) == (0.5, 0.0, 3 if r.test == "b" else 4)
    assert ex.cross_fit(left, corpus(spark, "b", ["rivers run north here"], labelled=False)).count() == 0


def test_benchmark_systems_keep_whole_orders_and_re_order_heads(spark):
    """Against the same systems spelled out over full lists: gated and ungated questions, ties, and texts without vectors."""
    import numpy as np

    rng = np.random.default_rng(7)
    words = ["tide", "kettle", "bell", "stone", "open_valve", "river"]
    texts = [" ".join(rng.choice(words, 6)) for _ in range(70)] + [None, "open_valve"]
    vectors = np.round(rng.random((72, 4)), 2).astype("float32")
    units = spark.createDataFrame([(i, t, vectors[i].tolist(), vectors[71 - i][::-1].tolist()) for i, t in enumerate(texts)],
                                  "unit_id long, doc string, vector array<float>, vector_b array<float>")
    asked = np.round(rng.random((4, 8)), 2).astype("float32")
    q = spark.createDataFrame([(i, "where is open_valve set" if i < 2 else "a kettle", asked[i, :4].tolist(), asked[i, 4:].tolist()) for i in range(4)],
                              "query_id long, query string, vector array<float>, vector_b array<float>")
    found = ex.benchmark_systems(q, units, depth=60)
    got = {}
    for r in found.collect():
        got.setdefault((r.system, r.query_id), {})[r["rank"]] = r.unit_id
    got = {k: [v[i] for i in range(1, len(v) + 1)] for k, v in got.items()}
    assert len(got) == 36 and all(len(v) == 60 for v in got.values())
    bm25 = {(r.query_id, r.unit_id): r.bm25 for r in ex.lexical_run(q, units.withColumn("is_test", F.lit(False))).scores().collect()}

    def scaled(x):
        return [(v - min(x)) / (max(x) - min(x)) if max(x) - min(x) > 1e-9 else 0.0 for v in x]

    for i in range(4):
        cos = [np.round(np.array([sum(float(x) * float(y) for x, y in zip(v, asked[i, s])) for v in m]), 12) for m, s in (
            (vectors, slice(0, 4)), (vectors[::-1, ::-1], slice(4, 8)))]
        dense = [sorted(range(72), key=lambda u: (-c[u], u))[:60] for c in cos]
        lex = sorted((u for (query, u) in bm25 if query == i), key=lambda u: (-bm25[i, u], u))
        assert bool(lex) == (i < 2)

        def laned(order):
            if not lex:
                return order
            rrf = {u: sum(1 / (60 + x.index(u) + 1) for x in (order, lex) if u in x) for u in {*order, *lex}}
            return sorted(rrf, key=lambda u: (-rrf[u], u))[:60]

        def head(order, n, score):
            return sorted(order[:n], key=lambda u: (-score[u], order.index(u))) + order[n:]

        lane = laned(dense[0])
        assert [got["a", i], got["b", i], got["a+bm25", i], got["b+bm25", i]] == [*dense, lane, laned(dense[1])]
        assert got["two-stage", i] == head(dense[0], 10, cos[1]) and got["two-stage+bm25", i] == head(lane, 10, cos[1])
        for n in (10, 50):
            b, a, x = (scaled([f(u) for u in lane[:n]]) for f in (cos[1].__getitem__, cos[0].__getitem__, lambda u: bm25.get((i, u), 0.0)))
            g = 0.25 if lex else 0.0
            blend = {u: round((1 - g) * (0.7 * b[j] + (1 - 0.7) * a[j]) + g * x[j], 9) for j, u in enumerate(lane[:n])}
            assert got[f"fusion N={n}", i] == head(lane, n, blend)
    relevant = spark.createDataFrame([(0, 71), (2, 5)], "query_id long, unit_id long")
    ranks = ex.benchmark_ranks(found, relevant)
    assert {(r.system, r.query_id): r.first_rank for r in ranks.collect()} == {
        (s, i): got[s, i].index(u) + 1 if u in got[s, i] else None for s, i in got for i, u in ((0, 71), (2, 5))}
    plan = ranks._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"rank#\d+ > 10\)", plan) and re.search(r"rank#\d+ > 50\)", plan)  # what keeps its place is not sorted again for each system
    assert "rightHint=(strategy=broadcast)" in plan  # the lists of all systems meet their relevant documents before they move


def test_the_grid_multiplies_rows_after_they_have_moved(spark):
    rows = spark.createDataFrame([(q, u, u + 1, 1.0 / (u + 1), (u * 7 % 50) / 50, float(u % 3), q == 1, "unused") for q in range(3) for u in range(50)],
                                 "query_id long, unit_id long, pool_rank int, cos_a double, cos_b double, bm25 double, gated boolean, note string")
    top = ex.fusion_grid(rows)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate explode") < plan.index("Exchange")  # plans are printed from the last step to the first
    got = {}
    for r in top.collect():
        got.setdefault((r.setting, r.query_id), {})[r["rank"]] = r.unit_id
    assert len(got) == 81 and all(sorted(v) == list(range(1, 11)) for v in got.values())
    i, n, b, g = next(s for s in ex.grid_settings() if s[1:] == (20, 0.7, 0.5))
    low = [(u * 7 % 50) / 50 for u in range(20)]
    scaled = [[(x - min(v)) / (max(v) - min(v)) for x in v] for v in (low, [1 / (u + 1) for u in range(20)], [float(u % 3) for u in range(20)])]
    for q in range(3):
        w = g if q == 1 else 0.0
        blend = [round((1 - w) * (b * x + (1 - b) * y) + w * z, 9) for x, y, z in zip(*scaled)]
        assert [got[i, q][k] for k in range(1, 11)] == sorted(range(20), key=lambda u: (-blend[u], u))[:10]
