"""Searches of many questions, whose blocks the corpus is sent to, and the gram encoder that makes their vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanseek import fixed_values as fv
from spanseek.encoders import GramEncoder
from spanseek.operators import topk
from spanseek.operators.topk import dense_top_k


def test_corpus_sent_to_blocks_of_queries_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAST_KEPT", 4)
    monkeypatch.setattr(topk, "PACKED_UNITS", 7)
    rng = np.random.default_rng(12)
    base = rng.normal(size=(60, 8)).astype("float32")
    base[3] *= 1e22  # too large for a product of floats
    base[4], base[5] = np.nan, 0
    vectors = np.concatenate([base, base[:10], np.repeat(base[:1], 90, axis=0)])
    units = spark.createDataFrame([(i, v.tolist(), i % 3 == 0) for i, v in enumerate(vectors)], "unit_id long, vector array<float>, is_test boolean").repartition(7)
    q = spark.createDataFrame([(i, base[i].tolist(), i % 2 == 0, i if i % 5 == 0 else None, 3 if i % 4 else 9) for i in range(24)],
                              "query_id long, vector array<float>, include_tests boolean, exclude_id long, wanted int")
    want = {}
    for i in range(24):
        scores = np.round(vectors.astype("float64") @ base[i].astype("float64"), 12)
        allowed = [j for j in range(len(vectors)) if (i % 2 == 0 or j % 3) and (i % 5 or i != j) and not np.isnan(scores[j])]
        want[i] = sorted(allowed, key=lambda j: (-scores[j], j))[:3 if i % 4 else 9]
    for cores_full in (10_000_000, 0):
        for rows in (2_000_000, 20):
            got = dense_top_k(q, units, 9, depth="wanted", moved_rows=cores_full, block_rows=rows).orderBy("query_id", "rank").collect()
            assert {i: [r.unit_id for r in got if r.query_id == i] for i in range(24)} == want, (cores_full, rows)
            assert all([r["rank"] for r in got if r.query_id == i] == list(range(1, len(want[i]) + 1)) for i in range(24))
    assert dense_top_k(q, units.limit(0), 9, moved_rows=0).count() == 0


def test_one_block_keeps_no_more_than_its_lists(spark):
    """Many units above the floors, as in a corpus sorted by nearness, are sorted in as they come."""
    ids, n = np.arange(40), 30_000
    lists = topk._Lists([_rows(query_id=ids, _v=[[1.0, 0.5]] * 40, _all=[True] * 40, _not=[None] * 40, _k=[10] * 40)])
    for s in range(0, n, 3_000):
        v = np.stack([np.arange(s, s + 3_000) / n, np.zeros(3_000)], axis=1)
        lists.offer(_rows(unit_id=np.arange(s, s + 3_000), _v=v.astype("float32").tolist(), _test=[False] * 3_000))
        assert lists.best.length <= lists.best.most + topk.EXACT_PAIRS
    rows, unit, _ = lists.best.result()
    assert all(unit[rows == q].tolist() == list(range(n - 1, n - 11, -1)) for q in range(40))


def test_units_below_all_floors_are_not_compared_pair_by_pair():
    def offer(first, x):
        lists.offer(_rows(unit_id=np.arange(first, first + len(x)), _v=[[v, 0.0] for v in x], _test=[False] * len(x)))

    lists = topk._Lists([_rows(query_id=np.arange(40), _v=[[1.0, 0.5]] * 40, _all=[True] * 40, _not=[None] * 40, _k=[2] * 40)])
    offer(0, [0.5, 0.75, 0.25])
    marks, lists.marks = lists.marks, None
    offer(3, [0.1] * 100)
    lists.marks = marks
    offer(103, [0.1, float("nan"), 0.9])  # what is no number hides nothing
    rows, unit, _ = lists.best.result()
    assert all(unit[rows == q].tolist() == [105, 1] for q in range(40))


def test_memory_of_a_block_is_that_of_its_vectors_and_lists():
    """Vectors of floats are kept once, and sorting the lists takes no second copy of all that waits."""
    import tracemalloc

    rng, n, k = np.random.default_rng(8), 20_000, 10
    vectors = rng.normal(size=(n, 64)).astype("float32")
    asked = _rows(query_id=np.arange(n), _v=list(vectors), _all=[True] * n, _not=[None] * n, _k=[k] * n)
    units = [_rows(unit_id=np.arange(a, a + 1_000), _v=list(rng.normal(size=(1_000, 64)).astype("float32")), _test=[False] * 1_000) for a in (0, 1_000, 2_000)]
    tracemalloc.start()
    lists = topk._Lists([asked])
    for u in units:
        lists.offer(u)
    rows, _, _ = lists.best.result()
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    tiles = topk.TILE_QUERIES * topk.TILE_UNITS * 5
    assert len(rows) == n * k and peak - tiles < 150 * n * k


def _rows(**columns):
    import pyarrow as pa

    kinds = {"_all": pa.bool_(), "_test": pa.bool_(), "_v": pa.list_(pa.float32()), "_k": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in columns.items()], names=list(columns))


def test_gram_vectors_equal_counts_by_replacement(spark):
    grams = ["a", "l", "th", "ll", "he", "é", "abc"]
    texts = ["", "The ALL allll abcabc", "éÉ the", None, "İllx" * 9, "🙂 th"]
    encoder = GramEncoder(grams)
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(2).select("i", F.lower("t").alias("low"), encoder.embed(F.col("t"), "query").alias("v"))
    for r in df.collect():
        if r.low is None:
            assert r.v == [None] * len(grams)
            continue
        raw = [float(np.float32((len(r.low) - len(r.low.replace(g, ""))) / len(g) + 1e-3)) for g in grams]
        total = 0.0
        for x in raw:
            total += x * x
        assert r.v == [float(np.float32(x / max(total ** 0.5, fv.CLIP_NORM))) for x in raw]
    assert "replace" not in encoder.embed(F.col("t"), "query")._jc.toString()  # no pass over the text for each gram
    with pytest.raises(Exception):
        encoder.embed(F.col("t"), "neither")


def test_only_gated_questions_get_long_lists(spark, monkeypatch):
    from spanseek.plans import search as plan

    units = spark.createDataFrame([(i, f"word{i} plain_name" if i == 7 else f"word{i}", False, [float(i), 1.0]) for i in range(300)],
                                  "unit_id long, doc string, is_test boolean, vector array<float>").repartition(3)
    q = spark.createDataFrame([(0, "where is plain_name set", [1.0, 0.0]), (1, "nothing named", [1.0, 0.0])], "query_id long, query string, vector array<float>")
    lists, search = [], plan.dense_top_k

    def seen(*args, **options):
        lists.append(search(*args, **options))
        return lists[-1]

    monkeypatch.setattr(plan, "dense_top_k", seen)
    pool = plan.retrieve(q, units, depth=10).pool
    assert {r.query_id: r["count"] for r in lists[0].groupBy("query_id").count().collect()} == {0: 100, 1: 10}
    got = {i: [r.unit_id for r in pool.where(F.col("query_id") == i).orderBy("pool_rank").collect()] for i in (0, 1)}
    assert got[1] == list(range(299, 289, -1)) and 7 in got[0] and len(got[0]) == 10


def test_hashing_encoder_remembers_a_bounded_number_of_words(monkeypatch):
    import sys
    import tracemalloc
    import zlib

    import pandas as pd

    from spanseek import encoders

    monkeypatch.setattr(encoders.F, "pandas_udf", lambda kind: lambda fn: lambda text: fn)
    fn = encoders.HashingEncoder(8).embed(None, "document")

    def word(i):
        return "".join(chr(97 + i // 26 ** k % 26) for k in range(5))

    def batches():  # 100,000 words, none twice
        for s in range(0, 100_000, 1_000):
            yield pd.Series([" ".join(word(i) for i in range(s, s + 1_000)), ""])

    tracemalloc.start()
    last = None
    for last in fn(batches()):
        pass
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 5 << 20, peak
    counts = np.bincount([zlib.crc32(word(i).encode()) % 8 for i in range(99_000, 100_000)], minlength=8) + 1e-3
    assert last[0].tolist() == (counts / np.linalg.norm(counts)).astype("float32").tolist() and len(last) == 2 and sys.getsizeof(last[0])


def test_lists_are_ordered_by_row_score_and_unit():
    rng = np.random.default_rng(5)
    for n in (1, 2, 300):
        rows, unit = rng.integers(0, n, 5_000).astype("int32"), rng.permutation(5_000)
        close = 0.97 + rng.integers(0, 4, 5_000) * 1e-12  # told apart by their last digits only
        for score in (np.round(rng.normal(size=5_000), 1) + 0.0, close, np.where(unit % 2, 0.0, -0.0), rng.normal(size=5_000) * 1e22):
            assert np.array_equal(topk._list_order(rows, score, unit, n), np.lexsort((unit, -score, rows)))


def test_blocks_of_queries_read_the_corpus_and_no_copy_of_it_moves(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAST_KEPT", 4)
    units = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(60)], "unit_id long, vector array<float>").repartition(5)
    q = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(30)], "query_id long, vector array<float>")
    top = dense_top_k(q, units, 3, moved_rows=0)
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    moved = [line for line in plan.splitlines() if "Repartition" in line and "Repartition 1, false" not in line]
    assert len(moved) == 1 and "Union" not in plan and "Join" in plan  # the queries, by block
    assert {(r.query_id, r.unit_id, r["rank"]) for r in top.collect()} == {(q, 59 - i, i + 1) for q in range(30) for i in range(3)}


def test_a_search_by_vectors_stores_no_texts(spark):
    from spanseek.catalogue import all_queries
    from spanseek.catalogue import corpus as c
    from spanseek.catalogue.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    assert c.units(t).columns == list(c.VECTORS) and c.texts(t).columns == ["unit_id", "is_test", "doc"]
    for name in ("rrf_lists", "concat_ensemble", "dense_topk_scoped"):
        plan = all_queries()[0][name](spark, t.folder)._jdf.queryExecution().optimizedPlan().toString()
        assert "doc#" not in plan and "text#" not in plan
