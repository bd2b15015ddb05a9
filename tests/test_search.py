"""Retrieval against brute force and hand-computed values."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanseek.encoders import HashingEncoder, HookedEncoder, role_of
from spanseek.functions import paths as px
from spanseek.functions import text as tx
from spanseek.functions import vectors as vx
from spanseek.models import CODE_MODEL, TEXT_MODEL, by_key, fingerprint
from spanseek.operators import evaluate as ev
from spanseek.operators import fusion
from spanseek.operators.lexical import lexical_run
from spanseek.operators.literals import literal_hits
from spanseek.operators.topk import _Best, dense_top_k
from spanseek.plans.index_build import build, build_pair, vectors_for
from spanseek.plans.search import aligned_search, fusion_search, search
from spanseek.session import skew_join
from spanseek.sources.repository import parse_link
from spanseek.sources.store import StoredIndex, VectorCache

DOCS = [(0, "retry_limit = 3"), (1, 'print("Disk is full")'), (2, "maxRetryCount += retry")]


def value(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("v")).first()["v"]


def test_words_literals_and_anchors(spark):
    got = value(spark, "HTTPRequest v2_final __x A1b", tx.tokenise)
    assert got == ["httprequest", "http", "request", "v2_final", "v", "2", "final", "__x", "x", "a1b", "a", "1", "b"]
    for text in ("getHTTPResponse2 a_b __ 12x é9 ٣", "", "snake_case Camel XMLHttp x1Y2 1a_b"):
        assert sorted(value(spark, text, tx.token_bag)) == sorted(value(spark, text, tx.tokenise))
    assert value(spark, 'where is the "Invalid SSH Key name" thrown', tx.quoted_literals) == ["invalid ssh key name"]
    assert value(spark, "the model's output isn't", tx.quoted_literals) == ["s output isn"]
    assert value(spark, 'say "   " now', tx.quoted_literals) == [""]
    for text, anchors in {"where is install_not_allowed raised": ["install_not_allowed"], "how does editorTheme get read": ["editortheme"],
                          "what does msg.payload hold": ["msg.payload"], "plain words _x": [], 'in "foo_bar" only': [], "a.bé c": ["a.bé"]}.items():
        assert value(spark, text, tx.identifier_anchors) == anchors


def test_path_and_intent_rules(spark):
    rules = {"tests/": True, "test/": True, "__tests__/": True, "src/": False, "protest/": False, "testing/": False}
    for folder, inside in rules.items():
        assert value(spark, f"{folder}lib/reader.py", px.is_test_path) == inside, folder
    for name, is_test in {"reader.test.js": True, "reader.spec.tsx": True, "reader_spec.js": True, "reader_test.py": True, "test_reader.py": True, "conftest.py": True,
                          "attest.py": False, "fastest_reader.py": False, "tester.js": False}.items():
        assert value(spark, f"lib/{name}", px.is_test_path) == is_test, name
    assert value(spark, "show me the Tests of the parser", tx.wants_tests)
    assert not value(spark, "what does the parser return", tx.wants_tests)
    with pytest.raises(Exception, match="auto, include or exclude"):
        spark.createDataFrame([("sometimes", "q")], "m string, q string").select(tx.tests_included(F.col("m"), F.col("q"))).collect()
    assert parse_link("https://github.com/some-owner/some.repo/") == ("some-owner", "some.repo")
    for link in ("https://example.org/some-owner/some.repo", "github.com/alone", ""):
        with pytest.raises(ValueError, match="does not name"):
            parse_link(link)


def test_bm25_gate_and_literals(spark):
    docs = spark.createDataFrame(DOCS, "unit_id long, doc string")
    asked = ["where is retry_limit set", '"disk is full" shown', "how are retries done", "missing_identifier here", "where is print.disk", '"disk is full" and "disk is full"', "print.nowhere"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    run = lexical_run(q, docs)
    assert sorted(r.query_id for r in run.gate.collect()) == [0, 1, 4, 5]
    got = {(r.query_id, r.unit_id): r.bm25 for r in run.scores().collect()}
    assert got[0, 0] == pytest.approx(2.510669, abs=1e-6) and got[0, 2] == pytest.approx(0.619452, abs=1e-6)
    assert got[1, 1] == pytest.approx(3.987053, abs=1e-6)
    assert got[5, 1] - got[1, 1] == pytest.approx(2 * math.log(1 + 2.5 / 1.5), abs=1e-6)  # a repeated literal counts twice
    everything = lexical_run(q, docs, gated_only=False).scores(gated_only=False)
    assert {r.query_id for r in everything.collect()} >= {0, 1, 6}


def test_both_literal_forms_agree_with_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abc \n"), 60)) for _ in range(40)] + ["", "AbC"]
    lits = ["", "ab", "abc", "a b", "cab ca", "abcabcab", "\na", "zzz", " "] + [texts[i][5:17].lower() for i in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "unit_id long, doc string")
    wanted = spark.createDataFrame([(x,) for x in lits + lits], "lit string")
    want = {i: {x for x in lits if x in t.lower()} for i, t in enumerate(texts)}
    for limit in (1 << 20, 0):
        got = {r.unit_id: r.hits for r in literal_hits(docs, wanted, scan_bytes=limit).select("unit_id", "hits").collect()}
        assert {k: set(v) for k, v in got.items()} == want and all(len(v) == len(set(v)) for v in got.values())


def test_dense_top_k_with_ties_scope_and_blocks(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 8)).astype("float32")
    vectors = np.concatenate([base, base[:10], np.repeat(base[:1], 40, axis=0)])  # copies: half of the rows are one vector
    units = spark.createDataFrame([(i, v.tolist(), i % 3 == 0) for i, v in enumerate(vectors)], "unit_id long, vector array<float>, is_test boolean").repartition(7)
    q = spark.createDataFrame([(i, base[i].tolist(), i % 2 == 0) for i in range(12)], "query_id long, vector array<float>, include_tests boolean")
    want = {}
    for i in range(12):
        scores = np.round(vectors.astype("float64") @ base[i].astype("float64"), 12)
        allowed = [j for j in range(len(vectors)) if i % 2 == 0 or j % 3]
        want[i] = sorted(allowed, key=lambda j: (-scores[j], j))[:9]
    for block in (1 << 20, 400):
        rows = dense_top_k(q, units, 9, block_bytes=block).orderBy("query_id", "rank").collect()
        assert {i: [r.unit_id for r in rows if r.query_id == i] for i in range(12)} == want
    rows = dense_top_k(q, units, 9, block_rows=20).orderBy("query_id", "rank").collect()  # two queries a block
    assert {i: [r.unit_id for r in rows if r.query_id == i] for i in range(12)} == want
    assert dense_top_k(q.where("query_id = 1"), units.where("is_test"), 5).count() == 0


def test_rrf_blend_and_reordering(spark):
    lists = {"first": (40, 10, 30, 20), "second": (20, 50, 40)}
    a, b = (spark.createDataFrame([(1, u, r) for r, u in enumerate(units, 1)], "query_id long, unit_id long, rank int") for units in lists.values())
    weight = {u: sum(1 / (60 + units.index(u) + 1) for units in lists.values() if u in units) for u in (10, 20, 30, 40, 50)}
    want = sorted(weight, key=lambda u: (-weight[u], u))
    got = {r.unit_id: (r.pool_rank, r.rrf) for r in fusion.fused_pool([a, b], 10).collect()}
    assert {u: p for u, (p, _) in got.items()} == {u: i for i, u in enumerate(want, 1)}
    assert all(got[u][1] == pytest.approx(weight[u], abs=1e-9) for u in want) and want[:2] == [40, 20]
    rows = spark.createDataFrame([(g, i, i, x, y, z, bool(g)) for g in (0, 1) for i, (x, y, z) in enumerate(((.9, .2, 0.), (.5, .6, 3.), (.7, .4, 1.)))],
                                 "query_id long, unit_id long, pool_rank int, cos_a double, cos_b double, bm25 double, gated boolean")
    s = {(r.query_id, r.unit_id): round(r.score, 6) for r in fusion.blend_score(rows).collect()}
    assert [s[0, i] for i in range(3)] == [0.3, 0.7, 0.5] and [s[1, i] for i in range(3)] == [0.225, 0.775, 0.458333]
    order = fusion.reorder_head(rows.where("query_id = 0").withColumn("pool_rank", F.col("pool_rank") + 1), F.col("cos_b"), 2).orderBy("rank")
    assert [r.unit_id for r in order.collect()] == [1, 0, 2]
    one = rows.where("unit_id = 0")
    assert {r.score for r in fusion.blend_score(one).collect()} == {0.0}
    filled = fusion.backfill(b, a).orderBy("rank").collect()
    assert [r.unit_id for r in filled] == [20, 50, 40, 10, 30]


def test_metrics(spark):
    q = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "query_id long, category string")
    gold = spark.createDataFrame([(i, 0, "f", 10, 20) for i in (1, 2, 3)] + [(2, 1, "g", 1, 1)], "query_id long, gold_id long, path string, start int, end int")
    hits = spark.createDataFrame([(1, 1, "f", 20, 30), (2, 1, "x", 10, 20), (2, 4, "f", 12, 15), (3, 1, "f", 21, 22)], "query_id long, rank int, path string, start_line int, end_line int")
    got = {r.query_id: (r.first_rank, r.gold_at_k) for r in ev.query_results(q, hits, gold).collect()}
    assert got == {1: (1, 1.0), 2: (4, 0.5), 3: (None, 0.0)}
    blocks = {r.value: r for r in ev.summary(ev.query_results(q, hits, gold)).collect()}
    assert blocks["all"].recall_at_1 == pytest.approx(1 / 3) and blocks["all"].recall_at_5 == pytest.approx(2 / 3)
    assert blocks["all"].mrr_at_10 == pytest.approx(1.25 / 3) and blocks["b"].n == 1
    assert ev.summary(ev.query_results(q, hits, gold).where("false")).first().n == 0
    with pytest.raises(Exception, match="no gold range"):
        ev.query_results(q, hits, gold.where("query_id < 3")).collect()
    assert value(spark, "x", lambda _: vx.dcg_gain(F.lit(2))) == pytest.approx(0.63093, abs=1e-5)


def test_running_best_equals_sorting():
    rng = np.random.default_rng(6)
    for n, k, width in ((3, 4, 50), (40, 100, 7), (5, 1, 400)):
        best, seen = _Best(n, k), []
        for start in range(0, 3000, width):
            scores = np.round(rng.standard_normal((n, width)), 1)  # many ties
            seen.append(scores)
            best.add(scores.copy(), np.arange(start, start + width))
        rows, ids, values = best.result()
        full = np.concatenate(seen, axis=1)
        for q in range(n):
            order = np.lexsort((np.arange(full.shape[1]), -full[q]))[:k]
            assert ids[rows == q].tolist() == order.tolist() and np.array_equal(values[rows == q], full[q, order])


def test_skew_join_is_a_join(spark):
    left = spark.range(300).select(F.when(F.col("id") < 200, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("250", 2), ("none", 3)], "k string, v int")
    assert skew_join(left, right, "k", "id", hot_rows=50).count() == 201
    assert skew_join(left, right, "k", "id", "left", hot_rows=50).where("v is null").count() == 99


def test_index_cache_and_fusion_end_to_end(spark, tmp_path):
    repo = tmp_path / "garden"
    for folder in ("beds", "tests"):
        (repo / folder).mkdir(parents=True)
    (repo / "beds" / "water.py").write_text("def open_valve(bed, litres):\n    if bed.frozen:\n        raise RuntimeError('valve_is_frozen')\n    return bed.pour(litres)\n\n\n"
                                            "def moisture_report(beds):\n    return [bed.sensor.read() for bed in beds]\n")
    (repo / "tests" / "test_water.py").write_text("def test_open_valve():\n    assert open_valve(bed(), 3) == 3\n")
    a, b = HashingEncoder(64, "g"), HashingEncoder(96, "j")
    cache = VectorCache(spark, str(tmp_path / "cache"))
    one, two = build_pair(spark, str(repo), a, b, (cache, None))
    meta = one.meta.first()
    assert (meta.n_units, meta.n_files, meta.embedded_now, meta.from_cache) == (3, 2, 3, 0)
    source = repo / "beds" / "water.py"
    source.write_text(source.read_text().replace("sensor.read()", "sensor.read(2)"))
    again = build(spark, str(repo), a, cache=cache).meta.first()
    assert (again.embedded_now, again.from_cache) == (1, 2)
    one.save(str(tmp_path / "index"))
    loaded = StoredIndex.load(spark, str(tmp_path / "index"))
    assert loaded.units.count() == 3
    one.units.limit(2).write.parquet(str(tmp_path / "short" / "units"))
    one.meta.write.json(str(tmp_path / "short" / "meta"))
    with pytest.raises(ValueError):
        StoredIndex.load(spark, str(tmp_path / "short"))

    def ask(*queries):
        q = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
        return (q.withColumn("vector", a.embed(F.col("query"), "query")).withColumn("vector_b", b.embed(F.col("query"), "query")))

    q = ask("open the valve of a bed", "which test covers open valve", "where is valve_is_frozen raised", "report of moisture in all beds")
    rows = aligned_search(q, one.units, two.units).join(one.units.select("unit_id", "path", "qualname"), "unit_id").orderBy("query_id", "rank").collect()
    by = {i: [r for r in rows if r.query_id == i] for i in range(4)}
    assert all(not r.path.startswith("tests/") for i in (0, 2, 3) for r in by[i]) and any(r.path.startswith("tests/") for r in by[1])
    assert by[2][0].qualname == "open_valve" and by[2][0].gated and by[2][0].bm25 > 0 and by[0][0].bm25 is None
    single = {i: [r.unit_id for r in fusion_search(q.where(F.col("query_id") == i), one.units, vectors_for(one.units, two.units)).orderBy("rank").collect()] for i in (2, 3)}
    assert single == {i: [r.unit_id for r in by[i]] for i in (2, 3)}  # a batch gives what its queries give alone
    tests_only = one.units.where("is_test")
    assert search(q, tests_only, 5, mode="exclude").count() == 0
    with pytest.raises(ValueError):
        aligned_search(q, one.units, two.units.limit(2))
    with pytest.raises(ValueError):
        fusion_search(q, one.units, one.units, beta=1.5)


def test_models_and_hooks(spark):
    assert by_key(TEXT_MODEL.key) is TEXT_MODEL
    with pytest.raises(KeyError, match="not among"):
        by_key("unheard-of")
    runs = [fingerprint(m, **run) for m in (CODE_MODEL, TEXT_MODEL) for run in ({}, {"kind": "document"}, {"kind": "query"})]
    assert len(set(runs)) == 6 and all(len(r) == 12 for r in runs)
    assert fingerprint(replace(TEXT_MODEL, notes="worded otherwise")) == fingerprint(TEXT_MODEL) != fingerprint(replace(TEXT_MODEL, max_seq_length=7))
    with pytest.raises(ValueError):
        TEXT_MODEL.prompt("other")
    seen = HookedEncoder(HashingEncoder(), before=lambda t, role: F.concat(t, F.lit(" " + role)))
    v = value(spark, "a b", lambda t: seen.embed(t, role_of("query")))
    assert np.linalg.norm(v) == pytest.approx(1, abs=1e-6) and role_of(None) == "document"
    zero = spark.createDataFrame([([0.0, 0.0],)], "v array<float>").select(vx.l2_normalise_clipped(F.col("v")).alias("c"), vx.l2_normalise(F.col("v")).alias("n")).first()
    assert zero.c == [0.0, 0.0] and all(math.isnan(x) for x in zero.n)
