"""Evaluation: spans, ranks, metrics, paired comparisons, experiments."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanseek.catalogue import corpus as c
from spanseek.catalogue.registry import ctes, query
from spanseek.operators import evaluate as ev
from spanseek.operators import fusion
from spanseek.operators.literals import literal_hits
from spanseek.operators.topk import dense_top_k
from spanseek.plans import experiments as ex
from spanseek.plans.search import rescored, retrieve, search
from spanseek.session import sized_join, written

LINES = 8  # lines per window unit


def passages(t):
    """Benchmark passages as questions with a split and a category."""
    q = t.benchmark.select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"),
        F.when(F.col("item_id") % 5 < 3, "dev").otherwise("holdout").alias("split"),
        F.when(F.length("text") > 200, "long").otherwise("short").alias("category"))
    return (q.withColumn("vector", c.MODEL_A.embed(F.col("query"), "query"))
            .withColumn("vector_b", c.MODEL_B.embed(F.col("query"), "query")))


def stride(t) -> Column:
    """More than any document has lines: numbers of lines of different documents never meet."""
    return F.coalesce(t.documents.agg(F.max(F.length("text"))).scalar(), F.lit(0)) + 2


def windows(t):
    """Every document in runs of eight lines, with the vectors of both models."""
    lines = F.split("text", "\n")
    starts = F.sequence(F.lit(1), F.size(lines), F.lit(LINES))
    cut = F.transform(starts, lambda s: F.struct(s.alias("s"), F.slice(lines, s, F.lit(LINES)).alias("x")))
    u = (t.documents.select("doc_id", F.inline(cut))
         .select((F.col("doc_id") * stride(t) + F.col("s")).alias("unit_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("path"),
                 F.col("s").alias("start_line"), (F.col("s") + F.size("x") - 1).alias("end_line"), F.array_join("x", "\n").alias("text")))
    return (u.withColumn("vector", c.MODEL_A.embed(F.col("text"), "document"))
            .withColumn("vector_b", c.MODEL_B.embed(F.col("text"), "document")))


def gold_lines(t):
    """Where a line of a passage stands in a document, as gold ranges of that passage."""
    wanted = t.benchmark.select(F.col("item_id").alias("query_id"), F.explode(F.split("text", "\n")).alias("line")).distinct()
    found = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return sized_join(found, wanted, "line", "doc_id").select(  # one line may stand in a third of the documents
        "query_id", (F.col("doc_id") * stride(t) + F.col("i")).alias("gold_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("path"),
        (F.col("i") + 1).alias("start"), (F.col("i") + 1).alias("end"))


WINDOWS = ("windows", f"""
 SELECT *, {c.sql_unit('ra')} AS va, {c.sql_unit('rb')} AS vb FROM (
  SELECT *, {c.sql_raw('lower(text)', c.LETTERS)} AS ra, {c.sql_raw('lower(text)', c.PAIRS)} AS rb FROM (
   SELECT doc_id * (SELECT max(length(text)) + 2 FROM documents) + s AS unit_id, concat('doc', doc_id) AS path, s::INTEGER AS start_line, least(s + 7, n)::INTEGER AS end_line,
     list_aggregate(x[s:s + 7], 'string_agg', chr(10)) AS text
   FROM (SELECT doc_id, x, len(x) AS n, unnest(range(1, len(x) + 1, 8)) AS s FROM (
     SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))))""")
PASSAGES = ("questions", f"""
 SELECT *, {c.sql_unit('ra')} AS qa, {c.sql_unit('rb')} AS qb FROM (
  SELECT *, {c.sql_raw('lower(query)', c.LETTERS)} AS ra, {c.sql_raw('lower(query)', c.PAIRS)} AS rb FROM (
   SELECT item_id AS query_id, text AS query, CASE WHEN item_id % 5 < 3 THEN 'dev' ELSE 'holdout' END AS split,
    CASE WHEN length(text) > 200 THEN 'long' ELSE 'short' END AS category FROM benchmark))""")
GOLD = ("gold", """
 SELECT DISTINCT b.query_id, d.doc_id * (SELECT max(length(text)) + 2 FROM documents) + i - 1 AS gold_id, concat('doc', d.doc_id) AS path, i AS start, i AS "end"
 FROM (SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)) d
 JOIN (SELECT item_id AS query_id, unnest(string_split(text, chr(10))) AS line FROM benchmark) b USING (line)""")


def _sql_hits(query_vector: str, vector: str, k: int = 10) -> str:
    return f"""SELECT query_id, unit_id, path, start_line, end_line, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, unit_id) AS rank
 FROM (SELECT *, round(list_dot_product({query_vector}::DOUBLE[], {vector}::DOUBLE[]), 12) AS sim FROM questions, windows)
 QUALIFY rank <= {k}"""


RESULTS = [
    ("hit_gold", """SELECT h.query_id, h.rank, g.gold_id FROM hits h JOIN gold g ON h.query_id = g.query_id AND h.path = g.path
       AND h.start_line <= g."end" AND g.start <= h.end_line"""),
    ("results", """SELECT q.query_id, split, category, first_rank, gold_at_k FROM questions q
       JOIN (SELECT query_id, avg(CASE WHEN (query_id, gold_id) IN (SELECT (query_id, gold_id) FROM hit_gold) THEN 1 ELSE 0 END) AS gold_at_k
             FROM gold GROUP BY query_id) USING (query_id)
       LEFT JOIN (SELECT query_id, min(rank) AS first_rank FROM hit_gold GROUP BY query_id) USING (query_id)"""),
]
BLOCK = """count(*) AS n, round(avg(CASE WHEN first_rank <= 1 THEN 1 ELSE 0 END), 6) AS recall_at_1,
 round(avg(CASE WHEN first_rank <= 5 THEN 1 ELSE 0 END), 6) AS recall_at_5, round(avg(CASE WHEN first_rank <= 10 THEN 1 ELSE 0 END), 6) AS recall_at_10,
 round(avg(CASE WHEN first_rank <= 10 THEN 1.0::DOUBLE / first_rank ELSE 0 END), 6) AS mrr_at_10, round(avg(gold_at_k), 6) AS gold_recall_at_10"""
DOUBLES = ("recall_at_1", "recall_at_5", "recall_at_10", "mrr_at_10", "gold_recall_at_10")


def _round(df, *cols):
    return df.select(*[F.round(x, 6).alias(x) if x in cols else F.col(x) for x in df.columns])


def _hits(t, vector="vector"):
    u = windows(t)
    hits = written(dense_top_k(passages(t), u, 10, query_vector=vector, vector=vector))
    return ex.located(hits, u)


def _results(t, vector="vector"):
    gold = gold_lines(t)
    asked = passages(t).drop("vector", "vector_b", "query").join(gold.select("query_id").distinct(), "query_id", "left_semi")
    return ev.query_results(asked, _hits(t, vector), gold)


@query("span_matches", ctes(WINDOWS, PASSAGES, GOLD, ("hits", _sql_hits("qa", "va")), RESULTS[0],
                            select="SELECT query_id, rank::INTEGER AS rank, gold_id FROM hit_gold"))
def span_matches(t):
    return ev.span_matches(_hits(t), gold_lines(t))


@query("marked_hits", ctes(WINDOWS, PASSAGES, GOLD, ("hits", _sql_hits("qa", "va")), RESULTS[0], select="""
SELECT query_id, rank::INTEGER AS rank, path, start_line, end_line, (query_id, rank) IN (SELECT (query_id, rank) FROM hit_gold) AS hit FROM hits"""))
def marked_hits(t):
    return ev.mark_hits(_hits(t), gold_lines(t)).select("query_id", "rank", "path", "start_line", "end_line", "hit")


@query("query_results", ctes(WINDOWS, PASSAGES, GOLD, ("hits", _sql_hits("qa", "va")), *RESULTS, select="""
SELECT query_id, split, category, first_rank::INTEGER AS first_rank, round(gold_at_k, 6) AS gold_at_k FROM results"""))
def query_results(t):
    return _round(_results(t), "gold_at_k")


@query("metrics_by_group", ctes(WINDOWS, PASSAGES, GOLD, ("hits", _sql_hits("qa", "va")), *RESULTS, select=f"""
SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(split) = 0 THEN 'split' ELSE 'all' END AS scope,
 CASE WHEN grouping(category) = 0 THEN category WHEN grouping(split) = 0 THEN split ELSE 'all' END AS value, {BLOCK}
FROM results GROUP BY GROUPING SETS ((category), (split), ())"""))
def metrics_by_group(t):
    return _round(ev.summary(_results(t), ("category", "split")), *DOUBLES)


@query("metrics_within_split", ctes(WINDOWS, PASSAGES, GOLD, ("hits", _sql_hits("qa", "va")), *RESULTS, select=f"""
SELECT split, category, {BLOCK} FROM results GROUP BY GROUPING SETS ((split), (split, category))"""))
def metrics_within_split(t):
    return _round(ev.summary_within(_results(t)), *DOUBLES)


@query("metrics_rounded", ctes(WINDOWS, PASSAGES, GOLD, ("hits", _sql_hits("qb", "vb")), *RESULTS, select="""
SELECT category, count(*) AS n, """ + ", ".join(f"round_even({x}, 3) AS {n}" for n, x in (
    ("recall_at_1", "avg(CASE WHEN first_rank <= 1 THEN 1 ELSE 0 END)"), ("recall_at_5", "avg(CASE WHEN first_rank <= 5 THEN 1 ELSE 0 END)"),
    ("recall_at_10", "avg(CASE WHEN first_rank <= 10 THEN 1 ELSE 0 END)"))) + " FROM results GROUP BY category"))
def metrics_rounded(t):
    """The reported form of the metrics: three digits, halves to the even one."""
    blocks = ev.rounded(ev.summary(_results(t, "vector_b"))).where("scope = 'category'")
    return blocks.select(F.col("value").alias("category"), "n", "recall_at_1", "recall_at_5", "recall_at_10")


@query("better_worse", ctes(WINDOWS, PASSAGES, GOLD, ("hits", _sql_hits("qb", "vb")), *RESULTS, ("hits_a", _sql_hits("qa", "va")),
                            ("first_a", """SELECT h.query_id, min(rank) AS r FROM hits_a h JOIN gold g ON h.query_id = g.query_id AND h.path = g.path
       AND h.start_line <= g."end" AND g.start <= h.end_line GROUP BY ALL"""), select="""
SELECT count(*) FILTER (coalesce(first_rank, 99) < coalesce(r, 99)) AS better, count(*) FILTER (coalesce(first_rank, 99) > coalesce(r, 99)) AS worse
FROM results LEFT JOIN first_a USING (query_id)"""))
def better_worse(t):
    return ev.better_worse(_results(t, "vector_b").select("query_id", "first_rank"), _results(t).select("query_id", "first_rank"))


@query("gate_rate", ctes(c.UNITS, c.QUESTIONS, *c.GATE, select="""
SELECT count(*) FILTER (query_id IN (SELECT query_id FROM gate)) AS fired, count(*) AS n,
 round(avg(CASE WHEN query_id IN (SELECT query_id FROM gate) THEN 1 ELSE 0 END), 6) AS rate FROM questions"""))
def gate_rate(t):
    from spanseek.operators.lexical import lexical_run

    q = c.questions(t)
    fired = lexical_run(q, c.texts(t)).gate.withColumn("gated", F.lit(True))
    return _round(ev.gate_rate(q.join(fired, "query_id", "left").select("query_id", F.coalesce("gated", F.lit(False)).alias("gated"))), "rate")


def _ablation_sql() -> str:
    parts = list(c.pool_ctes(10))
    parts = [p for p in parts if p[0] not in ("dense_all", "lex", "pool", "rows")]
    selects = []
    for i, (name, (lexical, mode)) in enumerate(ex.ABLATIONS.items()):
        scope = "true" if mode == "include" else "(include_tests OR NOT is_test)"
        lane = "gated" if lexical else "false"
        parts += [
            (f"d{i}", f"""SELECT query_id, unit_id, gated, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, unit_id) AS r FROM (
              SELECT query_id, unit_id, {lane} AS gated, round(list_dot_product(qa::DOUBLE[], va::DOUBLE[]), 12) AS sim
              FROM q JOIN units u ON {scope})"""),
            (f"l{i}", f"""SELECT query_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, unit_id) AS r
              FROM bm25 JOIN q USING (query_id) JOIN units USING (unit_id) WHERE bm25 > 0 AND {lane} AND {scope} QUALIFY r <= 100"""),
            (f"p{i}", f"""SELECT query_id, unit_id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, unit_id) AS rank FROM (
              SELECT query_id, unit_id, sum(1.0 / (60 + r)) AS rrf FROM (
                SELECT query_id, unit_id, r::DOUBLE AS r FROM d{i} WHERE r <= CASE WHEN gated THEN 100 ELSE 10 END
                UNION ALL SELECT query_id, unit_id, r::DOUBLE FROM l{i}) GROUP BY ALL) QUALIFY rank <= 10"""),
        ]
        selects.append(f"""SELECT '{name}' AS system, p.query_id, p.unit_id, p.rank::INTEGER AS rank,
          round(CASE WHEN d.gated IS NULL OR d.gated THEN rrf ELSE sim END, 6) AS score FROM p{i} p LEFT JOIN d{i} d USING (query_id, unit_id)""")
    return ctes(*parts, select="\nUNION ALL ".join(selects))


@query("ablation", _ablation_sql())
def ablation(t):
    return _round(ex.ablation(c.questions(t), c.units(t, ("unit_id", "is_test", "vector")), texts=c.texts(t)), "score")


def _two_stage_sql() -> str:
    parts = list(c.pool_ctes(20))
    selects = ["SELECT 'single' AS system, query_id, unit_id, pool_rank::INTEGER AS rank FROM rows WHERE pool_rank <= 10"]
    for n in (5, 10, 20):
        total = f"round({c.sql_minmax('cos_a')} + {c.sql_minmax('cos_b')}, 9)"
        parts.append((f"h{n}", f"SELECT query_id, unit_id, pool_rank, {total} AS total, cos_b FROM rows WHERE pool_rank <= {n}"))
        for how, column in (("other", "cos_b"), ("sum", "total")):
            selects.append(f"""SELECT 'top-{n} {how}', query_id, unit_id, rank::INTEGER FROM (
              SELECT r.query_id, r.unit_id, row_number() OVER (PARTITION BY r.query_id ORDER BY r.pool_rank > {n}, h.{column} DESC, r.pool_rank) AS rank
              FROM rows r LEFT JOIN h{n} h USING (query_id, unit_id) WHERE r.pool_rank <= {max(n, 10)}) WHERE rank <= 10""")
    return ctes(*parts, select="\nUNION ALL ".join(selects))


@query("two_stage", _two_stage_sql())
def two_stage(t):
    u = c.units(t)
    return ex.two_stage_systems(c.questions(t), u, u, texts=c.texts(t), b="vector_b")


GRID = [
    ("settings", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {n}, {b}::DOUBLE, {g}::DOUBLE)" for i, n, b, g in ex.grid_settings())
     + ") AS s(setting, n, beta, gamma)"),
    ("wide", "SELECT * FROM rows JOIN settings ON pool_rank <= n"),
    ("blended", f"SELECT *, {c.sql_blend('beta', 'gamma', 'query_id, setting')} AS score FROM wide"),
]


@query("fusion_grid", ctes(*c.pool_ctes(50), *GRID, select="""
SELECT setting, n, beta, gamma, query_id, unit_id, rank::INTEGER AS rank, score FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id, setting ORDER BY score DESC, pool_rank) AS rank FROM blended) WHERE rank <= 10"""))
def fusion_grid(t):
    u = c.units(t)
    found = retrieve(c.questions(t), u, depth=50, texts=c.texts(t))
    return ex.fusion_grid(rescored(found, u, u, b="vector_b"))


def relevant(t):
    """The first document that contains a whole passage, for the passages that some document contains."""
    wanted = t.benchmark.select(F.col("item_id").alias("query_id"), F.lower("text").alias("lit"))
    docs = t.documents.select(F.col("doc_id").alias("unit_id"), F.col("text").alias("doc"))
    pairs = literal_hits(docs, wanted).select("unit_id", F.explode("hits").alias("lit"))
    return wanted.join(pairs, "lit").groupBy("query_id").agg(F.min("unit_id").alias("unit_id"))


SYSTEMS = [
    *[(n, "MATERIALIZED " + b if n in ("units", "questions", "gate", "bm25", "lit_hits", "tf") else b) for n, b in (c.UNITS, c.QUESTIONS, *c.GATE, *c.BM25)],
    ("q", "SELECT *, query_id IN (SELECT query_id FROM gate) AS gated FROM questions"),
    ("sims", """MATERIALIZED SELECT query_id, unit_id, gated, round(list_dot_product(qa::DOUBLE[], va::DOUBLE[]), 12) AS cos_a,
      round(list_dot_product(qb::DOUBLE[], vb::DOUBLE[]), 12) AS cos_b,
      round(list_dot_product(list_concat(list_transform(qb, lambda x: x::DOUBLE * 0.7::DOUBLE), list_transform(qa, lambda x: x::DOUBLE * (1 - 0.7::DOUBLE))),
        list_concat(vb::DOUBLE[], va::DOUBLE[])), 12) AS mixed FROM q, units"""),
    ("o_a", "MATERIALIZED SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos_a DESC, unit_id) AS rank FROM sims QUALIFY rank <= 200"),
    ("o_b", "MATERIALIZED SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos_b DESC, unit_id) AS rank FROM sims QUALIFY rank <= 200"),
    ("o_c", "MATERIALIZED SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY mixed DESC, unit_id) AS rank FROM sims QUALIFY rank <= 200"),
    ("lex", """MATERIALIZED SELECT query_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, unit_id) AS r FROM bm25
      WHERE query_id IN (SELECT query_id FROM gate) QUALIFY r <= 100"""),
    *[(f"f_{m}", f"""MATERIALIZED SELECT query_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC NULLS LAST, CASE WHEN rrf IS NULL THEN rank END, unit_id) AS rank FROM (
      SELECT query_id, unit_id, d.rank, CASE WHEN query_id IN (SELECT query_id FROM gate) AND (d.rank <= 100 OR l.r IS NOT NULL) THEN
        CASE WHEN d.rank <= 100 THEN 1.0 / (60 + d.rank::DOUBLE) ELSE 0 END + CASE WHEN l.r IS NULL THEN 0 ELSE 1.0 / (60 + l.r::DOUBLE) END END AS rrf
      FROM o_{m} d FULL JOIN lex l USING (query_id, unit_id))""")
      for m in ("a", "b")],
    ("fa", """MATERIALIZED SELECT f.query_id, f.unit_id, f.rank AS pool_rank, s.gated, cos_a, cos_b, coalesce(bm25, 0) AS bm25 FROM f_a f JOIN sims s USING (query_id, unit_id)
      LEFT JOIN bm25 USING (query_id, unit_id) WHERE f.rank <= 200"""),
    *[(f"blend{n}", f"SELECT query_id, unit_id, {c.sql_blend()} AS score FROM fa WHERE pool_rank <= {n}") for n in (10, 50)],
    ("systems", "\nUNION ALL ".join([
        *[f"SELECT '{s}' AS system, query_id, unit_id, rank FROM {o} WHERE rank <= 200" for s, o in
          (("a", "o_a"), ("b", "o_b"), ("a+bm25", "f_a"), ("b+bm25", "f_b"), ("concat", "o_c"))],
        *[f"""SELECT '{s}', query_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY rank > 10,
            CASE WHEN rank <= 10 THEN cos_b END DESC, rank) FROM (SELECT query_id, unit_id, {r} AS rank, cos_b FROM {o}) WHERE rank <= 200"""
          for s, o, r in (("two-stage", "o_a", "rank"), ("two-stage+bm25", "fa", "pool_rank"))],
        *[f"""SELECT 'fusion N={n}', query_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY pool_rank > {n}, score DESC, pool_rank)
            FROM fa LEFT JOIN blend{n} USING (query_id, unit_id)""" for n in (10, 50)]])),
    ("relevant", """SELECT item_id AS query_id, min(doc_id) AS unit_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))
      GROUP BY ALL"""),
    ("names", "SELECT DISTINCT system FROM systems"),
    ("ranks", """SELECT n.system, r.query_id, s.rank AS first_rank FROM relevant r CROSS JOIN names n
      LEFT JOIN systems s ON s.system = n.system AND s.query_id = r.query_id AND s.unit_id = r.unit_id"""),
]


@query("benchmark_systems", ctes(*SYSTEMS, select="SELECT system, query_id, unit_id, rank::INTEGER AS rank FROM systems WHERE rank <= 200"))
def benchmark_systems(t):
    return ex.benchmark_systems(c.questions(t), c.units(t), texts=c.texts(t))


@query("benchmark_metrics", ctes(*SYSTEMS, select="""
SELECT system, count(*) AS n, round(100 * avg(CASE WHEN first_rank <= 10 THEN 1 / log2(first_rank + 1) ELSE 0 END), 6) AS ndcg_at_10,
 round(100 * avg(CASE WHEN first_rank <= 10 THEN 1.0::DOUBLE / first_rank ELSE 0 END), 6) AS mrr_at_10,
 """ + ", ".join(f"round(100 * avg(CASE WHEN first_rank <= {k} THEN 1 ELSE 0 END), 6) AS recall_at_{k}" for k in (1, 5, 10, 20, 100)) + """
FROM ranks GROUP BY system"""))
def benchmark_metrics(t):
    ranks = ex.benchmark_ranks(ex.benchmark_systems(c.questions(t), c.units(t), texts=c.texts(t)), relevant(t))
    return _round(ev.benchmark_metrics(ranks), "ndcg_at_10", "mrr_at_10", *[f"recall_at_{k}" for k in (1, 5, 10, 20, 100)])


@query("grid_argmax", ctes(*c.pool_ctes(50), *GRID, SYSTEMS[-3], select="""
SELECT setting, round(mrr_at_10, 6) AS mrr_at_10, n AS pool, beta, gamma FROM (
 SELECT setting, n, beta, gamma, avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END) AS mrr_at_10
 FROM relevant CROSS JOIN settings LEFT JOIN (
  SELECT query_id, unit_id, setting, row_number() OVER (PARTITION BY query_id, setting ORDER BY score DESC, pool_rank) AS rank FROM blended) b
  USING (query_id, unit_id, setting) GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY n ORDER BY round(mrr_at_10, 6) DESC, setting) = 1"""))
def grid_argmax(t):
    u = c.units(t)
    found = retrieve(c.questions(t), u, depth=50, texts=c.texts(t))
    top = ex.fusion_grid(rescored(found, u, u, b="vector_b"))
    settings = F.array(*[F.lit(s[0]) for s in ex.grid_settings()])
    ranks = (relevant(t).withColumn("setting", F.explode(settings))
             .join(top, ["query_id", "unit_id", "setting"], "left")
             .select("query_id", "setting", F.col("rank").alias("first_rank"), F.lit(0.0).alias("gold_at_k")))
    best = ex.best_per_pool(ex.grid_metrics(ranks))
    return _round(best.select("setting", "mrr_at_10", "pool", "beta", "gamma"), "mrr_at_10")


@query("lane_search_b", ctes(*c.pool_ctes(10), select="""
SELECT query_id, unit_id, pool_rank::INTEGER AS rank, round(CASE WHEN gated THEN rrf ELSE cos_a END, 6) AS score FROM rows""")
       .replace("qa::DOUBLE", "qb::DOUBLE").replace("va::DOUBLE", "vb::DOUBLE"))
def lane_search_b(t):
    """The gated search with model B as the retriever (the other direction of the staged experiments)."""
    u = c.units(t).drop("vector").withColumnRenamed("vector_b", "vector")
    q = c.questions(t).drop("vector").withColumnRenamed("vector_b", "vector")
    return _round(search(q, u, 10, texts=c.texts(t)), "score")


@query("rrf_lists", ctes(c.UNITS, c.QUESTIONS, ("o", """SELECT query_id, unit_id, list_dot_product(qa::DOUBLE[], va::DOUBLE[]) AS x,
 list_dot_product(qb::DOUBLE[], vb::DOUBLE[]) AS y FROM questions, units"""),
                         ("r", """SELECT query_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 12) DESC, unit_id) AS ra,
 row_number() OVER (PARTITION BY query_id ORDER BY round(y, 12) DESC, unit_id) AS rb FROM o"""), select="""
SELECT query_id, unit_id, round(CASE WHEN ra <= 100 THEN 1.0 / (60 + ra::DOUBLE) ELSE 0 END + CASE WHEN rb <= 100 THEN 1.0 / (60 + rb::DOUBLE) ELSE 0 END, 6) AS rrf
FROM r WHERE ra <= 100 OR rb <= 100"""))
def rrf_lists(t):
    q, u = c.questions(t).drop("include_tests"), c.units(t).drop("is_test")
    a = dense_top_k(q, u, 100)
    b = dense_top_k(q, u, 100, query_vector="vector_b", vector="vector_b")
    return _round(fusion.rrf([a, b]), "rrf")


HALVES = {"even": "coalesce(source, '') NOT SIMILAR TO '.*[13579]'", "odd": "coalesce(source, '') SIMILAR TO '.*[13579]'"}


def _half_ranks_sql(half: str) -> str:
    """Ranks of one half of the sources under all settings: the whole chain over that half alone."""
    parts = dict(c.pool_ctes(50))
    parts = {n: "MATERIALIZED " + b if n in ("units", "questions", "gate", "bm25", "lit_hits", "tf") else b for n, b in parts.items()}

    def with_b(body: str) -> str:
        for a, b in (("qa::", "qb::"), ("va::", "vb::"), ("dense_all", "dense_b"), ("greatest(50, 100)", "greatest(10, 100)"), ("ELSE 50 END", "ELSE 10 END"), ("pool_rank <= 50", "pool_rank <= 10")):
            body = body.replace(a, b)
        return body

    parts["dense_b"], parts["pool_b"] = with_b(parts["dense_all"]), with_b(parts["pool"])
    sql = ctes(*parts.items(), *GRID, next(p for p in SYSTEMS if p[0] == "relevant"), ("tops", """
     SELECT setting, query_id, unit_id, row_number() OVER (PARTITION BY query_id, setting ORDER BY score DESC, pool_rank) AS rank FROM blended
     UNION ALL SELECT -1, query_id, unit_id, pool_rank FROM pool_b"""), select=f"""
    SELECT '{half}' AS corpus, s.setting, r.query_id, CASE WHEN rank <= 10 THEN rank END AS first_rank
    FROM relevant r CROSS JOIN (SELECT setting FROM settings UNION ALL SELECT -1) s LEFT JOIN tops USING (setting, query_id, unit_id)""")
    return re.sub(r"\bdocuments\b", f"(SELECT * FROM documents WHERE {HALVES[half]})", sql)


CROSS = [
    ("ranks", "MATERIALIZED " + "\nUNION ALL ".join(f"SELECT * FROM ({_half_ranks_sql(h)})" for h in HALVES)),
    ("metrics", """SELECT corpus, setting, count(*) AS n, """ + ", ".join(f"avg(CASE WHEN first_rank <= {k} THEN 1 ELSE 0 END) AS recall_at_{k}" for k in (1, 5, 10))
     + """, avg(CASE WHEN first_rank <= 10 THEN 1.0::DOUBLE / first_rank ELSE 0 END) AS mrr_at_10 FROM ranks GROUP BY ALL"""),
    GRID[0],
    ("best", """SELECT corpus AS fit, setting, n AS pool, beta, gamma, mrr AS fit_mrr_at_10,
      list_position([0.5, 0.7, 1.0], beta) AS bi, list_position([0.0, 0.25, 0.5], gamma) AS gi
      FROM (SELECT corpus, setting, mrr_at_10 AS mrr FROM metrics) JOIN settings USING (setting)
      QUALIFY row_number() OVER (PARTITION BY corpus, n ORDER BY round(mrr, 6) DESC, setting) = 1"""),
]


@query("cross_fit", ctes(*CROSS, select="""
SELECT b.fit, m.corpus AS test, b.pool::INTEGER AS pool, b.beta, b.gamma, round(b.fit_mrr_at_10, 6) AS fit_mrr_at_10, m.n,
 round(m.recall_at_1, 6) AS recall_at_1, round(m.recall_at_5, 6) AS recall_at_5, round(m.recall_at_10, 6) AS recall_at_10, round(m.mrr_at_10, 6) AS mrr_at_10,
 round(a.mrr_at_10, 6) AS alone_mrr_at_10, round(a.recall_at_10, 6) AS alone_recall_at_10, round(s.mrr_at_10, 6) AS staged_mrr_at_10,
 (SELECT count(*) FROM ranks x JOIN ranks y USING (corpus, query_id) WHERE x.corpus = m.corpus AND x.setting = b.setting AND y.setting = -1
   AND coalesce(x.first_rank, 99) < coalesce(y.first_rank, 99)) AS better,
 (SELECT count(*) FROM ranks x JOIN ranks y USING (corpus, query_id) WHERE x.corpus = m.corpus AND x.setting = b.setting AND y.setting = -1
   AND coalesce(x.first_rank, 99) > coalesce(y.first_rank, 99)) AS worse,
 round(m.mrr_at_10, 9) >= round(a.mrr_at_10, 9) AND round(m.recall_at_10, 9) >= round(a.recall_at_10, 9) AS accepted,
 abs(b.bi - o.bi) <= 1 AND abs(b.gi - o.gi) <= 1 AS stable
FROM best b JOIN best o ON o.pool = b.pool AND o.fit <> b.fit
JOIN metrics m ON m.setting = b.setting AND m.corpus <> b.fit JOIN metrics a ON a.corpus = m.corpus AND a.setting = -1
JOIN metrics s ON s.corpus = m.corpus AND s.setting = (SELECT setting FROM settings WHERE n = 10 AND beta = 1 AND gamma = 0)"""))
def cross_fit(t):
    """Weights fitted on the documents of the even sources and tested on those of the odd ones, and the other way round; a passage counts on a side where
    some document contains it."""
    sides = []
    for name in HALVES:
        odd = F.coalesce("source", F.lit("")).rlike("[13579]$")
        half = c.Half(t, odd if name == "odd" else ~odd)
        sides.append(ex.LabelledCorpus(name, c.questions(t), c.units(half), written(relevant(half)), c.texts(half)))
    return _round(ex.cross_fit(*sides), *DOUBLES[:4], "fit_mrr_at_10", "alone_mrr_at_10", "alone_recall_at_10", "staged_mrr_at_10")
