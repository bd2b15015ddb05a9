"""The search plans: scope, gate, dense and lexical lanes, fusion, re-scoring and the blend, for a batch of questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanseek import fixed_values as fv
from spanseek.functions import paths as px
from spanseek.functions import text as tx
from spanseek.operators import fusion
from spanseek.operators.alignment import require_aligned, require_mode, require_weights
from spanseek.operators.lexical import LexicalRun, lexical_run
from spanseek.operators.maxscore import StoredRun, stored_run
from spanseek.operators.topk import dense_top_k
from spanseek.session import written
from spanseek.sources.postings import PostingsIndex
from spanseek.sources.store import StoredVectors


def searchable(units: DataFrame) -> DataFrame:
    """Units with ``is_test`` and the text that keyword scoring reads (``doc``)."""
    return (units.withColumn("is_test", px.is_test_path(F.col("path")))
            .withColumn("doc", tx.lexical_text(F.col("path"), F.col("qualname"), F.col("text"))))


def scoped(queries: DataFrame, mode: str = "auto") -> DataFrame:
    """Queries with ``include_tests``: a per-query ``tests`` column, where present and set, wins over ``mode``."""
    require_mode(mode)
    column = F.coalesce(F.col("tests"), F.lit(mode)) if "tests" in queries.columns else F.lit(mode)
    return queries.withColumn("include_tests", tx.tests_included(column, F.col("query")))


@dataclass(frozen=True)
class Candidates:
    """What one batch retrieved: small tables, already computed."""

    pool: DataFrame  # query_id, unit_id, rrf, pool_rank, dense_score, bm25, gated
    queries: DataFrame  # query_id, query, vector(s), include_tests, gated


def retrieve(queries: DataFrame, units: DataFrame, *, depth: int = fv.POOL, lexical: bool = True, mode: str = "auto",
             lane: int = fv.LANE_DEPTH, query_vector: str = "vector", vector: str = "vector",
             run: LexicalRun | StoredRun | None = None, index: PostingsIndex | None = None, texts: DataFrame | None = None) -> Candidates:
    """First ``depth`` candidates per query. Dense alone, or dense and BM25 fused for the queries whose gate fires.

    ``queries``: query_id, query, a vector, optionally ``tests``. ``units``: unit_id, doc, is_test and a vector. Gate and BM25
    statistics look at the whole corpus; scope only decides which units may be returned, and does so before any top-k.
    The gate is a column, so a mixed batch is one plan and ungated queries produce no lexical rows. With a stored ``index`` of the units the keyword
    side reads postings instead of texts and scores only what may be among the first ``lane``. ``texts`` (unit_id, doc, is_test) holds the texts where
    ``units`` does not.
    """
    q = written(scoped(queries, mode))
    if lexical:
        docs = units if texts is None else texts
        run = run or (lexical_run(q, docs) if index is None else stored_run(q, docs, index))
        q = q.join(run.gate.withColumn("gated", F.lit(True)), "query_id", "left") \
            .withColumn("gated", F.coalesce("gated", F.lit(False)))
    else:
        q = q.withColumn("gated", F.lit(False))
    # only the lists of gated queries are fused, and have to be deep
    asked = q.withColumn("_depth", F.when(F.col("gated"), F.lit(max(depth, lane))).otherwise(F.lit(depth)))
    flags = written(q.select("query_id", "include_tests", "gated"))
    dense = dense_top_k(asked, units, max(depth, lane) if lexical else depth, query_vector=query_vector, vector=vector, depth="_depth")
    dense = written(dense.join(flags, "query_id"))
    rankings = [dense]
    if lexical:
        # candidates of the dense lane get their keyword score too; their list is query-sized
        pairs = dense.where("gated").select("query_id", "unit_id")
        both = written(run.best(flags, lane, pairs))
        rankings.append(both.where(F.col("rank").isNotNull()))
        bm25 = both.groupBy("query_id", "unit_id").agg(F.max("bm25").alias("bm25"))
    pool = fusion.fused_pool(rankings, depth)
    pool = pool.join(dense.select("query_id", "unit_id", F.col("score").alias("dense_score")), ["query_id", "unit_id"], "left")
    pool = pool.join(bm25, ["query_id", "unit_id"], "left") if lexical else pool.withColumn("bm25", F.lit(None).cast("double"))
    pool = pool.join(flags.select("query_id", "gated"), "query_id")
    return Candidates(written(pool), q)


def search(queries: DataFrame, units: DataFrame, k: int = fv.TOP_K, **options) -> DataFrame:
    """Scoped, gated top-k of one model: (query_id, unit_id, rank, score). Score is the cosine, or the fused score when gated."""
    found = retrieve(queries, units, depth=k, **options).pool
    return found.select("query_id", "unit_id", F.col("pool_rank").alias("rank"),
                        F.when(F.col("gated"), F.col("rrf")).otherwise(F.col("dense_score")).alias("score"))


def rescored(found: Candidates, vectors_a: DataFrame | StoredVectors, vectors_b: DataFrame | None = None, *, query_a: str = "vector",
             query_b: str = "vector_b", a: str = "vector", b: str = "vector") -> DataFrame:
    """The pool with the cosine of both models; candidates of the lexical lane get theirs from the stored vectors too.

    With ``StoredVectors`` of both models, whose columns are ``a`` and ``b``, one join serves both.
    """
    if isinstance(vectors_a, StoredVectors):
        return fusion.stored_cosines(found.pool, found.queries, vectors_a, {"cos_a": (query_a, a), "cos_b": (query_b, b)})
    return fusion.with_cosines(found.pool, found.queries, {"cos_a": (query_a, vectors_a, a), "cos_b": (query_b, vectors_b, b)})


def fusion_search(queries: DataFrame, units: DataFrame, vectors_b: DataFrame | StoredVectors, k: int = fv.TOP_K, *, beta: float = fv.BETA,
                  gamma: float = fv.GAMMA, pool: int = fv.POOL, mode: str = "auto", index: PostingsIndex | None = None, texts: DataFrame | None = None) -> DataFrame:
    """The settled search: model A retrieves, model B and BM25 re-score, a per-query min-max blend orders.

    Returns query_id, unit_id, rank, score, cos_a, cos_b, bm25 (null when the gate did not fire), gated, include_tests,
    n_candidates. A query without candidates has no rows. ``vectors_b`` has unit_id and vector, or is a ``StoredVectors`` with the columns vector and
    vector_b.
    """
    require_weights(beta, gamma)
    found = retrieve(queries, units, depth=max(pool, k), mode=mode, index=index, texts=texts)
    stored = isinstance(vectors_b, StoredVectors)
    cosines = rescored(found, vectors_b, b="vector_b") if stored else rescored(found, units, vectors_b)
    rows = fusion.pool_size(cosines)
    top = fusion.blended_top(rows, k, beta=beta, gamma=gamma)
    shown = F.when(F.col("gated"), F.coalesce("bm25", F.lit(0.0))).alias("bm25")
    flags = found.queries.select("query_id", "include_tests")
    return top.join(flags, "query_id").select("query_id", "unit_id", "rank", "score", "cos_a", "cos_b", shown, "gated",
                                              "include_tests", "n_candidates")


def aligned_search(queries: DataFrame, units_a: DataFrame, units_b: DataFrame, *args, **options) -> DataFrame:
    """``fusion_search`` over two separately stored indexes, after checking that they hold the same units."""
    from spanseek.plans.index_build import vectors_for

    require_aligned(units_a, units_b)
    return fusion_search(queries, units_a, vectors_for(units_a, units_b), *args, **options)
