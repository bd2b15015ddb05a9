"""Identifier-aware BM25 and the gate that decides when it takes part.

A *key* is a token of the queries, or a quoted literal written with a leading quote mark, which no token has. A first pass
over the corpus counts the units per key, which decides the gate and the weights; a second one scores the units, and only
for the keys of queries whose gate fired.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanseek import fixed_values as fv
from spanseek.functions import text as tx
from spanseek.functions.vectors import SUM_DIGITS, bm25_weight, idf
from spanseek.operators.literals import literal_hits
from spanseek.operators.topk import top_k
from spanseek.session import BROADCAST_BYTES, broadcast_if_small, estimated_bytes, skew_join, written

LITERAL_MARK = '"'
EVERY_UNIT = ""  # a key each unit holds once, so that corpus size and lengths come out of the same table


def unit_tokens(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """(unit_id, term) for every token; repeats kept."""
    rows = docs.select("unit_id", tx.rows_of(tx.token_bag(F.col(doc))).alias("term"))
    return rows.where(F.col("term").isNotNull())


PART_BYTES = 16 << 20  # of text whose terms one task counts


def term_frequency(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """(unit_id, term, tf). Texts are dealt out by unit, in so many parts that what one task counts does not grow with the input."""
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-estimated_bytes(docs.select(doc)) // PART_BYTES))
    return unit_tokens(docs.repartition(parts, "unit_id"), doc).groupBy("unit_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def unit_length(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Tokens per unit; an empty unit has length 0 and still counts. No shuffle."""
    return docs.select("unit_id", F.size(tx.token_bag(F.col(doc))).cast("bigint").alias("dl"))


def document_frequency(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Units per term. Terms are made distinct inside each row, so one combined count is all that moves."""
    terms = docs.select(tx.rows_of(F.array_distinct(tx.token_bag(F.col(doc)))).alias("term"))
    return terms.where(F.col("term").isNotNull()).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(docs: DataFrame, doc: str = "doc") -> DataFrame:
    return unit_length(docs, doc).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


@dataclass(frozen=True)
class LexicalRun:
    """One query batch against one corpus. ``keys`` is query-sized and already computed; scores are a lazy corpus pass."""

    docs: DataFrame  # unit_id, is_test, _doc
    keys: DataFrame  # query_id, role, key, df, n, avgdl, gated
    small: bool  # the keys were measured and fit a broadcast; a larger batch is joined with its hot keys salted

    @property
    def gate(self) -> DataFrame:
        """query_id of the queries that name something the corpus contains."""
        return self.keys.where("gated").select("query_id").distinct()

    def weights(self, gated_only: bool = True) -> DataFrame:
        """(query_id, key, is_literal, repeats, idf, avgdl) of the terms and literals that occur in the corpus."""
        return key_weights(self.keys, gated_only)

    def scores(self, gated_only: bool = True) -> DataFrame:
        """(query_id, unit_id, is_test, bm25) of every unit that shares a key with the query; statistics ignore scope.

        Tokens that no query asks for are dropped before anything moves; the rest is partitioned by unit once, which also
        serves the aggregation to (query, unit) and leaves the top-k to prune inside each partition.
        """
        weights = written(self.weights(gated_only))
        literals = weights.where("is_literal").select(F.substring(F.col("key"), F.lit(2), F.length("key")).alias("lit"))
        found = _key_rows(self.docs, literals).select("unit_id", "is_test", "dl", tx.rows_of(F.col("found")).alias("key"))
        frequency = (found.join(weights.select("key").distinct(), "key", "left_semi").repartition("unit_id")
                     .groupBy("unit_id", "is_test", "dl", "key").agg(F.count(F.lit(1)).alias("tf")))
        joined = frequency.join(weights, "key") if self.small else skew_join(frequency, weights, "key", "unit_id")
        weight = F.when(F.col("is_literal"), F.lit(fv.LITERAL_BONUS) * F.col("idf") * F.col("repeats")).otherwise(
            bm25_weight(F.col("idf"), F.col("tf"), F.col("dl"), F.col("avgdl")))
        return (joined.withColumn("_w", weight).groupBy("query_id", "unit_id", "is_test")
                .agg(F.round(F.sum("_w"), SUM_DIGITS).alias("bm25")))

    def best(self, scope: DataFrame, depth: int, pairs: DataFrame | None = None, gated_only: bool = True) -> DataFrame:
        """(query_id, unit_id, bm25, rank): the first ``depth`` matches in scope (query_id, include_tests); ``pairs`` (query_id, unit_id) that match
        get their score too, with a null rank."""
        return best_of(self.scores(gated_only), scope, depth, pairs)


def best_of(scores: DataFrame, scope: DataFrame, depth: int, pairs: DataFrame | None = None) -> DataFrame:
    inside = scores.join(scope, "query_id").where((F.col("bm25") > 0) & (F.col("include_tests") | ~F.col("is_test")))
    top = top_k(inside, ["query_id"], [F.desc("bm25"), F.asc("unit_id")], depth).select("query_id", "unit_id", "bm25", "rank")
    if pairs is None:
        return top
    asked = _of_pairs(scores, pairs)
    return top.unionByName(asked.select("query_id", "unit_id", "bm25", F.lit(None).cast("int").alias("rank")))


def top_and_pairs(scores: DataFrame, depth: int, pairs: DataFrame) -> DataFrame:
    """As ``best_of`` where every unit is in scope, and with matches whose score rounds to zero."""
    scores = scores.where("query_id IS NOT NULL AND unit_id IS NOT NULL")  # the same filter in both uses, so that the planner can share their exchange
    top = top_k(scores, ["query_id"], [F.desc("bm25"), F.asc("unit_id")], depth).select("query_id", "unit_id", "bm25", "rank")
    return top.unionByName(_of_pairs(scores, pairs).select("query_id", "unit_id", "bm25", F.lit(None).cast("int").alias("rank")))


def _of_pairs(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """``scores`` of the pairs (query_id, unit_id). While these are few, no score has to move to meet them."""
    return scores.join(broadcast_if_small(written(pairs.select("query_id", "unit_id").distinct())), ["query_id", "unit_id"], "left_semi")


def query_keys(queries: DataFrame) -> DataFrame:
    """(query_id, role, anchor, key): what each query needs to know about the corpus. Repeats are kept for literals."""
    def entry(role, anchor, key):
        return F.struct(F.lit(role).alias("role"), anchor.cast("string").alias("anchor"), key.alias("key"))

    def parts_of(anchor):
        parts = F.array_distinct(tx.tokenise(anchor))
        return F.when(F.size(parts) > 1, F.transform(parts, lambda p: entry("part", anchor, p))).otherwise(F.array())

    none = F.lit(None)
    anchors = F.array_distinct(F.col("anchors"))
    wanted = F.concat(
        F.transform("terms", lambda t: entry("term", none, t)),
        F.transform("lits", lambda m: entry("literal", none, F.concat(F.lit(LITERAL_MARK), m))),
        F.transform(anchors, lambda a: entry("anchor", a, a)),
        F.flatten(F.transform(anchors, parts_of)))
    return (queries.select("query_id", tx.query_terms(F.col("query")).alias("terms"),
                           tx.quoted_literals(F.col("query")).alias("lits"),
                           tx.identifier_anchors(F.col("query")).alias("anchors"))
            .select("query_id", tx.rows_of(wanted).alias("w")).select("query_id", "w.*").where(F.col("key").isNotNull()))


def has_anchor_shape(query):
    return (F.size(tx.quoted_literals(query)) > 0) | (F.size(tx.identifier_anchors(query)) > 0)


def _key_rows(docs: DataFrame, literals: DataFrame) -> DataFrame:
    rows = literal_hits(docs, literals, "_doc").select("unit_id", "is_test", tx.token_bag(F.col("_doc")).alias("_t"), "hits")
    marked = F.transform("hits", lambda h: F.concat(F.lit(LITERAL_MARK), h))
    return rows.select("unit_id", "is_test", F.size("_t").cast("bigint").alias("dl"), F.concat("_t", marked).alias("found"))


def lexical_run(queries: DataFrame, docs: DataFrame, *, gated_only: bool = True, doc: str = "doc") -> LexicalRun:
    """``queries``: query_id, query. ``docs``: unit_id, doc, optionally is_test.

    With ``gated_only`` a query without any anchor shape asks nothing of the corpus. The counting pass moves one partial
    count per key and task; its result is as small as the query batch and is written.
    """
    keys = written(query_keys(queries.where(has_anchor_shape(F.col("query"))) if gated_only else queries))
    small = estimated_bytes(keys) <= BROADCAST_BYTES
    is_test = F.col("is_test") if "is_test" in docs.columns else F.lit(False)
    # stated here so that every use of a pass carries the same filter and the planner can reuse its exchange
    base = docs.where(F.col("unit_id").isNotNull()).select("unit_id", is_test.alias("is_test"), F.col(doc).alias("_doc"))
    literals = keys.where(F.col("role") == "literal").select(F.substring(F.col("key"), F.lit(2), F.length("key")).alias("lit"))
    every = F.concat(F.array(F.lit(EVERY_UNIT)), F.array_distinct("found"))
    wanted = keys.select("key").union(docs.sparkSession.range(1).select(F.lit(EVERY_UNIT).alias("key"))).distinct()
    stats = (_key_rows(base, literals).select("dl", tx.rows_of(every).alias("key"))
             .join(wanted, "key", "left_semi")
             .groupBy("key").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("total_length")))
    stats = written(stats)
    whole = stats.where(F.col("key") == EVERY_UNIT)
    n, total = whole.select("df").scalar(), whole.select("total_length").scalar()
    keys = judged_keys(keys, stats.select("key", "df"), n, total / n)
    return LexicalRun(base, written(keys), small)


def judged_keys(keys: DataFrame, found: DataFrame, n: Column, avgdl: Column) -> DataFrame:
    """``keys`` with df, n, avgdl and whether the query is gated. ``found``: key, df of the keys that the corpus holds."""
    known = F.col("df").isNotNull()
    per_anchor = Window.partitionBy("query_id", "role", "anchor")
    anchor_ok = F.when(F.col("role") == "part", F.every(known).over(per_anchor)).when(F.col("role") != "term", known)
    return (keys.repartition("query_id").join(found, "key", "left")
            .withColumn("_ok", F.coalesce(anchor_ok, F.lit(False)))
            .withColumn("gated", F.some("_ok").over(Window.partitionBy("query_id")))
            .select("query_id", "role", "key", "df", n.alias("n"), avgdl.alias("avgdl"), "gated"))


def key_weights(keys: DataFrame, gated_only: bool = True) -> DataFrame:
    """(query_id, key, is_literal, repeats, idf, avgdl) of the terms and literals that occur in the corpus."""
    rows = keys.where(F.col("df").isNotNull() & F.col("role").isin("term", "literal"))
    if gated_only:
        rows = rows.where("gated")
    return rows.groupBy("query_id", "key").agg(
        (F.first("role") == "literal").alias("is_literal"), F.count(F.lit(1)).alias("repeats"),
        idf(F.first("n"), F.first("df")).alias("idf"), F.first("avgdl").alias("avgdl"))
