"""The driver tables seen as a search problem: documents are units, passages and user turns are questions."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanseek.catalogue.registry import Tables
from spanseek.encoders import GramEncoder
from spanseek.functions import text as tx
from spanseek.plans.search import searchable
from spanseek.session import scratch_folder, written
from spanseek.sources.postings import PostingsIndex
from spanseek.sources.store import StoredVectors

LETTERS = list("abcdefghijklmnopqrstuvwxyz")
PAIRS = ("th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic"
         " ne ea ra ce li ch ll be ma si om ur").split()
MODEL_A, MODEL_B = GramEncoder(LETTERS), GramEncoder(PAIRS)


@dataclass(frozen=True)
class Half:
    """The tables with one part of the documents, where several corpora are told apart."""

    tables: Tables
    kept: Column

    @property
    def benchmark(self) -> DataFrame:
        return self.tables.benchmark

    @property
    def documents(self) -> DataFrame:
        return self.tables.documents.where(self.kept)


def path_of():
    folder = F.when(F.col("lang") == "es", "tests").when(F.col("lang") == "de", "spec").otherwise("lib")
    return F.concat(F.col("source"), F.lit("/"), folder, F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".py"))


VECTORS = ("unit_id", "is_test", "vector", "vector_b")


def _described(t: Tables) -> DataFrame:
    return t.documents.select(
        F.col("doc_id").alias("unit_id"), F.lit("python").alias("language"), path_of().alias("path"), F.lit("module").alias("kind"),
        F.lit("").alias("name"), F.col("source").alias("qualname"), F.lit(1).alias("start_line"),
        tx.line_count(F.col("text")).alias("end_line"), F.lit("").alias("signature"), "text", F.lit(0).alias("part"),
        F.lit(True).alias("group"))


def texts(t: Tables) -> DataFrame:
    """What keyword scoring reads of every unit. Not stored again: each pass reads the documents."""
    return searchable(_described(t)).select("unit_id", "is_test", "doc")


def units(t: Tables, columns: tuple[str, ...] = VECTORS) -> DataFrame:
    """One unit per document, stored with the vectors of both models as an index would be: encoded once, read by every pass. Texts stay where they are
    (``texts``)."""
    d = _described(t).withColumn("vector", MODEL_A.embed(F.col("text"), "document")).withColumn("vector_b", MODEL_B.embed(F.col("text"), "document"))
    return written(searchable(d).select(*columns))


_INDEX: dict[tuple[str, str], PostingsIndex] = {}


def index(t: Tables) -> PostingsIndex:
    """The inverted index of the units, as a search finds it stored. It is built by the first query of a session that needs it for a folder; the tables of
    a folder do not change."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _INDEX:
        _INDEX[key] = PostingsIndex.build(texts(t), f"{scratch_folder(t.spark)}/index-{uuid.uuid4().hex}")
    return _INDEX[key]


_UNITS: dict[tuple[str, str], DataFrame] = {}


def stored(t: Tables) -> tuple[DataFrame, PostingsIndex]:
    """Units and their inverted index, both kept for the session as ``index`` is."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _UNITS:
        _UNITS[key] = units(t)
    return _UNITS[key], index(t)


_VECTORS: dict[tuple[str, str], StoredVectors] = {}


def stored_vectors(t: Tables) -> StoredVectors:
    """The vectors of both models, bucketed by unit."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _VECTORS:
        _VECTORS[key] = StoredVectors.save(stored(t)[0], ("vector", "vector_b"), f"{scratch_folder(t.spark)}/vectors-{uuid.uuid4().hex}")
    return _VECTORS[key]


def questions(t: Tables) -> DataFrame:
    """Every benchmark passage, line by line in quotes, and every turn of a conversation.

    Numbers of turns begin after the largest passage number and leave room for the longest conversation, so no two questions share one."""
    quoted = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " and ")
    ask = F.when(F.length("text") > 200, "which spec says ").otherwise("which document says ")
    passages = t.benchmark.select(F.col("item_id").alias("query_id"), F.lit("passage").alias("category"),
                                  F.concat(ask, quoted).alias("query"))
    first = F.coalesce(t.benchmark.agg(F.max("item_id")).scalar(), F.lit(0)) + 1
    stride = F.coalesce(t.conversations.agg(F.max("turn")).scalar(), F.lit(0)) + 1
    turns = t.conversations.select(
        (first + F.col("conv_id") * stride + F.col("turn")).alias("query_id"), F.lit("turn").alias("category"),
        F.col("text").alias("query"))
    both = passages.unionByName(turns)
    return (both.withColumn("vector", MODEL_A.embed(F.col("query"), "query"))
            .withColumn("vector_b", MODEL_B.embed(F.col("query"), "query")))


# ---- the same in SQL ------------------------------------------------------------------------------

def sql_list(items) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


def sql_vector(text: str, grams) -> str:
    raw = (f"list_transform({sql_list(grams)}, lambda g: ((length(lower({text})) - length(replace(lower({text}), g, ''))) "
           "/ length(g) + 0.001::DOUBLE)::FLOAT)")
    return (f"list_transform({raw}, lambda x: (x::DOUBLE / greatest(sqrt(list_dot_product({raw}::DOUBLE[], {raw}::DOUBLE[])), "
            "1e-12))::FLOAT)")


def sql_raw(text: str, grams) -> str:
    return (f"list_transform({sql_list(grams)}, lambda g: ((length({text}) - length(replace({text}, g, ''))) "
            "/ length(g) + 0.001::DOUBLE)::FLOAT)")


def sql_unit(raw: str) -> str:
    return (f"list_transform({raw}, lambda x: (x::DOUBLE / greatest(sqrt(list_dot_product({raw}::DOUBLE[], {raw}::DOUBLE[])), "
            "1e-12))::FLOAT)")


WORDS = r"'[A-Za-z_][A-Za-z0-9_]*|\p{Nd}+'"
SQL_PARTS = (r"list_transform(regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), "
             r"'[A-Z]?[a-z]+|[A-Z]+|\p{Nd}+'), lambda p: lower(p))")
SQL_WORD_TOKENS = (f"CASE WHEN len({SQL_PARTS}) > 1 OR contains(w, '_') THEN list_concat([lower(w)], "
                   f"list_filter({SQL_PARTS}, lambda p: p <> lower(w))) ELSE [lower(w)] END")
SQL_STOP = ("('the','a','an','of','to','in','is','and','or','for','it','this','that','where','what','how','does','do','which',"
            "'when','from','by','on','are','be','with','as','at','its')")
SQL_IS_TEST = (r"(list_has_any(list_slice(string_split(lower(path), '/'), 1, -2), ['test','tests','__tests__','spec','specs',"
               r"'e2e','__mocks__','__fixtures__','testdata']) OR regexp_matches(string_split(lower(path), '/')[-1], "
               r"'(\.|_)(test|spec)\.[a-z]+$|^test_[^/]*\.py$|_test\.py$|^conftest\.py$'))")
SQL_WANTS_TESTS = (r"regexp_matches(query, '(?i)(^|[^\p{L}\p{N}_])(tests?|specs?|testing|fixtures?|mocks?|stubs?|"
                   r"assert[\p{L}\p{N}_]*|e2e|pytest|jest|mocha|vitest)([^\p{L}\p{N}_]|$)')")
SQL_DOT = "round(list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]), 12)"


def sql_tokens(source: str, key: str, text: str) -> str:
    return (f"SELECT {key}, unnest({SQL_WORD_TOKENS}) AS term FROM "
            f"(SELECT {key}, unnest(regexp_extract_all({text}, {WORDS})) AS w FROM {source})")


UNITS = ("units", f"""
 SELECT *, {SQL_IS_TEST} AS is_test, concat(path, chr(10), qualname, chr(10), text) AS doc,
   {sql_unit('ra')} AS va, {sql_unit('rb')} AS vb
 FROM (SELECT doc_id AS unit_id, source AS qualname, text,
   concat(source, '/', CASE lang WHEN 'es' THEN 'tests' WHEN 'de' THEN 'spec' ELSE 'lib' END, '/doc', doc_id, '.py') AS path,
   {sql_raw('low', LETTERS)} AS ra, {sql_raw('low', PAIRS)} AS rb FROM (SELECT *, lower(text) AS low FROM documents))""")
QUESTIONS = ("questions", f"""
 SELECT *, {SQL_WANTS_TESTS} AS include_tests, {sql_unit('ra')} AS qa, {sql_unit('rb')} AS qb
 FROM (SELECT *, {sql_raw('lower(query)', LETTERS)} AS ra, {sql_raw('lower(query)', PAIRS)} AS rb FROM (
   SELECT item_id AS query_id, 'passage' AS category,
     concat(CASE WHEN length(text) > 200 THEN 'which spec says ' ELSE 'which document says ' END,
       list_aggregate(list_transform(string_split(text, chr(10)), lambda x: concat('"', x, '"')), 'string_agg', ' and ')) AS query
   FROM benchmark
   UNION ALL SELECT (SELECT max(item_id) + 1 FROM benchmark) + conv_id * (SELECT max(turn) + 1 FROM conversations) + turn, 'turn', text FROM conversations))""")
# every literal of every question (repeats kept), and dotted or code-shaped names outside quotes
LITERALS = ("lits", r"""
 SELECT query_id, lower(regexp_replace(m[2:-2], '^[\p{Z}\x09-\x0d\x1c-\x1f\x{85}]+|[\p{Z}\x09-\x0d\x1c-\x1f\x{85}]+$', '', 'g')) AS lit
 FROM (SELECT query_id, unnest(regexp_extract_all(query, '"[^"\n]{3,}"|''[^''\n]{3,}''|`[^`\n]{3,}`')) AS m FROM questions)""")
ANCHORS = ("anchors", r"""
 SELECT DISTINCT query_id, lower(a) AS anchor FROM (SELECT query_id, unnest(list_concat(
   list_filter(regexp_extract_all(rest, '[A-Za-z_][A-Za-z0-9_]*'),
     lambda w: (regexp_matches(w, '[^_]_+[^_]') AND length(w) > 3) OR regexp_matches(w, '[a-z][A-Z]')),
   regexp_extract_all(rest, '[A-Za-z_][\p{L}\p{N}_]*(?:\.[A-Za-z_][\p{L}\p{N}_]*)+'))) AS a
  FROM (SELECT query_id, regexp_replace(query, '"[^"\n]{3,}"|''[^''\n]{3,}''|`[^`\n]{3,}`', ' ', 'g') AS rest FROM questions))""")
CORPUS_TERMS = [
    ("tok", sql_tokens("units", "unit_id", "doc")),
    ("tf", "SELECT unit_id, term, count(*) AS tf FROM tok GROUP BY ALL"),
    ("dl", "SELECT u.unit_id, coalesce(sum(tf), 0)::BIGINT AS dl FROM units u LEFT JOIN tf USING (unit_id) GROUP BY ALL"),
    ("st", "SELECT count(*) AS n, avg(dl) AS avgdl FROM dl"),
    ("df", "SELECT term, count(*) AS df FROM tf GROUP BY ALL"),
]
LITERAL_HITS = ("lit_hits", """SELECT l.lit, u.unit_id FROM (SELECT DISTINCT lit FROM lits) l JOIN
 (SELECT unit_id, lower(doc) AS low FROM units) u ON contains(u.low, l.lit)""")
ANCHOR_PARTS = ("anchor_parts", "SELECT DISTINCT * FROM (" + sql_tokens("(SELECT anchor, anchor AS a FROM anchors)", "anchor", "a") + ")")
GATE = [
    LITERALS, ANCHORS, *CORPUS_TERMS, LITERAL_HITS, ANCHOR_PARTS,
    ("whole_anchors", """SELECT anchor FROM anchor_parts p LEFT JOIN df USING (term) GROUP BY anchor
      HAVING bool_or(p.term = anchor AND df IS NOT NULL) OR (count(*) > 1 AND bool_and(df IS NOT NULL))"""),
    ("gate", """SELECT query_id FROM lits WHERE lit IN (SELECT lit FROM lit_hits)
      UNION SELECT query_id FROM anchors WHERE anchor IN (SELECT anchor FROM whole_anchors)"""),
]
BM25 = [
    ("qterms", f"SELECT DISTINCT query_id, term FROM ({sql_tokens('questions', 'query_id', 'query')}) WHERE term NOT IN {SQL_STOP}"),
    ("parts25", """SELECT query_id, unit_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
        / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) AS w
      FROM qterms JOIN gate USING (query_id) JOIN df USING (term) JOIN tf USING (term) JOIN dl USING (unit_id), st
      UNION ALL SELECT query_id, unit_id, 2.0 * ln(1 + (n - c + 0.5) / (c + 0.5))
      FROM lits JOIN lit_hits USING (lit) JOIN (SELECT lit, count(*) AS c FROM lit_hits GROUP BY lit) USING (lit), st"""),
    ("bm25", "SELECT query_id, unit_id, round(sum(w), 9) AS bm25 FROM parts25 GROUP BY ALL"),
]
DENSE = [
    ("q", "SELECT *, query_id IN (SELECT query_id FROM gate) AS gated FROM questions"),
    ("dense_all", """SELECT query_id, unit_id, gated, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, unit_id) AS r
      FROM (SELECT query_id, unit_id, gated, round(list_dot_product(qa::DOUBLE[], va::DOUBLE[]), 12) AS sim
        FROM q JOIN units u ON include_tests OR NOT is_test)"""),
]


def pool_ctes(depth: int) -> list[tuple[str, str]]:
    """dense, lex, pool: the first ``depth`` candidates of every question."""
    return [
        UNITS, QUESTIONS, *GATE, *BM25, *DENSE,
        ("lex", """SELECT query_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, unit_id) AS r
          FROM bm25 JOIN q USING (query_id) JOIN units USING (unit_id) WHERE bm25 > 0 AND (include_tests OR NOT is_test)
          QUALIFY r <= 100"""),
        ("pool", f"""SELECT query_id, unit_id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, unit_id) AS pool_rank
          FROM (SELECT query_id, unit_id, sum(1.0 / (60 + r)) AS rrf FROM (
              SELECT query_id, unit_id, r::DOUBLE AS r FROM dense_all WHERE r <= CASE WHEN gated THEN greatest({depth}, 100) ELSE {depth} END
              UNION ALL SELECT query_id, unit_id, r::DOUBLE FROM lex) GROUP BY ALL) QUALIFY pool_rank <= {depth}"""),
        ("rows", """SELECT p.*, q.gated, q.include_tests, q.category, round(list_dot_product(qa::DOUBLE[], va::DOUBLE[]), 12) AS cos_a,
          round(list_dot_product(qb::DOUBLE[], vb::DOUBLE[]), 12) AS cos_b, coalesce(b.bm25, 0) AS bm25
          FROM pool p JOIN q USING (query_id) JOIN units USING (unit_id) LEFT JOIN bm25 b USING (query_id, unit_id)"""),
    ]


def sql_minmax(x: str, by: str = "query_id") -> str:
    return (f"CASE WHEN max({x}) OVER (PARTITION BY {by}) - min({x}) OVER (PARTITION BY {by}) > 1e-9 THEN ({x} - min({x}) OVER "
            f"(PARTITION BY {by})) / (max({x}) OVER (PARTITION BY {by}) - min({x}) OVER (PARTITION BY {by})) ELSE 0 END")


def sql_blend(beta: str = "0.7", gamma: str = "0.25", by: str = "query_id") -> str:
    g = f"(CASE WHEN gated THEN {gamma} ELSE 0 END)::DOUBLE"
    lex = "(CASE WHEN gated THEN bm25 ELSE 0 END)"
    return (f"round((1 - {g}) * ({beta}::DOUBLE * {sql_minmax('cos_b', by)} + (1 - {beta}::DOUBLE) * {sql_minmax('cos_a', by)}) "
            f"+ {g} * {sql_minmax(lex, by)}, 9)")
