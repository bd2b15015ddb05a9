"""Tokens, anchors, predicates, keys and corpus statistics over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanseek.catalogue import corpus as c
from spanseek.catalogue.registry import ctes, query
from spanseek.functions import paths as px
from spanseek.functions import text as tx
from spanseek.functions.vectors import idf
from spanseek.models import TEXT_MODEL
from spanseek.operators import lexical as lx
from spanseek.operators import report
from spanseek.operators.order_stats import clipped_position, floor_position, middle_position, order_statistics

WS = r"[\p{Z}\x09-\x0d\x1c-\x1f\x{85}]"
DOC_TOKENS = [("docs", "SELECT doc_id AS unit_id, text FROM documents"), ("tok", c.sql_tokens("docs", "unit_id", "text")),
              ("tf", "SELECT unit_id, term, count(*) AS tf FROM tok GROUP BY ALL")]
CODE = ("code", "SELECT page_id AS unit_id, html AS text FROM pages")


def docs(t):
    return t.documents.select(F.col("doc_id").alias("unit_id"), F.col("text").alias("doc"))


def first_page(t) -> int:
    """Pages are numbered after the last document."""
    return (t.documents.agg(F.max("doc_id")).first()[0] or 0) + 1


@query("tokens", f"""
SELECT unit_id, count(*) AS n, md5(string_agg(array_to_string(t, ' '), ' ' ORDER BY i)) AS digest FROM (
 SELECT unit_id, i, {c.SQL_WORD_TOKENS} AS t FROM (SELECT page_id AS unit_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM (
  SELECT page_id, regexp_extract_all(html, {c.WORDS}) AS w FROM pages))) GROUP BY unit_id""".replace("count(*) AS n", "sum(len(t))::BIGINT AS n"))
def tokens(t):
    """Ordered tokens of every page: their number and a digest of the sequence."""
    found = t.pages.select(F.col("page_id").alias("unit_id"), tx.tokenise(F.col("html")).alias("t"))
    return found.select("unit_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query("term_freq", ctes(*DOC_TOKENS, select="SELECT unit_id, term, tf FROM tf"))
def term_freq(t):
    return lx.term_frequency(docs(t))


@query("subtokens", ctes(CODE, ("tok", c.sql_tokens("code", "unit_id", "text")), select="SELECT unit_id, term, count(*) AS tf FROM tok GROUP BY ALL"))
def subtokens(t):
    return lx.term_frequency(t.pages.select(F.col("page_id").alias("unit_id"), F.col("html").alias("doc")))


@query("doc_length", ctes(*DOC_TOKENS, select="SELECT d.unit_id, coalesce(sum(tf), 0)::BIGINT AS dl FROM docs d LEFT JOIN tf USING (unit_id) GROUP BY ALL"))
def doc_length(t):
    return lx.unit_length(docs(t))


@query("doc_freq", ctes(*DOC_TOKENS, select="SELECT term, count(*) AS df FROM tf GROUP BY ALL"))
def doc_freq(t):
    return lx.document_frequency(docs(t))


@query("corpus_stats", ctes(*DOC_TOKENS, select="""
SELECT count(*) AS n, round(avg(dl), 6) AS avgdl FROM (SELECT d.unit_id, coalesce(sum(tf), 0) AS dl FROM docs d LEFT JOIN tf USING (unit_id) GROUP BY ALL)"""))
def corpus_stats(t):
    return lx.corpus_stats(docs(t)).select("n", F.round("avgdl", 6).alias("avgdl"))


@query("idf", ctes(*DOC_TOKENS, select="""
SELECT term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY ALL), (SELECT count(*) AS n FROM docs)"""))
def idf_of_terms(t):
    d = docs(t)
    n = d.agg(F.count(F.lit(1))).scalar()
    return lx.document_frequency(d).select("term", F.round(idf(n, F.col("df")), 6).alias("idf"))


@query("stopword_terms", ctes(("q", "SELECT conv_id * (SELECT max(turn) + 1 FROM conversations) + turn AS query_id, text AS query FROM conversations"), select=f"""
SELECT DISTINCT query_id, term FROM ({c.sql_tokens('q', 'query_id', 'query')}) WHERE term NOT IN {c.SQL_STOP}"""))
def stopword_terms(t):
    stride = (t.conversations.agg(F.max("turn")).first()[0] or 0) + 1
    return t.conversations.select((F.col("conv_id") * stride + F.col("turn")).alias("query_id"), F.explode(tx.query_terms(F.col("text"))).alias("term"))


@query("quoted_literals", ctes(("questions", "SELECT page_id AS query_id, html AS query FROM pages"), c.LITERALS,
                               select="SELECT query_id, lit, count(*) AS n FROM lits GROUP BY ALL"))
def quoted_literals(t):
    found = t.pages.select(F.col("page_id").alias("query_id"), F.explode(tx.quoted_literals(F.col("html"))).alias("lit"))
    return found.groupBy("query_id", "lit").agg(F.count(F.lit(1)).alias("n"))


@query("anchors", ctes(("questions", "SELECT doc_id AS query_id, text AS query FROM documents"), c.ANCHORS, select="SELECT query_id, anchor FROM anchors"))
def anchors(t):
    return t.documents.select(F.col("doc_id").alias("query_id"), F.explode(F.array_distinct(tx.identifier_anchors(F.col("text")))).alias("anchor"))


@query("page_anchors", ctes(("questions", "SELECT page_id AS query_id, url AS query FROM pages"), c.ANCHORS, select="SELECT query_id, anchor FROM anchors"))
def page_anchors(t):
    return t.pages.select(F.col("page_id").alias("query_id"), F.explode(F.array_distinct(tx.identifier_anchors(F.col("url")))).alias("anchor"))


@query("test_intent", f"""
SELECT conv_id, turn, {c.SQL_WANTS_TESTS.replace('query', 'text')} AS wants FROM conversations""")
def test_intent(t):
    return t.conversations.select("conv_id", "turn", tx.wants_tests(F.col("text")).alias("wants"))


@query("scope_modes", f"""
SELECT conv_id, turn, CASE role WHEN 'system' THEN true WHEN 'assistant' THEN false ELSE {c.SQL_WANTS_TESTS} END AS include_tests
FROM (SELECT *, concat(role, ' test ', text) AS query FROM conversations)""")
def scope_modes(t):
    mode = F.when(F.col("role") == "system", "include").when(F.col("role") == "assistant", "exclude").otherwise("auto")
    asked = F.concat(F.col("role"), F.lit(" test "), F.col("text"))
    return t.conversations.select("conv_id", "turn", tx.tests_included(mode, asked).alias("include_tests"))


@query("snippet", "SELECT doc_id, array_to_string(string_split(text, chr(10))[1:8], chr(10)) AS snippet FROM documents")
def snippet(t):
    return t.documents.select("doc_id", tx.first_lines(F.col("text"), 8).alias("snippet"))


@query("embed_text", f"""
SELECT doc_id, md5(concat(regexp_replace(concat(source, chr(10), lang, ' ', source), '^{WS}+|{WS}+$', '', 'g'), chr(10), text)) AS embedded,
 md5(concat(source, chr(10), lang, chr(10), text)) AS indexed FROM documents""")
def embed_text(t):
    src, lang, text = F.col("source"), F.col("lang"), F.col("text")
    return t.documents.select("doc_id", F.md5(tx.embed_text(src, lang, src, text).cast("binary")).alias("embedded"),
                              F.md5(tx.lexical_text(src, lang, text).cast("binary")).alias("indexed"))


@query("collapsed", rf"""
SELECT page_id, regexp_replace(regexp_replace(html, '{WS}+', ' ', 'g'), '^{WS}+|{WS}+$', '', 'g')[1:300] AS signature,
 sha256(regexp_replace(html, '{WS}+', ' ', 'g'))[1:16] AS text_hash, length(regexp_replace(html, '{WS}', '', 'g'))::INTEGER AS filled FROM pages""")
def collapsed(t):
    html = F.col("html")
    return t.pages.select("page_id", tx.collapse(html).alias("signature"), tx.text_hash(html).alias("text_hash"),
                          tx.non_blank_length(html).alias("filled"))


KEY_HEAD = f"{TEXT_MODEL.hf_id}@{TEXT_MODEL.revision}|document|{TEXT_MODEL.max_seq_length}|fp32|{TEXT_MODEL.document_prompt}"
SQL_KEY = f"sha256(concat('{KEY_HEAD}', chr(0), documents.text))[1:32]"


@query("vector_key", f"SELECT doc_id, {SQL_KEY} AS vector_key FROM documents")
def vector_key(t):
    return t.documents.select("doc_id", tx.vector_key(TEXT_MODEL, "document", F.col("text")).alias("vector_key"))


@query("key_dedup", f"SELECT vector_key, max(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, {SQL_KEY} AS vector_key FROM documents) GROUP BY ALL")
def key_dedup(t):
    keyed = t.documents.select("doc_id", tx.vector_key(TEXT_MODEL, "document", F.col("text")).alias("vector_key"))
    return keyed.groupBy("vector_key").agg(F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("cache_misses", f"""
SELECT DISTINCT {SQL_KEY} AS vector_key FROM documents WHERE {SQL_KEY} NOT IN (
 SELECT {SQL_KEY} FROM documents JOIN labels USING (doc_id))""")
def cache_misses(t):
    from spanseek.sources.store import missing_keys

    keyed = t.documents.withColumn("vector_key", tx.vector_key(TEXT_MODEL, "document", F.col("text")))
    cached = keyed.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    return missing_keys(keyed, cached).select("vector_key")


@query("cache_hits", f"""
SELECT doc_id, {SQL_KEY} IN (SELECT {SQL_KEY} FROM documents JOIN labels USING (doc_id)) AS cached FROM documents""")
def cache_hits(t):
    from spanseek.session import skew_join

    keyed = t.documents.select("doc_id", tx.vector_key(TEXT_MODEL, "document", F.col("text")).alias("vector_key"))
    have = keyed.join(t.labels.select("doc_id"), "doc_id", "left_semi").select("vector_key").distinct().withColumn("cached", F.lit(True))
    found = skew_join(keyed, have, "vector_key", "doc_id", "left")
    return found.select("doc_id", F.coalesce("cached", F.lit(False)).alias("cached"))


# ---- paths ------------------------------------------------------------------------------------------
PATHS = ("paths", """
 SELECT doc_id AS id, concat(source, '/', CASE lang WHEN 'es' THEN 'tests' WHEN 'de' THEN 'node_modules' WHEN 'fr' THEN 'dist' ELSE 'lib' END, '/doc', doc_id,
  ['.py', '.test.ts', '.d.ts', '_test.py', '.min.js', '.tsx', '.JSX', '', '.rs', '.bundle.js'][(n_chars % 10 + 1)::INTEGER]) AS path FROM documents
 UNION ALL SELECT (SELECT max(doc_id) + 1 FROM documents) + page_id, url FROM pages""")


def paths(t):
    folder = (F.when(F.col("lang") == "es", "tests").when(F.col("lang") == "de", "node_modules").when(F.col("lang") == "fr", "dist").otherwise("lib"))
    ends = F.array(*[F.lit(x) for x in (".py", ".test.ts", ".d.ts", "_test.py", ".min.js", ".tsx", ".JSX", "", ".rs", ".bundle.js")])
    made = t.documents.select(F.col("doc_id").alias("id"), F.concat(F.col("source"), F.lit("/"), folder, F.lit("/doc"), F.col("doc_id").cast("string"),
                              F.element_at(ends, (F.col("n_chars") % 10 + 1).cast("int"))).alias("path"))
    return made.unionByName(t.pages.select((first_page(t) + F.col("page_id")).alias("id"), F.col("url").alias("path")))


SUFFIX = r"lower(regexp_extract(string_split(path, '/')[-1], '^\.*[^.].*?(\.[^.]+)$', 1))"
LANGUAGE = (f"CASE WHEN {SUFFIX} = '.py' THEN 'python' WHEN {SUFFIX} IN ('.js','.mjs','.cjs','.jsx') THEN 'javascript' "
            f"WHEN {SUFFIX} IN ('.ts','.mts','.cts') THEN 'typescript' WHEN {SUFFIX} = '.tsx' THEN 'tsx' END")
SKIPPED = ("['.git','dist','build','vendor','.venv','venv','__pycache__','coverage','.next','.cache','bower_components','.tox',"
           "'site-packages','generated','__generated__']")


@query("path_facts", ctes(PATHS, select=f"""
SELECT id, {LANGUAGE} AS language, regexp_matches(path, '\\.d\\.[mc]?ts$') AS declaration, {c.SQL_IS_TEST} AS is_test,
 list_has_any(list_slice(string_split(path, '/'), 1, -2), {SKIPPED}) AS skipped_in_git,
 list_has_any(list_slice(string_split(path, '/'), 1, -2), list_append({SKIPPED}, 'node_modules')) AS skipped_outside,
 CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*/)', 1) ELSE '' END AS directory, string_split(path, '/')[-1] AS file FROM paths"""))
def path_facts(t):
    p = F.col("path")
    return paths(t).select("id", px.language(p).alias("language"), px.is_declaration_file(p).alias("declaration"), px.is_test_path(p).alias("is_test"),
                           px.in_skipped_dir(p, True).alias("skipped_in_git"), px.in_skipped_dir(p, False).alias("skipped_outside"),
                           px.directory(p).alias("directory"), px.file_name(p).alias("file"))


@query("minified", r"""
SELECT page_id, (regexp_matches(url, '(\.min\.js|\.bundle\.js)$') OR (len(h) / 2 > 2000 AND list_max(list_transform(
  string_split(regexp_replace(h, '(..)', '\1 ', 'g'), '0A '), lambda x: length(x) / 3)) > 1000)) AS minified
FROM (SELECT page_id, url, hex(encode(html))[1:8192] AS h FROM pages)""")
def minified(t):
    return t.pages.select("page_id", px.looks_minified(F.col("url"), F.encode("html", "UTF-8")).alias("minified"))


@query("repository_links", r"""
SELECT id, regexp_extract(link, p, 1) AS owner, regexp_extract(link, p, 2) AS name FROM (
 SELECT doc_id AS id, concat('https://github.com/', source, '/', lang, '.js.git#L', doc_id) AS link FROM documents
 UNION ALL SELECT (SELECT max(doc_id) + 1 FROM documents) + page_id, url FROM pages),
 (SELECT '^(?:https?://)?(?:www\.)?github\.com/([\w.-]+)/([\w.-]+?)(?:\.git)?/?(?:[#?].*)?$' AS p) WHERE regexp_matches(link, p)""")
def repository_links(t):
    made = t.documents.select(F.col("doc_id").alias("id"), F.concat(F.lit("  https://github.com/"), F.col("source"), F.lit("/"), F.col("lang"),
                              F.lit(".js.git#L"), F.col("doc_id").cast("string")).alias("link"))
    both = made.unionByName(t.pages.select((first_page(t) + F.col("page_id")).alias("id"), F.col("url").alias("link")))
    found = both.withColumn("r", px.github_owner_name(F.col("link"))).where(F.col("r").isNotNull())
    return found.select("id", "r.owner", "r.name")


@query("result_card", f"""
SELECT doc_id, concat(source, '/lib/') AS dir, concat('doc', doc_id, '.py') AS file, coalesce(nullif(qual, ''), '(module level)') AS name, 'python' AS lang,
 md5(array_to_string(string_split(text, chr(10))[1:14], chr(10))) AS code, greatest(0, len(string_split(text, chr(10))) - 14)::INTEGER AS hidden,
 concat('https://github.com/o/n/blob/abc/', source, '/lib/doc', doc_id, '.py#L1-L', len(string_split(text, chr(10)))) AS url
FROM (SELECT *, CASE lang WHEN 'en' THEN '' ELSE source END AS qual FROM documents)""")
def result_card(t):
    from spanseek.plans.present import cards

    path = F.concat(F.col("source"), F.lit("/lib/doc"), F.col("doc_id").cast("string"), F.lit(".py"))
    qual = F.when(F.col("lang") == "en", "").otherwise(F.col("source"))
    hits = t.documents.select("doc_id", F.lit(1).alias("rank"), path.alias("path"), F.lit("module").alias("kind"), F.lit("").alias("unit_name"), qual.alias("qualname"),
                              F.lit(1).alias("start_line"), tx.line_count(F.col("text")).alias("end_line"), "text")
    return cards(hits.withColumnRenamed("unit_name", "name_"), "o/n", "abc", name="name_").select(
        "doc_id", "dir", "file", "name", "lang", F.md5(F.col("code").cast("binary")).alias("code"), "hidden", "url")


# ---- statistics -------------------------------------------------------------------------------------
def _positions_sql(expression: str) -> str:
    return f"""SELECT event_type, count(*) AS n, max(CASE WHEN i = {expression} THEN value END) AS x FROM (
 SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n
 FROM events WHERE value IS NOT NULL) GROUP BY event_type"""


@query("percentile_floor", _positions_sql("floor(0.95::DOUBLE * (n - 1))"))
def percentile_floor(t):
    return order_statistics(t.events, "value", {"x": floor_position(0.95, F.col("n"))}, ("event_type",))


@query("percentile_upper_median", _positions_sql("n // 2"))
def percentile_upper_median(t):
    return order_statistics(t.events, "value", {"x": middle_position(F.col("n"))}, ("event_type",))


@query("percentile_clipped", _positions_sql("least(n - 1, floor(0.95::DOUBLE * n))"))
def percentile_clipped(t):
    return order_statistics(t.events, "value", {"x": clipped_position(0.95, F.col("n"))}, ("event_type",))


def as_units(t):
    return t.documents.select(F.col("lang").alias("language"), F.col("source").alias("path"), F.lit("module").alias("kind"), "text",
                              (F.col("doc_id") % 3).cast("int").alias("part"))


@query("size_report", """
SELECT units, pieces, max(CASE WHEN i = least(units - 1, floor(0.5::DOUBLE * units)) THEN chars END)::INTEGER AS p50,
 max(CASE WHEN i = least(units - 1, floor(0.95::DOUBLE * units)) THEN chars END)::INTEGER AS p95, max(chars)::INTEGER AS max_chars,
 round(avg(chars), 6) AS mean_chars, sum(chars)::DOUBLE / 4 AS approx_tokens
FROM (SELECT length(text) AS chars, row_number() OVER (ORDER BY length(text)) - 1 AS i, count(*) OVER () AS units,
 count(*) FILTER (doc_id % 3 > 0) OVER () AS pieces FROM documents) GROUP BY units, pieces""")
def size_report(t):
    return report.sizes(as_units(t)).withColumn("mean_chars", F.round("mean_chars", 6))


@query("files_by_language", "SELECT lang AS language, count(DISTINCT source) AS files FROM documents GROUP BY ALL")
def files_by_language(t):
    return report.files_by_language(as_units(t))


@query("dup_text", """
SELECT sha256(text) AS text_sha, min(source) AS first_path, max(source) AS last_path, count(*) AS copies FROM documents GROUP BY text
HAVING count(DISTINCT source) > 1""")
def dup_text(t):
    return report.copied_texts(as_units(t))


@query("coverage_lines", rf"""
SELECT path, count(*) FILTER (filled)::INTEGER AS non_blank, count(*) FILTER (filled AND ((i BETWEEN 2 AND 5) OR (i BETWEEN 5 AND n - 3)))::INTEGER AS covered
FROM (SELECT doc_id AS path, n, unnest(x) AS line, unnest(range(1, n + 1)) AS i, regexp_matches(unnest(x), '[^\p{{Z}}\x09-\x0d\x1c-\x1f\x{{85}}]') AS filled
 FROM (SELECT doc_id, string_split(text, chr(10)) AS x, len(string_split(text, chr(10))) AS n FROM documents)) GROUP BY path""")
def coverage_lines(t):
    files = t.documents.select(F.col("doc_id").alias("path"), "text")
    n = tx.line_count(F.col("text"))
    spans = F.array(F.struct(F.lit(2).alias("s"), F.least(F.lit(5), n).alias("e")), F.struct(F.lit(5).alias("s"), (n - 3).alias("e")))
    units = files.select("path", F.inline(spans)).where("s <= e").select("path", F.col("s").alias("start_line"), F.col("e").alias("end_line"))
    return report.line_coverage(files, units).select("path", "non_blank", "covered")


COVERAGE = r"""SELECT path, count(*) FILTER (filled) AS non_blank, count(*) FILTER (filled AND i BETWEEN 2 AND 5) AS covered
FROM (SELECT doc_id AS path, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS i, regexp_matches(unnest(x), '[^\p{Z}\x09-\x0d\x1c-\x1f\x{85}]') AS filled
 FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)) GROUP BY path"""


def _covered(t):
    """Documents of which lines 2 to 5 are a unit."""
    files = t.documents.select(F.col("doc_id").alias("path"), "text")
    units = files.where(tx.line_count(F.col("text")) >= 2).select("path", F.lit(2).alias("start_line"), F.least(F.lit(5), tx.line_count(F.col("text"))).alias("end_line"))
    return report.line_coverage(files, units)


@query("lowest_coverage", f"""
SELECT path, non_blank::INTEGER AS non_blank, covered::INTEGER AS covered, round(covered / non_blank, 9) AS share FROM ({COVERAGE})
WHERE non_blank >= 20 ORDER BY covered / non_blank, path LIMIT 5""")
def lowest_coverage(t):
    return report.lowest_coverage(_covered(t)).withColumn("share", F.round("share", 9))


@query("total_coverage", f"""
SELECT sum(non_blank)::BIGINT AS lines, sum(covered)::BIGINT AS covered, round(100 * sum(covered) / greatest(sum(non_blank), 1), 9) AS percent FROM ({COVERAGE})""")
def total_coverage(t):
    return report.total_coverage(_covered(t)).withColumn("percent", F.round("percent", 9))


@query("largest_units", """
SELECT doc_id, source AS path, length(text)::INTEGER AS chars FROM documents ORDER BY chars DESC, source, doc_id LIMIT 5""")
def largest_units(t):
    units = t.documents.select("doc_id", F.col("source").alias("path"), "text", F.col("doc_id").alias("start_line"), F.lit(0).alias("part"))
    return report.largest_units(units).select("doc_id", "path", "chars")


@query("units_by_kind", """
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN lang = 'en' THEN 'function' WHEN lang = 'de' THEN 'class' ELSE 'module' END AS kind FROM documents) GROUP BY kind""")
def units_by_kind(t):
    kind = F.when(F.col("lang") == "en", "function").when(F.col("lang") == "de", "class").otherwise("module")
    return report.count_by(t.documents.select(kind.alias("kind")), "kind")


@query("broken_spans", """
SELECT doc_id AS path FROM documents WHERE lang <> 'en'""")
def broken_spans(t):
    """Documents re-cut as one unit over all lines; every one whose text was altered is reported."""
    files = t.documents.select(F.col("doc_id").alias("path"), "text")
    units = t.documents.select(F.col("doc_id").alias("path"), F.lit(1).alias("start_line"), tx.line_count(F.col("text")).alias("end_line"),
                               F.when(F.col("lang") == "en", F.col("text")).otherwise(F.concat(F.col("text"), F.lit(" "))).alias("text"))
    return report.broken_spans(files, units).select("path")
