"""Splitting: source files that Spark derives from the documents, one definition per line of text."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanseek.catalogue.registry import query
from spanseek.operators.units import outlines, split_units
from spanseek.session import written

LINES = "SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)"


def code_files(t, suffix: str, head: str, before: str, after: str):
    """Per document: ``head``, then for each line i a definition ``line_i`` that returns the digest of the line."""
    def definition(line, i):
        return F.concat(F.lit(before.split("#")[0]), (i + 1).cast("string"), F.lit(before.split("#")[1]), F.md5(line), F.lit(after))

    body = F.array_join(F.transform(F.split("text", "\n"), definition), "")
    return written(t.documents.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(suffix)).alias("path"), F.concat(F.lit(head), body).alias("text")))


def python_files(t):
    return code_files(t, ".py", "import os\n\n\n", "def line_#():\n    return '", "'\n\n\n")


def _units(units):
    return units.select("path", "kind", "qualname", "start_line", "end_line", "part", F.col("group").alias("is_group"), "text")


@query("split_python", f"""
SELECT concat('doc', doc_id, '.py') AS path, 'module' AS kind, '' AS qualname, 1 AS start_line, 1 AS end_line, 0 AS part, true AS is_group, 'import os' AS text FROM documents
UNION ALL SELECT concat('doc', doc_id, '.py'), 'function', concat('line_', i), (4 * i)::INTEGER, (4 * i + 1)::INTEGER, 0, false,
 concat('def line_', i, '():', chr(10), '    return ''', md5(line), '''') FROM ({LINES})""")
def split_python(t):
    return _units(split_units(outlines(python_files(t))))


@query("split_javascript", f"""
SELECT concat('doc', doc_id, '.js') AS path, 'module' AS kind, '' AS qualname, 1 AS start_line, 1 AS end_line, 0 AS part, true AS is_group, 'import os from "os";' AS text FROM documents
UNION ALL SELECT concat('doc', doc_id, '.js'), 'function', concat('line_', i), (4 * i - 1)::INTEGER, (4 * i + 1)::INTEGER, 0, false,
 concat('function line_', i, '() {{', chr(10), '  return ''', md5(line), ''';', chr(10), '}}') FROM ({LINES})""")
def split_javascript(t):
    return _units(split_units(outlines(code_files(t, ".js", 'import os from "os";\n\n', "function line_#() {\n  return '", "';\n}\n\n"))))


@query("merge_tiny", f"""
SELECT concat('doc', doc_id, '.py') AS path, 'function' AS kind, concat('line_', i) AS qualname, CASE WHEN i = 1 THEN 1 ELSE 4 * i END::INTEGER AS start_line,
 (4 * i + 1)::INTEGER AS end_line, 0 AS part, false AS is_group,
 concat(CASE WHEN i = 1 THEN concat('import os', chr(10), chr(10), chr(10)) ELSE '' END, 'def line_', i, '():', chr(10), '    return ''', md5(line), '''') AS text FROM ({LINES})""")
def merge_tiny(t):
    return _units(split_units(outlines(python_files(t)), min_chars=60))


def class_files(t):
    """Per document a class whose method carries the whole text as leading comments, a member that is no definition, a function and a call.

    Two checkouts hold each of them under the same path; the second one lacks the class. A class's header reaches to its first method itself, so the
    comments above that method stand in both units."""
    text = F.concat(F.lit("class Doc:\n    tag = 1\n\n"), F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("    # "), x)), "\n"),
                    F.lit("\n    @staticmethod\n    def made(n, *, by=2):\n        return n * by\n\n    late = (\n        2,\n    )\n"))
    tail = F.lit("\ndef used(n):\n    return made(n)\n\nprint(used(3))\n")
    d = t.documents.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.concat(text, tail).alias("both"), tail.alias("one"))
    return written(d.select(F.inline(F.array(F.struct(F.lit("a").alias("root"), "path", F.col("both").alias("text")), F.struct(F.lit("b").alias("root"), "path", F.col("one").alias("text"))))))


@query("split_classes", """
WITH d AS (SELECT concat('doc', doc_id, '.py') AS path, len(string_split(text, chr(10))) AS n,
  list_aggregate(list_transform(string_split(text, chr(10)), lambda x: concat('    # ', x)), 'string_agg', chr(10)) AS notes FROM documents),
tail AS (SELECT 'a' AS root, path, n + 11 AS k FROM d UNION ALL SELECT 'b', path, 1 FROM d)
SELECT 'a' AS root, path, 'class' AS kind, 'Doc' AS qualname, 'class Doc:' AS signature, 1 AS start_line, (n + 3)::INTEGER AS end_line, 0 AS part, false AS is_group,
 concat('class Doc:', chr(10), '    tag = 1', chr(10), chr(10), notes) AS text FROM d
UNION ALL SELECT 'a', path, 'method', 'Doc.made', '@staticmethod def made(n, *, by=2):', 4, (n + 6)::INTEGER, 0, false,
 concat(notes, chr(10), '    @staticmethod', chr(10), '    def made(n, *, by=2):', chr(10), '        return n * by') FROM d
UNION ALL SELECT root, path, 'function', 'used', 'def used(n):', (k + 1)::INTEGER, (k + 2)::INTEGER, 0, false, concat('def used(n):', chr(10), '    return made(n)') FROM tail
UNION ALL SELECT root, path, 'module', '', '', (k + 4)::INTEGER, (k + 4)::INTEGER, 0, true, 'print(used(3))' FROM tail""")
def split_classes(t):
    units = split_units(outlines(class_files(t), 50_000_000), 50_000_000)  # no limit: a method holds a whole text
    return units.select("root", "path", "kind", "qualname", "signature", "start_line", "end_line", "part", F.col("group").alias("is_group"), "text")


@query("equal_code", """
SELECT CASE WHEN k = 0 THEN 'comments' WHEN k = 1 THEN 'numbers' END AS kind, count(*) AS files, count(DISTINCT CASE WHEN k = 0 THEN '' ELSE length(text)::VARCHAR END) AS hashes
FROM documents, (SELECT unnest([0, 1]) AS k) GROUP BY k""")
def equal_code(t):
    """Token hashes: a function is the same whatever comments it holds (each document's whole text), and differs with a number in it."""
    comments = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("    # "), x)), "\n")
    code = F.array(F.struct(F.lit("comments").alias("kind"), F.concat(F.lit("def f(n):\n"), comments, F.lit("\n    return n\n")).alias("text")),
                   F.struct(F.lit("numbers").alias("kind"), F.concat(F.lit("def f(n):\n    return n + "), F.length("text").cast("string"), F.lit("\n")).alias("text")))
    files = t.documents.select("doc_id", F.inline(code)).select(F.concat("kind", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), "text")
    units = split_units(outlines(written(files), 50_000_000), 50_000_000)
    return units.groupBy(F.substring_index("path", "/", 1).alias("kind")).agg(F.count_distinct("path").alias("files"), F.count_distinct("ast_hash").alias("hashes"))


LIMIT = 200


def long_files(t):
    """Per document a function with one statement for each line of the text, and a list with one element for each. All statements are of one length, and
    so are all elements."""
    def each(before: str, after: str):
        return F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit(before), F.md5(x), F.lit(after))), "\n")

    code = F.concat(F.lit("def f():\n"), each("    v = '", "'"), F.lit("\n\n\nt = [\n"), each("    '", "',"), F.lit("\n]\n"))
    return written(t.documents.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), code.alias("text")))


@query("split_limits", """
WITH d AS (SELECT concat('doc', doc_id, '.py') AS path, len(string_split(text, chr(10))) AS n,
  list_transform(string_split(text, chr(10)), lambda x: concat('    v = ''', md5(x), '''')) AS body,
  list_concat(list_concat(['t = ['], list_transform(string_split(text, chr(10)), lambda x: concat('    ''', md5(x), ''','))), [']']) AS items FROM documents)
SELECT path, 'function' AS kind, 'f' AS qualname, 1 AS start_line, (n + 1)::INTEGER AS end_line, 0 AS part, false AS is_group,
 concat('def f():', chr(10), array_to_string(body, chr(10))) AS text FROM d WHERE n <= 4
UNION ALL SELECT path, 'function', 'f', (2 + 4 * g)::INTEGER, (1 + least(4 * g + 4, n))::INTEGER, g::INTEGER, true, array_to_string(body[4 * g + 1:4 * g + 4], chr(10))
 FROM (SELECT *, unnest(range(0, (n + 3) // 4)) AS g FROM d WHERE n > 4)
UNION ALL SELECT path, 'module', '', (n + 4)::INTEGER, (2 * n + 5)::INTEGER, 0, true, array_to_string(items, chr(10)) FROM d WHERE n <= 4
UNION ALL SELECT path, 'module', '', (n + 4 + 5 * g)::INTEGER, (n + 3 + least(5 * g + 5, n + 2))::INTEGER, g::INTEGER, false, array_to_string(items[5 * g + 1:5 * g + 5], chr(10))
 FROM (SELECT *, unnest(range(0, (n + 6) // 5)) AS g FROM d WHERE n > 4)""")
def split_limits(t):
    """A limit that opens functions (four statements fit in a group) and cuts an oversized statement by its lines (five fit)."""
    return _units(split_units(outlines(long_files(t), LIMIT), LIMIT))
