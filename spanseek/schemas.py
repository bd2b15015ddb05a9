"""Row types shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

UNIT = T.StructType([
    T.StructField("language", T.StringType()),
    T.StructField("root", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("qualname", T.StringType()),
    T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("signature", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("ast_hash", T.StringType()),
    T.StructField("part", T.IntegerType()),
    T.StructField("group", T.BooleanType()),
])
UNIT_KEY = ["root", "path", "start_line", "end_line", "part", "kind"]


def unit_key(units) -> list[str]:
    """Columns that name a unit; tables of one checkout may come without a root."""
    return [c for c in UNIT_KEY if c in units.columns]


VECTOR = T.ArrayType(T.FloatType(), containsNull=False)
CACHE = T.StructType([T.StructField("vector_key", T.StringType()), T.StructField("vector", VECTOR)])

GOLD = T.ArrayType(T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("qualname", T.StringType()),
]))
LABEL_FILE = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("commit", T.StringType()),
    T.StructField("created", T.StringType()),
    T.StructField("how_made", T.StringType()),
    T.StructField("hit_rule", T.StringType()),
    T.StructField("label_fixes", T.ArrayType(T.StringType())),
    T.StructField("queries", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("gold", GOLD),
    ]))),
])
SOURCE_FILE = T.StructType([
    T.StructField("root", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])
INDEX_META = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("commit", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("revision", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("max_chars", T.IntegerType()),
    T.StructField("min_chars", T.IntegerType()),
    T.StructField("n_units", T.LongType()),
    T.StructField("n_files", T.LongType()),
    T.StructField("dim", T.IntegerType()),
    T.StructField("embedded_now", T.LongType()),
    T.StructField("from_cache", T.LongType()),
    T.StructField("build_seconds", T.DoubleType()),
    T.StructField("built", T.StringType()),
])
