"""Which units contain which quoted literal, as whole lower-cased text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanseek.functions.text import rows_of
from spanseek.session import BROADCAST_BYTES, broadcast_if_small, estimated_bytes, skew_join, written
from spanseek.sources.postings import PostingsIndex

SCAN_BYTES = 8 << 20  # literals held by every task of the scanning form
LONG_GRAM, SHORT_GRAM = 8, 3


def literal_hits(docs: DataFrame, literals: DataFrame, doc: str = "doc", scan_bytes: int = SCAN_BYTES) -> DataFrame:
    """``docs`` (unit_id, doc, ...) with ``hits array<string>``: the distinct literals (column ``lit``) each contains.

    Up to ``scan_bytes`` of literals one pass over each text finds them all. More than that are joined on a gram of the
    literal, so neither side is held by a task; literals too short for a gram stay in the scan.
    """
    wanted = literals.select("lit").distinct()
    if estimated_bytes(wanted) <= scan_bytes:
        return _scan(docs, wanted, doc)
    short = wanted.where(F.length("lit") < SHORT_GRAM)
    scanned = _scan(docs, short, doc).withColumnRenamed("hits", "_short")
    pairs = _gram_join(docs, wanted.where(F.length("lit") >= SHORT_GRAM), doc)
    found = pairs.groupBy("unit_id").agg(F.collect_set("lit").alias("_long"))
    return (scanned.join(found, "unit_id", "left")
            .withColumn("hits", F.concat("_short", F.coalesce("_long", F.array().cast("array<string>"))))
            .drop("_short", "_long"))


def _scan(docs: DataFrame, wanted: DataFrame, doc: str) -> DataFrame:
    patterns = wanted.toArrow()["lit"].to_pylist()  # size checked by the caller
    if not patterns:
        return docs.withColumn("hits", F.array().cast("array<string>"))
    shared = docs.sparkSession.sparkContext.broadcast(patterns)

    @F.pandas_udf("array<string>")
    def contained(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = _finder(shared.value)
        for texts in batches:
            yield texts.map(find)

    return docs.withColumn("hits", contained(F.coalesce(F.lower(doc), F.lit(""))))


def _finder(patterns: list[str]):
    always = [p for p in patterns if not p]
    named = [p for p in patterns if p]
    try:
        import ahocorasick
    except ImportError:
        return lambda text: always + [p for p in named if p in text]
    machine = ahocorasick.Automaton()
    for p in named:
        machine.add_word(p, p)
    if not named:
        return lambda text: always
    machine.make_automaton()
    return lambda text: always + list({p for _, p in machine.iter(text)})


def _gram_join(docs: DataFrame, wanted: DataFrame, doc: str) -> DataFrame:
    """(unit_id, lit) pairs through the rarest gram of each literal, checked against the whole text.

    A first pass counts the units that hold each gram of the literals; a second one looks up one gram per literal, the rarest. A literal with a
    gram that no unit holds is looked up nowhere.
    """
    size = F.when(F.length("lit") >= LONG_GRAM, LONG_GRAM).otherwise(SHORT_GRAM)
    places = F.sequence(F.lit(1), F.length("lit") - size + 1)
    keyed = wanted.select("lit", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(F.col("lit"), i, size)))).alias("gram"))
    low = docs.select("unit_id", F.lower(doc).alias("_low"))
    grams = F.array_distinct(F.concat(*[
        F.regexp_extract_all("_low", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in (LONG_GRAM, SHORT_GRAM)]))
    rows = low.select("unit_id", rows_of(grams).alias("gram"))
    counts = written(rows.join(broadcast_if_small(keyed.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("units")))
    rarest = keyed.join(counts, "gram", "left").groupBy("lit").agg(F.min(F.struct(F.coalesce("units", F.lit(0)).alias("units"), "gram")).alias("_g"))
    rarest = written(rarest.where("_g.units > 0").select("lit", "_g.gram"))
    found = rows.join(broadcast_if_small(rarest.select("gram").distinct()), "gram", "left_semi")
    candidates = skew_join(found, rarest, "gram", "unit_id").select("unit_id", "lit")  # one gram may be in every text
    return candidates.join(low, "unit_id").where(F.contains("_low", F.col("lit"))).select("unit_id", "lit")


_WORD_SIGN = r"[A-Za-z0-9_\p{Nd}]"
_INNER_WORD = rf"(?<=[^{_WORD_SIGN[1:-1]}])(?:[A-Za-z_][A-Za-z0-9_]*|\p{{Nd}}+)(?=[^{_WORD_SIGN[1:-1]}])"
_PIECE = "[a-z_]{3,}|[0-9]{3,}"
COMMON_WORD = 1_000  # beyond as many units a word inside a literal is not good enough, and words around a piece of it are asked for too
READ_TOKENS = 20_000_000  # about 100 MB of text
SCAN_SHARE = 0.2     # a literal whose best word is in more of the units than this is found by reading all texts


def stored_literal_units(literals: DataFrame, docs: DataFrame, index: PostingsIndex, doc: str = "doc", read_tokens: int = READ_TOKENS) -> DataFrame:
    """(lit, unit_id, is_test): the units whose lower-cased text contains each of the distinct ``literals`` (column lit).

    A word that stands inside a literal between other signs must be a word of the text, and a run of letters or digits anywhere in it must stand
    inside one word. So the literal's rarest word, or all stored words around its longest run, name the few units whose texts are compared with it.
    Literals without such a run, or with common ones only, are looked for in all texts in one pass. The rows do not depend on ``read_tokens``: a corpus of
    no more tokens is read in one job, as the jobs that find the words would take longer.
    """
    is_test = F.col("is_test") if "is_test" in docs.columns else F.lit(False)
    base = docs.where("unit_id IS NOT NULL").select("unit_id", is_test.alias("is_test"), F.coalesce(F.col(doc), F.lit("")).alias("_doc"))
    if literals.isEmpty():
        return base.limit(0).select(F.lit("").alias("lit"), "unit_id", "is_test")
    n, avgdl, has_odd = index.meta()
    if n * avgdl <= read_tokens:
        return _hit_rows(literal_hits(base, literals, "_doc"))
    terms = index.terms()
    inner = literals.select("lit", F.explode(F.array_distinct(F.regexp_extract_all("lit", F.lit(_INNER_WORD), F.lit(0)))).alias("term"))
    known = terms.join(inner.select("term").distinct(), "term", "left_semi")
    word = (inner.join(known, "term", "left").groupBy("lit")
            .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("cost"), "term")).alias("w")).select("lit", "w.*"))
    word = written(literals.join(word, "lit", "left"))
    runs = F.regexp_extract_all("lit", F.lit(_PIECE), F.lit(0))
    longest = F.reduce(runs, F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))
    vague = word.where(F.col("cost").isNull() | (F.col("cost") > COMMON_WORD)).select("lit", longest.alias("piece")).where("piece <> ''")
    around = literal_hits(terms.select(F.col("term").alias("unit_id"), F.col("term").alias("_word"), "df"), vague.select(F.col("piece").alias("lit")), "_word")
    around = written(around.select(F.explode("hits").alias("piece"), F.col("unit_id").alias("term"), "df"))
    cost = vague.join(around.groupBy("piece").agg(F.sum("df").alias("around")), "piece", "left").select(
        "lit", "piece", F.coalesce("around", F.lit(0)).alias("around"))
    chosen = written(word.join(cost, "lit", "left").select(
        "lit", "term", "piece", (F.col("around") < F.coalesce("cost", F.lit(1 << 62))).alias("by_piece"), F.least("cost", "around").alias("cost")))
    few = F.coalesce(F.col("cost") <= SCAN_SHARE * n, F.lit(False))
    asked = chosen.where(few & ~F.coalesce("by_piece", F.lit(False))).select("lit", "term").unionByName(
        chosen.where(few & F.col("by_piece")).drop("term").join(around, "piece").select("lit", "term"))
    pairs = written(index.matched(written(asked), ["term"]).select("unit_id", "lit").distinct())
    of_unit = pairs.groupBy("unit_id").agg(F.collect_list("lit").alias("_lits"))
    of_unit = F.broadcast(of_unit) if estimated_bytes(pairs) <= BROADCAST_BYTES else of_unit  # while they are few, no text moves
    near = base.join(of_unit, "unit_id").select("unit_id", "is_test", F.lower("_doc").alias("_low"), "_lits")
    out = _hit_rows(near.select("unit_id", "is_test", F.filter("_lits", lambda x: F.contains(F.col("_low"), x)).alias("hits")))
    everywhere = chosen.where(~few).select("lit")
    if not everywhere.isEmpty():
        out = out.unionByName(_hit_rows(literal_hits(base, everywhere, "_doc")))
    if has_odd:
        odd = index.odd()
        out = out.unionByName(_hit_rows(literal_hits(base.join(broadcast_if_small(odd), "unit_id", "left_semi"), literals, "_doc"))).distinct()
    return out


def _hit_rows(hits: DataFrame) -> DataFrame:
    return hits.select(rows_of(F.col("hits")).alias("lit"), "unit_id", "is_test").where("lit IS NOT NULL")
