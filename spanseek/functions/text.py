"""Column functions over text: words, anchors, predicates, keys. All of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanseek import fixed_values as fv

_NOT_COMPOSITE = r"^([A-Z]?[a-z]+|[A-Z]+|\p{Nd}+)$"
_COMPOSITE = r"(?:[A-Z]?[a-z]+|[A-Z]+)(?![A-Za-z0-9_])|([A-Za-z_][A-Za-z0-9_]*)|\p{Nd}+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{fv.WHITESPACE}+|{fv.WHITESPACE}+$", "")


def collapse(text: Column, limit: int = fv.SIGNATURE_CHARS) -> Column:
    """Whitespace runs become one space, ends trimmed, at most ``limit`` characters."""
    return F.substring(strip(F.regexp_replace(text, f"{fv.WHITESPACE}+", " ")), 1, limit)


def non_blank_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, fv.WHITESPACE, ""))


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{fv.WHITESPACE[1:]}")


def text_hash(text: Column) -> Column:
    return F.substring(F.sha2(F.regexp_replace(text, f"{fv.WHITESPACE}+", " "), 256), 1, 16)


def _word_tokens(word: Column) -> Column:
    low = F.lower(word)
    parts = F.transform(F.regexp_extract_all(word, F.lit(fv.CASE_PARTS), F.lit(0)), F.lower)
    composite = (F.size(parts) > 1) | F.contains(word, F.lit("_"))
    return F.when(word.rlike(_NOT_COMPOSITE), F.array(low)).when(
        composite, F.concat(F.array(low), F.filter(parts, lambda p: p != low))).otherwise(F.array(low))


def tokenise(text: Column) -> Column:
    """Lower-cased identifiers, each followed by its snake_case and camelCase parts. Repeats are kept: they are the tf."""
    words = F.regexp_extract_all(text, F.lit(fv.IDENTIFIER), F.lit(0))
    return F.flatten(F.transform(words, _word_tokens))


def token_bag(text: Column) -> Column:
    """The tokens of ``tokenise`` in no particular order, for long texts: plain words skip the per-word work."""
    low = F.translate(text, _UPPER, _UPPER.lower())  # ASCII only, so that word boundaries stay where they were
    words = F.regexp_extract_all(low, F.lit(fv.IDENTIFIER), F.lit(0))
    composite = F.array_remove(F.regexp_extract_all(text, F.lit(_COMPOSITE), F.lit(1)), "")
    parts = F.transform(composite, lambda w: F.slice(_word_tokens(w), F.lit(2), F.lit(2**30)))
    return F.concat(words, F.flatten(parts))


def rows_of(array: Column) -> Column:
    """One row per element, for arrays that are expensive to compute; an empty array leaves one null row.

    A plain ``explode`` makes the optimizer add a filter on the array's size below it, which computes the array twice and,
    pushed under a repartition, on too few cores.
    """
    return F.explode_outer(array)


def query_terms(query: Column) -> Column:
    """Distinct tokens in first-seen order without stop words."""
    stop = F.array(*[F.lit(w) for w in fv.STOP_WORDS])
    return F.filter(F.array_distinct(tokenise(query)), lambda t: ~F.array_contains(stop, t))


def quoted_literals(query: Column) -> Column:
    found = F.regexp_extract_all(query, F.lit(fv.QUOTED), F.lit(0))
    return F.transform(found, lambda m: F.lower(strip(F.substring(m, F.lit(2), F.length(m) - 2))))


def identifier_anchors(query: Column) -> Column:
    """snake_case and camelCase words, then dotted names, lower-cased, with quoted parts left out."""
    rest = F.regexp_replace(query, fv.QUOTED, " ")
    words = F.regexp_extract_all(rest, F.lit(fv.WORD_IN_QUERY), F.lit(0))
    shaped = F.filter(words, lambda w: (w.rlike("[^_]_+[^_]") & (F.length(w) > 3)) | w.rlike("[a-z][A-Z]"))
    dotted = F.regexp_extract_all(rest, F.lit(fv.DOTTED), F.lit(0))
    return F.transform(F.concat(shaped, dotted), F.lower)


def wants_tests(query: Column) -> Column:
    return query.rlike("(?i)" + fv.TEST_INTENT)


def tests_included(mode: Column, query: Column) -> Column:
    """Whether test files are searchable. An unknown mode is an error, as is a missing one."""
    bad = F.raise_error(F.concat(F.lit("tests must be auto, include or exclude, got "), F.coalesce(mode, F.lit("null"))))
    return (F.when(mode == "include", F.lit(True)).when(mode == "exclude", F.lit(False))
            .when(mode == "auto", wants_tests(query)).otherwise(bad.cast("boolean")))


def first_lines(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), 1, n), "\n")


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n"))


def embed_text(path: Column, kind: Column, qualname: Column, text: Column) -> Column:
    """What gets embedded: where the unit is, what it is, then its code."""
    return F.concat(strip(F.concat(path, F.lit("\n"), kind, F.lit(" "), qualname)), F.lit("\n"), text)


def lexical_text(path: Column, qualname: Column, text: Column) -> Column:
    """What keyword scoring reads; unlike the embedded text it has no kind."""
    return F.concat_ws("\n", path, qualname, text)


def vector_key(model, role: str, text: Column, precision: str = "fp32") -> Column:
    """Key of a cached vector: it covers everything that changes the vector, the exact text included."""
    head = f"{model.hf_id}@{model.revision}|{role}|{model.max_seq_length}|{precision}|{model.prompt(role)}\0"
    return F.substring(F.sha2(F.concat(F.lit(head), text), 256), 1, 32)
