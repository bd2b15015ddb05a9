"""Personal data by proposal, confirmation and context, in DataFrame functions only.

Regular expressions propose spans (leftmost, not overlapping within a kind), validators confirm them (octet range, Luhn, digit count, mod-97), and
words near a span raise or lower its score. Kinds: email, ip, card, phone, and iban. The first four are reported whenever their validator
holds; an iban needs a score of one half.

Positions count code points from 0, the end is exclusive. A row is worked on by itself: nothing is shuffled, and repeated rows give repeated
results. Null and empty texts have no spans. Spans of different kinds may overlap; redaction replaces each covered stretch once, by the name of
its first span. Other columns are passed through by ``find`` and ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanseek.llm.common import fresh, query, table, whole

KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]

# The base expressions. Possessive forms and the condition on what stands before change no match, only the time on long runs:
# a proposal that fails at the start of a run of its first class fails everywhere in it. \G admits the place where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])",
}
PRIOR = {"email": 0.9, "ip": 0.5, "card": 0.8, "phone": 0.7, "iban": 0.8}
NEAR = {
    "email": r"(?i)\b(e-?mail|mail|contact|write|reach)\b",
    "ip": r"(?i)\b(ip|address|host|server|login|client)\b",
    "card": r"(?i)\b(card|visa|mastercard|amex|credit|payment)\b",
    "phone": r"(?i)\b(phone|tel|mobile|call|fax|whatsapp)\b",
    "iban": r"(?i)\b(iban|bank|account|transfer|bic|swift)\b",
}
AGAINST = r"(?i)\b(version|example|sample|dummy|test|order|invoice|isbn)\b"
CONTEXT = 40  # code points before and after
CHUNK = 256


def _may_hold(text: Column, kind: str) -> Column:
    """A cheap necessary condition, so that most texts never meet the expression."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "ip":
        return text.rlike(r"[0-9]\.[0-9]")
    if kind == "phone":
        return text.rlike(r"\+[0-9]")
    if kind == "card":
        return text.rlike(r"[0-9][\x20-]?[0-9]")
    return text.rlike(r"[A-Z]{2}[0-9]{2}")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, digits of the doubles added; the total divides by ten."""
    n = F.length(digits)
    terms = F.transform(F.sequence(F.lit(1), n), lambda i: F.when(
        (n - i) % 2 == 1, F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substr(digits, i, F.lit(1)).cast("int") + 1)
    ).otherwise(F.substr(digits, i, F.lit(1)).cast("int")))
    return F.aggregate(terms, F.lit(0), lambda a, b: a + b) % 10 == 0


def mod97(text: Column) -> Column:
    """Remainder of an account number with its first four signs moved to the end and letters read as 10 to 35."""
    plain = F.regexp_replace(text, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
    signs = F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.ascii(F.substr(turned, i, F.lit(1))))
    return F.aggregate(signs, F.lit(0), lambda a, c: F.when(c >= 65, (a * 100 + c - 55) % 97).otherwise((a * 10 + c - 48) % 97))


def confirmed(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.coalesce(
            F.length(F.regexp_replace(p, "^0+", "")) <= 3, F.lit(False)) & (F.expr("0") + F.coalesce(
                F.right(F.concat(F.lit("000"), p), F.lit(3)).try_cast("int"), F.lit(0)) <= 255))
    digits = _digits(match)
    if kind == "card":
        return F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.length(F.regexp_replace(match, " ", "")).between(15, 34) & (mod97(match) == 1)


def spans_of(kind: str, text: Column) -> Column:
    """Confirmed spans of one kind in order: struct(start, rank, end, kind, score).

    The matches and the pieces between them come from the same expression, so their lengths give the places. They are added up in chunks,
    so that a text with very many matches takes time n ** 1.5 at most.
    """
    rank = KINDS.index(kind)
    cut = F.struct(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("matches"), F.split(text, PATTERNS[kind], -1).alias("pieces"))

    def parts(cut: Column) -> Column:
        pieces = cut["pieces"]
        return F.transform(cut["matches"], lambda m, i: F.struct(
            m.alias("m"), F.length(F.get(pieces, i)).alias("gap"), F.length(m).alias("len"),
            F.concat(F.right(F.get(pieces, i), F.lit(CONTEXT)), F.lit(" \n "),
                     F.left(F.coalesce(F.get(pieces, i + 1), F.lit("")), F.lit(CONTEXT))).alias("near")))

    empty = "CAST(array() AS array<struct<start:int,end:int,m:string,near:string>>)"

    def placed(chunk: Column, base: Column) -> Column:
        return F.aggregate(
            chunk, F.struct(base.alias("at"), F.expr(empty).alias("out")),
            lambda a, p: F.struct(
                (a["at"] + p["gap"] + p["len"]).alias("at"),
                F.concat(a["out"], F.array(F.struct((a["at"] + p["gap"]).alias("start"), (a["at"] + p["gap"] + p["len"]).alias("end"),
                                                    p["m"].alias("m"), p["near"].alias("near")))).alias("out")),
            lambda a: a["out"])

    def all_placed(ps: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(ps) - 1) / CHUNK).cast("int")),
                             lambda c: F.slice(ps, c * CHUNK + 1, F.lit(CHUNK)))
        with_base = F.aggregate(
            chunks, F.struct(F.lit(0).alias("at"), F.expr(
                "CAST(array() AS array<struct<base:int,chunk:array<struct<m:string,gap:int,len:int,near:string>>>>)").alias("out")),
            lambda a, c: F.struct(
                (a["at"] + F.aggregate(c, F.lit(0), lambda s, p: s + p["gap"] + p["len"])).alias("at"),
                F.concat(a["out"], F.array(F.struct(a["at"].alias("base"), c.alias("chunk")))).alias("out")),
            lambda a: a["out"])
        return F.flatten(F.transform(with_base, lambda x: placed(x["chunk"], x["base"])))

    # one-element arrays hold the cut and the parts once; otherwise each use would split the text again
    found = F.flatten(F.transform(F.transform(F.array(cut), parts), lambda ps: F.when(F.size(ps) > 0, all_placed(ps)).otherwise(F.expr(empty))))
    good = F.filter(found, lambda s: confirmed(kind, s["m"]))
    scored = F.transform(good, lambda s: F.struct(
        s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"),
        F.round(F.lit(PRIOR[kind]) + F.when(s["near"].rlike(NEAR[kind]), 0.1).otherwise(0.0)
                - F.when(s["near"].rlike(AGAINST), 0.35).otherwise(0.0), 2).alias("score")))
    if kind not in BASE:
        scored = F.filter(scored, lambda s: s["score"] >= 0.5)
    none = F.expr("CAST(array() AS array<struct<start:int,rank:int,end:int,kind:string,score:double>>)")
    return F.when(_may_hold(text, kind), scored).otherwise(none)


def find(docs: DataFrame, out: str = "pii") -> DataFrame:
    """``docs`` with an array column of all spans by start, then kind."""
    text = whole()
    return docs.withColumn(out, F.array_sort(F.concat(*[spans_of(kind, text) for kind in KINDS])))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets. Texts without spans, null ones too, stay as they are."""
    spans, merged = fresh(docs, "_pii"), fresh(docs, "_stretches")
    found = find(docs, spans)
    stretches = F.aggregate(
        F.col(spans), F.expr("CAST(array() AS array<struct<start:int,end:int,kind:string>>)"),
        lambda a, s: F.when(
            (F.size(a) > 0) & (F.element_at(a, F.when(F.size(a) > 0, -1).otherwise(1))["end"] > s["start"]),
            F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))),
                     F.array(F.struct(F.element_at(a, F.when(F.size(a) > 0, -1).otherwise(1))["start"].alias("start"),
                                      F.greatest(F.element_at(a, F.when(F.size(a) > 0, -1).otherwise(1))["end"], s["end"]).alias("end"),
                                      F.element_at(a, F.when(F.size(a) > 0, -1).otherwise(1))["kind"].alias("kind")))))
        .otherwise(F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))))
    held = found.withColumn(merged, stretches)
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col(merged), i - 1)["end"])
    pieces = F.transform(F.col(merged), lambda s, i: F.concat(
        F.substr(F.col("text"), before(i) + 1, s["start"] - before(i)), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    tail = F.substr(F.col("text"), F.element_at(F.col(merged), -1)["end"] + 1)
    text = F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col("text"))
    return held.withColumn("text", text).drop(spans, merged)


_DUCK = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
}
_DUCK_OK = {
    "email": "true",
    "ip": "list_bool_and([length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(ltrim(p, '0') AS INTEGER), 0) <= 255 FOR p IN string_split(m, '.')])",
    "card": "length(dg) BETWEEN 14 AND 19 AND list_sum([CASE WHEN (length(dg) - i) % 2 = 1 THEN [0,2,4,6,8,1,3,5,7,9][CAST(dg[i] AS INTEGER) + 1] "
            "ELSE CAST(dg[i] AS INTEGER) END FOR i IN range(1, length(dg) + 1)]) % 10 = 0",
    "phone": "length(dg) BETWEEN 10 AND 15",
    "iban": f"length(plain) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, [ascii(z) FOR z IN string_split(plain[5:] || plain[1:4], '')]), "
            "lambda a, z: CASE WHEN z >= 65 THEN (a * 100 + z - 55) % 97 ELSE (a * 10 + z - 48) % 97 END) = 1 "
            f"AND {PRIOR['iban']} + CASE WHEN regexp_matches(near, '{NEAR['iban']}') THEN 0.1 ELSE 0 END "
            f"- CASE WHEN regexp_matches(near, '{AGAINST}') THEN 0.35 ELSE 0 END >= 0.5",
}


def _oracle() -> str:
    parts = []
    for rank, kind in enumerate(KINDS):
        parts.append(f"""SELECT r, {rank} AS rank, '{kind}' AS kind, s, s + length(m) AS e FROM (
            SELECT r, m, regexp_replace(m, '[^0-9]', '', 'g') AS dg, replace(m, ' ', '') AS plain,
                   right(pieces[i], {CONTEXT}) || ' ' || chr(10) || ' ' || left(coalesce(pieces[i + 1], ''), {CONTEXT}) AS near,
                   CAST(list_sum([length(x) FOR x IN pieces[1:i]]) + coalesce(list_sum([length(x) FOR x IN ms[1:i - 1]]), 0) AS BIGINT) AS s
            FROM (SELECT r, ms, pieces, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m FROM (
                SELECT r, regexp_extract_all(t, '{_DUCK[kind]}') AS ms, string_split_regex(t, '{_DUCK[kind]}') AS pieces FROM d)))
            WHERE {_DUCK_OK[kind]}""")
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)
    listing = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank)"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        f AS ({' UNION ALL '.join(parts)}),
        g AS (SELECT r, {listing} AS spans, {listing} FILTER (rank < {len(BASE)}) AS base, {counts} FROM f GROUP BY r)
        SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN g USING (r)"""


@query("op2_pii", _oracle())
def pii(spark, folder: str) -> DataFrame:
    found = find(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("pii", lambda s: s["rank"] < len(BASE))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"),
                        count("iban"))
