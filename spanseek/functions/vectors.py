"""Column functions over ``array<float>`` vectors. Arithmetic is done in double."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from spanseek import fixed_values as fv

SCORE_DIGITS = 12  # scores are compared after rounding here, so equal vectors tie whatever the summation order
SUM_DIGITS = 9  # the same for sums that a shuffle may reorder


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _divided(v: Column, divisor) -> Column:
    """Every element over ``divisor(norm)``; the norm is computed once per vector, not once per element."""
    with_norm = let(v, lambda a: F.struct(a.alias("v"), divisor(norm(a)).alias("n")))
    return let(with_norm, lambda s: F.transform(s["v"], lambda x: (x.cast("double") / s["n"]).cast("float")))


def l2_normalise(v: Column) -> Column:
    """Unit length with no guard: a zero vector gives NaN."""
    return _divided(v, lambda n: F.when(n == 0, F.lit(float("nan"))).otherwise(n))


def l2_normalise_clipped(v: Column) -> Column:
    """Unit length, but a zero vector stays zero."""
    return _divided(v, lambda n: F.greatest(n, F.lit(fv.CLIP_NORM)))


def invalid_reason(v: Column, dim: int | None = None, tol: float = fv.UNIT_TOLERANCE) -> Column:
    """First reason why a vector cannot be indexed, or null."""
    def judge(x: Column) -> Column:
        v, length = x["v"], x["n"]
        reason = F.when(F.exists(v, lambda e: F.isnan(e) | (F.abs(e) == float("inf"))), F.lit("contains NaN or inf"))
        if dim is not None:
            wrong = F.concat(F.lit("dimension "), F.size(v).cast("string"), F.lit(f" != {dim}"))
            reason = F.when(F.size(v) != dim, wrong).otherwise(reason)
        return F.coalesce(reason, F.when(length < fv.ZERO_NORM, F.lit("zero-norm vector")).when(
            F.abs(length - 1.0) > tol, F.lit("not unit norm")))

    judged = let(let(v, lambda a: F.struct(a.alias("v"), norm(a).alias("n"))), judge)
    return F.when(v.isNull(), F.lit("missing")).otherwise(judged)


def minmax(x: Column, *by: str) -> Column:
    """Scale to [0, 1] within each ``by`` group; a group without spread becomes 0."""
    w = Window.partitionBy(*by)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(high - low > fv.MIN_SPAN, (x - low) / (high - low)).otherwise(F.lit(0.0))


def idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def bm25_weight(idf_: Column, tf: Column, dl: Column, avg: Column, k1: float = fv.BM25_K1, b: float = fv.BM25_B) -> Column:
    return idf_ * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avg))


def reciprocal_rank(rank: Column, depth: int = 10) -> Column:
    return F.when(rank <= depth, 1.0 / rank).otherwise(F.lit(0.0))


def dcg_gain(rank: Column, depth: int = 10) -> Column:
    return F.when(rank <= depth, 1.0 / F.log2(rank + F.lit(1.0))).otherwise(F.lit(0.0))
