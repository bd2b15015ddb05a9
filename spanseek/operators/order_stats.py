"""Exact order statistics without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanseek.session import broadcast_if_small, written

BUCKETS = 64


def floor_position(q: float, n: Column) -> Column:
    """0-based position int(q * (n - 1))."""
    return F.floor(F.lit(q) * (n - 1)).cast("bigint")


def middle_position(n: Column) -> Column:
    """0-based position n // 2 (the upper median)."""
    return F.floor(n / 2).cast("bigint")


def clipped_position(q: float, n: Column) -> Column:
    """0-based position min(n - 1, int(q * n))."""
    return F.least(n - 1, F.floor(F.lit(q) * n).cast("bigint"))


def order_statistics(df: DataFrame, value: str, positions: dict[str, Column], by: tuple[str, ...] = (),
                     buckets: int = BUCKETS) -> DataFrame:
    """Values at 0-based ``positions`` (columns over ``n``, the group size) of the sorted ``value``: one row per group.

    Equal values are counted first, so a value held by a third of the rows is one row. The distinct values of each group are cut into
    buckets at that group's approximate quantiles (any cut gives the same result); bucket counts locate the bucket of each
    position, and only that bucket is ranked: about one in ``buckets`` of the group's distinct values.
    """
    keys = list(by)
    rows = written(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")))  # read four times below
    cuts = F.expr("array(" + ", ".join(f"{(i + 1) / buckets}D" for i in range(buckets - 1)) + ")")
    bounds = rows.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, cuts, 10 * buckets)).alias("_bounds"))
    if keys:
        rows = rows.join(broadcast_if_small(bounds), keys)
    else:
        rows = rows.withColumn("_bounds", bounds.scalar())
    # how many bounds lie below the value, read off where the value would be inserted
    place = F.array_position(F.sort_array(F.array_append("_bounds", F.col(value))), F.col(value))
    rows = rows.withColumn("_b", place).drop("_bounds")
    totals = rows.groupBy(*keys, "_b").agg(F.sum("_c").alias("_in"))
    through = Window.partitionBy(*keys).orderBy("_b")
    totals = (totals.withColumn("_to", F.sum("_in").over(through)).withColumn("_from", F.col("_to") - F.col("_in"))
              .withColumn("n", F.sum("_in").over(Window.partitionBy(*keys))))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), p.alias("pos")) for name, p in positions.items()])
    asked = (totals.withColumn("_w", F.explode(wanted))
             .where((F.col("_w.pos") >= F.col("_from")) & (F.col("_w.pos") < F.col("_to"))))
    asked = asked.select(*keys, "_b", "n", F.col("_w.name").alias("_name"), (F.col("_w.pos") - F.col("_from")).alias("_pos"))
    within = Window.partitionBy(*keys, "_b").orderBy(value)
    needed = rows.join(asked.select(*keys, "_b").distinct(), [*keys, "_b"], "left_semi")
    needed = needed.withColumn("_hi", F.sum("_c").over(within)).withColumn("_lo", F.col("_hi") - F.col("_c"))
    found = (needed.join(asked, [*keys, "_b"])
             .where((F.col("_pos") >= F.col("_lo")) & (F.col("_pos") < F.col("_hi"))))
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *[
        F.max(F.when(F.col("_name") == name, F.col(value))).alias(name) for name in positions])
