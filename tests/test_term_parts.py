"""Counts of terms: the parts follow the input, and the rows do not depend on them."""

from spanseek.operators import lexical as lx


def test_parts_of_counts_follow_the_input(spark, monkeypatch):
    rows = [(i % 7, "red green red getName snake_case " * (i + 1)) for i in range(40)] + [(8, ""), (9, None), (None, "red")]
    docs = spark.createDataFrame(rows, "unit_id long, doc string")
    few = lx.term_frequency(docs)
    before = sorted(map(tuple, few.collect()), key=str)
    monkeypatch.setattr(lx, "PART_BYTES", 100)
    many = lx.term_frequency(docs)
    assert many.rdd.getNumPartitions() > max(few.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    assert sorted(map(tuple, many.collect()), key=str) == before
    assert lx.term_frequency(docs)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # one part a unit, whatever its terms
