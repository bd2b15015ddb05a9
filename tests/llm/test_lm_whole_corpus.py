"""The network learns from every training text, not only from the sample it begins with."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from spanseek.llm import lm_scores


def test_texts_outside_the_sample_teach_the_network(spark, monkeypatch):
    monkeypatch.setattr(lm_scores, "SAMPLE_DOCS", 1)
    monkeypatch.setattr(lm_scores, "RATE", 0.02)
    words = [f"w{i}" for i in range(8)]
    ordered, rng = " ".join(words * 30), np.random.default_rng(4)
    ids = spark.range(1, 60).withColumnRenamed("id", "doc_id")
    first = ids.orderBy(F.xxhash64("doc_id"), "doc_id").first().doc_id  # the sample
    got = []
    for regular in (True, False):  # the same counts, the same sample, other orders of words elsewhere
        rows = [(0, ordered), (first, ordered)] + [(i, ordered if regular else " ".join(rng.permutation(words * 30))) for i in range(1, 60) if i != first]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
        got.append({r.doc_id: r for r in lm_scores.scores(df, F.col("doc_id") == 0).collect()}[0])
    assert got[0].base_score == got[1].base_score and got[0].n_known == got[1].n_known
    assert got[0].score > got[1].score + 1


def test_a_pass_sees_every_token_once(monkeypatch):
    monkeypatch.setattr(lm_scores, "WIDE", 3)
    net = lm_scores.Network(np.arange(1, 30)[::-1], 5)
    seen, inner = [], net._gradients
    monkeypatch.setattr(net, "_gradients", lambda read, target, fresh, h: (seen.append(read.ravel()), inner(read, target, fresh, h))[1], raising=False)
    for n in (1, 31, 64, 1000):
        seen.clear()
        net.follow(lm_scores._Steps(net), np.arange(n), np.zeros(n, int), np.zeros(n, bool))
        assert sorted(np.concatenate(seen)) == list(range(n))
