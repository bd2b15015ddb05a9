from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from llm.conftest import prose
from spanseek.llm import ann, graph, jaccard_join, mixing


def five_words(text: str | None) -> frozenset:
    ws = re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", (text or "").lower())
    return frozenset(tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def brute_join(rows):
    """doc_id -> (class, links), from all pairs."""
    sets = [(i, five_words(t)) for i, t in rows]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = Counter()
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x == y or (x and y and len(x & y) >= 0.8 * len(x | y)):
                links[a] += 1
                links[b] += 1
                up[max(root(a), root(b))] = min(root(a), root(b))
    groups: dict = {}
    for k, (i, _) in enumerate(sets):
        groups.setdefault(root(k), []).append(i)
    return {i: (min(groups[root(k)]), links[k]) for k, (i, _) in enumerate(sets)}


def changed(text: str, rng, n: int) -> str:
    ws = text.split()
    for _ in range(n):
        ws[rng.randrange(len(ws))] = rng.choice(["other", "word", "here"]) + str(rng.randrange(50))
    return " ".join(ws)


def corpus():
    rng = random.Random(9)
    texts = [prose(i, rng.randrange(20, 90)) for i in range(120)]
    for i in range(40):
        texts += [changed(texts[i], rng, n) for n in (0, 1, 2, 3)]
    hot = prose(5000, 200)
    texts += [changed(hot, rng, 3) for _ in range(150)] + [hot] * 20 + ["", None, "one two", "One, two!", "  "]
    passage = prose(6000, 30)
    texts += [prose(7000 + i, 60) + " " + passage for i in range(60)]
    return list(enumerate(texts))


def check_join(spark, rows):
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_join(rows)
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_join_equals_brute_force(spark):
    check_join(spark, corpus())


def test_join_splits_nodes_and_blocks(spark, monkeypatch):
    """Small limits send the hot group through splitting, the average test and several blocks."""
    for name, value in (("LEAF", 20), ("BLOCK_SETS", 16), ("BLOCK_RUNS", 2000)):
        monkeypatch.setattr(jaccard_join, name, value)
    check_join(spark, corpus())


def test_one_of_each_class_stays(spark, odd, none):
    rows = corpus()[:200]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, label string, _key string")
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c, _ in brute_join(rows).values()})
    stay = jaccard_join.one_of_each(odd).collect()  # repeated rows, equal texts and all that hold no word are one each
    assert len(stay) == 7 and {r.doc_id for r in stay} == {1, 2, 5, 6, 7, 8, None} and jaccard_join.one_of_each(none).count() == 0
    joined = jaccard_join.join(odd)
    assert joined.count() == 11 and joined.where("doc_id = 9").first().class_id == 8 and jaccard_join.join(none).count() == 0


def test_runs_reach_the_recall():
    for recall in (0.9, 0.999, 0.99999):
        for depth in (1, 2, 4):
            p = 1.0
            for _ in range(depth):
                p = 1 - (1 - 0.8 * p) ** jaccard_join.FAN
            n = jaccard_join.runs_for(recall, 0.8, depth=depth)
            assert 1 - (1 - p) ** n >= recall and (n == 1 or 1 - (1 - p) ** (n - 1) < recall)


def test_recall_counts_the_sketch_test():
    p = 1.0
    for _ in range(2):
        p = 1 - (1 - jaccard_join.THRESHOLD * p) ** jaccard_join.FAN
    rng = np.random.default_rng(3)
    drawn = (rng.random((200_000, jaccard_join.MINHASHES)) < 0.7).sum(1) < jaccard_join.AGREE
    assert abs(drawn.mean() - jaccard_join.gate_miss(0.7)) < 1e-3
    both = (1 - (1 - p) ** jaccard_join.RUNS) * (1 - jaccard_join.gate_miss(jaccard_join.THRESHOLD))
    assert both >= jaccard_join.RECALL and jaccard_join.gate_miss(jaccard_join.THRESHOLD) < 1e-6


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(300, 299), (5, 5)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 299: 299, 300: 299}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def true_neighbours(ids, x, asked, k):
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    out = {}
    for q in asked:
        s = u @ u[q]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def test_neighbours_recall_and_scores(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal((1500, 48)) * 0.5 + c for c in rng.standard_normal((4, 48))]).astype(np.float32)
    ids = np.arange(len(x)) * 5
    monkeypatch.setattr(ann, "PART", 300)
    docs = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    got: dict = {}
    for r in ann.search(docs, docs.where("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = true_neighbours(ids, x.astype(float), np.flatnonzero(ids % 50 == 0), 5)
    assert set(got) == set(want) and all(sorted(v) == [1, 2, 3, 4, 5] for v in got.values())
    recall = np.mean([len({v for v, _ in got[q].values()} & {v for v, _ in want[q]}) / 5 for q in want])
    assert recall >= 0.93
    at = {int(i): v.astype(float) for i, v in zip(ids, x)}
    for q in list(got)[:40]:
        for v, s in got[q].values():
            assert abs(s - at[q] @ at[v] / (np.linalg.norm(at[q]) * np.linalg.norm(at[v]))) < 1e-12


def test_neighbours_ties_bad_vectors_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (3, [2.0, 0.0]), (1, [3.0, 0.0]), (50, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [inf, 1.0]), (100, [1.0, None]),
            (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (9, [])]
    docs = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<double>, score double")
    got = [tuple(r) for r in ann.search(docs, docs.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got] == [(0, 1, 1), (0, 2, 3), (0, 3, 50), (50, 1, 0), (50, 2, 1), (50, 3, 3)]
    assert ann.search(docs.limit(0), docs.limit(0), 5).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(900)], "vec_id long, embedding array<float>")
    found = ann.search(same, same.where("vec_id % 50 = 0"), 5).where("query_id = 100").orderBy("rank").collect()
    assert [r.vec_id for r in found] == [0, 1, 2, 3, 4]


def test_rates_meet_targets(spark, tmp_path):
    rng = np.random.default_rng(5)
    n = rng.integers(1, 2000, 3000)
    p = rng.dirichlet((4, 1, 0.5), 3000)
    rows = [(int(a), *map(float, b)) for a, b in zip(n, p)]
    spark.createDataFrame(rows, "n_tokens long, p_good double, p_poor double, p_toxic double").write.parquet(f"{tmp_path}/soft")
    soft = spark.read.parquet(f"{tmp_path}/soft")
    square = lambda r, share: float(((((n * r) @ p) / n.sum() - share) ** 2).sum())
    for targets, near in (({"good": 0.6, "poor": 0.3, "toxic": 0.1}, True), ({"good": 0.85, "poor": 0.1, "toxic": 0.05}, True),
                          ({"good": 0.98, "poor": 0.01, "toxic": 0.01}, False)):
        rate, _ = mixing.replay(p, mixing.fit_rates(soft, targets))
        share = np.array([targets[d] for d in mixing.DOMAINS])
        assert (rate >= 0).all() and (not near or np.abs((n * rate) @ p / n.sum() - share).max() <= 2e-4)
        # brute force: plain projected gradient in one place
        plain, eta = np.ones(len(p)), 1 / np.linalg.eigvalsh((p * n[:, None]).T @ p).max()
        for _ in range(1000):
            plain = np.maximum(0, plain + p @ (eta * (share * n.sum() - (n * plain) @ p)))
        assert square(rate, share) <= square(plain, share) + 1e-6


def test_mixing_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 0), (7, 0, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    got = mixing.mixed(odd, labels, ("doc_id",)).collect()
    assert len(got) == 11 and all(r.rate >= 0 and abs(r.p_good + r.p_poor + r.p_toxic - 1) < 1e-5 for r in got)
    assert mixing.mixed(none, labels, ("doc_id",)).count() == 0
    even = mixing.mixed(odd, labels.limit(0), ("doc_id",)).collect()
    assert all(abs(r.p_good - 1 / 3) < 1e-6 for r in even)
    assert {r.doc_id for r in even} == {r.doc_id for r in odd.select("doc_id").collect()} and odd.where(F.col("doc_id").isNull()).count() == 1
