"""Every stage on what its predecessor keeps, next to a plain version of it."""

from __future__ import annotations

import random
import re
import zlib

import pytest

import corpus_pipeline as cp
from llm.conftest import prose
from llm.test_set_operators import brute_join, changed
from llm.test_text_operators import base_spans

BAD = ("blasted", "wretched", "vilest")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(31)
    items = [(i, prose(9000 + i, 30)) for i in range(4)]
    docs, labels = [], []
    for i in range(260):
        words = prose(i, rng.randrange(30, 80)).split()
        toxic = i % 8 == 0
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        text = " ".join(words)
        if i % 8 == 1:
            text += f"\ncall +49 170 55{i:03d}77 or write x{i}@mail.example.org"
        if i % 8 == 2:
            text += " " + items[i % 4][1].upper() + " " + prose(20_000 + i, 10)
        docs.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, int(i % 5 > 0), int(toxic)))
    for i in range(3, 60, 8):  # near and exact copies of clean documents
        docs.append((1000 + i, changed(docs[i][1], rng, 1), "en", "src0", 1))
        docs.append((2000 + i, docs[i][1], "de", "src1", 1))
    docs += [(5000, None, None, None, None), (5001, "", "en", "src0", 0), (None, prose(77, 50), None, None, 7)]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs, items


def plain(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", (text or "").lower())


def test_stages(spark, folder, tmp_path):
    path, docs, items = folder
    assert [n for n, _ in cp.STAGES] == ["toxicity", "jaccard_join", "decontaminate", "pii", "mix"] and cp.ORACLE_SQL is None
    now, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        stage(spark, now, path).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id: r for r in now.collect()}
        if name != "mix":
            assert now.columns == list(cp.COLUMNS)
    source = {d[0]: d for d in docs}
    clean = {i for i, d in source.items() if not any(w in (d[1] or "") for w in BAD)}
    held_out = {i for i in source if i is not None and i < 260 and zlib.crc32(str(i).encode()) % 5 == 0}
    assert clean <= set(kept["toxicity"]) and not held_out & (set(kept["toxicity"]) - clean)
    rows = [(i, r.text) for i, r in kept["toxicity"].items() if i is not None]
    assert set(kept["jaccard_join"]) == {c for c, _ in brute_join(rows).values()} | {None}
    leaks = {i for i, r in kept["jaccard_join"].items() if any(plain(t) in plain(r.text) for _, t in items)}
    assert set(kept["decontaminate"]) == set(kept["jaccard_join"]) - leaks and len(leaks) > 20
    assert set(kept["pii"]) == set(kept["decontaminate"])
    for i, r in kept["pii"].items():
        before = kept["decontaminate"][i].text
        if base_spans(before or ""):
            assert base_spans(r.text) == "" and "[EMAIL]" in r.text and r.n_chars == len(r.text)
        else:
            assert (r.text, r.n_chars) == (before, kept["decontaminate"][i].n_chars)
    assert set(kept["mix"]) <= set(kept["pii"]) and all(r.copies >= 1 and r.rate > 0 for r in kept["mix"].values())
    assert all(kept["mix"][i].text == kept["pii"][i].text for i in kept["mix"])


def test_stages_on_odd_and_empty_tables(spark, odd, none, folder):
    path = folder[0]
    for _, stage in cp.STAGES:
        assert stage(spark, odd, path).count() >= 1
        assert stage(spark, none, path).count() == 0


def test_run_is_the_stages_in_a_row(spark, folder):
    got = cp.run(spark, folder[0])
    assert set(cp.COLUMNS) <= set(got.columns) and 100 < got.count() < 260
