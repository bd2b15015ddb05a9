"""The entry points, end to end on a small checkout with labels."""

from __future__ import annotations

import json
import subprocess
import threading
import time

import pytest
from pyspark.sql import functions as F

from spanseek import service
from spanseek.cli import main
from spanseek.encoders import HashingEncoder, encoder_of_index
from spanseek.service import Service
from spanseek.session import written
from spanseek.sources.store import StoredIndex


def test_index_report_evaluate_and_compare(spark, tmp_path, capsys):
    repo = tmp_path / "kitchen"
    (repo / "oven").mkdir(parents=True)
    (repo / "oven" / "heat.ts").write_text("export function preheat(target: number) {\n  if (target > 300) throw new Error('too_hot_for_oven');\n  return target;\n}\n")
    (repo / "oven" / "timer.py").write_text("class Timer:\n    def remaining(self, minutes, elapsed):\n        return max(0, minutes - elapsed)\n")
    gold = {"d1": ("dev", "exact", "where is too_hot_for_oven thrown", "oven/heat.ts", 1, 4), "h1": ("holdout", "behavioural", "remaining minutes of a timer", "oven/timer.py", 2, 3)}
    labels = {"repo": "some/kitchen", "commit": "0" * 40, "created": "", "how_made": "by hand", "hit_rule": "overlap", "queries": [
        {"id": i, "split": s, "category": c, "query": q, "gold": [{"path": p, "start": a, "end": b, "qualname": ""}]} for i, (s, c, q, p, a, b) in gold.items()]}
    (tmp_path / "q.json").write_text(json.dumps(labels))
    common = ["--index", str(tmp_path / "ix"), "--labels", str(tmp_path / "q.json")]
    assert main(["index", "--root", str(repo), "--out", str(tmp_path / "ix"), "--encoder", "hashing"], spark) == 0
    assert main(["report", "--root", str(repo), "--out", str(tmp_path / "units")], spark) == 0
    assert main(["evaluate", "--out", str(tmp_path / "log"), *common], spark) == 0
    log = {r.label_id: r for r in spark.read.json(str(tmp_path / "log")).collect()}
    assert log["d1"].first_rank == 1 and log["h1"].first_rank == 1 and log["d1"].top[0].hit
    about = spark.read.json(str(tmp_path / "log.run")).first()
    assert (about.n, about["index"].n_units) == (2, StoredIndex.load(spark, str(tmp_path / "ix" / "a")).meta.first().n_units)
    assert {t.stage for t in about.latency_ms} == {"encode", "search"} and all(t.p50 > 0 for t in about.latency_ms) and log["d1"].query == gold["d1"][2]
    for command in ("ablate", "grid"):
        assert main([command, "--out", str(tmp_path / command), *common], spark) == 0
    assert spark.read.json(str(tmp_path / "ablate")).count() == 8 and spark.read.json(str(tmp_path / "grid")).count() == 54
    ask = ["search", "--index", str(tmp_path / "ix"), "--question", "where is too_hot_for_oven thrown", "--question", "remaining minutes", "--top", "1"]
    assert main([*ask, "--out", str(tmp_path / "cards")], spark) == 0
    found = {r.query_id: r.file for r in spark.read.json(str(tmp_path / "cards")).collect()}
    assert found == {0: "heat.ts", 1: "timer.py"}
    meta = StoredIndex.load(spark, str(tmp_path / "ix" / "a")).meta.first().asDict()
    assert encoder_of_index(meta).dim == 64
    for wrong in ({"model": "some/other"}, {"fingerprint": "0" * 12}):
        with pytest.raises(ValueError, match="the index was built with"):
            encoder_of_index({**meta, **wrong})
    capsys.readouterr()


def test_service_opens_a_local_checkout(spark, tmp_path):
    repo = tmp_path / "tide"
    repo.mkdir()
    (repo / "moon.py").write_text("def next_tide(hours):\n    return hours % 12\n")
    subprocess.run(["git", "init", "--quiet", str(repo)], check=True)
    subprocess.run(["git", "-C", str(repo), "add", "moon.py"], check=True)
    s = Service(spark, HashingEncoder(64, "a"), HashingEncoder(96, "b"), str(tmp_path / "checkouts"))
    got = s.open_checkout(str(repo), "Coast/Tide", "beef")
    assert s.progress.stage == "done" and got.key == "coast__tide"
    card = s.ask("coast__tide", ["hours until the next tide"]).first()
    assert (card.file, card.start, card.end, card["name"]) == ("moon.py", 1, 2, "next_tide") and card.url == "https://github.com/Coast/Tide/blob/beef/moon.py#L1-L2"
    try:
        s.ask("none", ["x"])
        raise AssertionError("an unknown repository must not answer")
    except KeyError:
        pass


def test_cancel_while_files_are_split(spark, tmp_path, monkeypatch):
    """A cancel during the splitting stops its Spark jobs, and nothing is opened."""
    repo = tmp_path / "slow"
    repo.mkdir()
    (repo / "moon.py").write_text("def next_tide(hours):\n    return hours % 12\n")
    s = Service(spark, HashingEncoder(64, "a"), HashingEncoder(96, "b"), str(tmp_path / "checkouts"))

    def slow(session, checkout):
        @F.udf("long")
        def wait(i):
            time.sleep(60)
            return i

        threading.Timer(4, s.cancel).start()
        return written(session.range(1).select(wait("id").alias("id")))

    monkeypatch.setattr(service, "fetch", lambda owner, name, folder: (repo, "beef"))
    monkeypatch.setattr(service, "split_checkout", slow)
    began = time.time()
    with pytest.raises(service.Cancelled):
        s.open("https://github.com/coast/tide")
    assert time.time() - began < 45 and s.progress.stage == "cancelled" and not s.opened
