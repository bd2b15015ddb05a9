"""A small facade for interactive use: open a repository, ask, follow progress, cancel. One job at a time."""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanseek import fixed_values as fv
from spanseek.encoders import Encoder
from spanseek.plans.index_build import build_pair, split_checkout, vectors_for
from spanseek.plans.present import cards
from spanseek.plans.search import fusion_search
from spanseek.sources.repository import fetch, parse_link
from spanseek.sources.store import StoredIndex


class Cancelled(Exception):
    pass


@dataclass(frozen=True)
class Progress:
    stage: str = "idle"  # idle, cloning, chunking, embedding, finishing, done, error, cancelled
    message: str = ""
    units: int = 0
    error: str = ""


@dataclass(frozen=True)
class Opened:
    key: str
    label: str
    commit: str
    a: StoredIndex
    b: StoredIndex
    seconds: float


class Service:
    def __init__(self, spark: SparkSession, encoder_a: Encoder, encoder_b: Encoder, checkouts: str, caches: tuple = (None, None)) -> None:
        self.spark, self.encoders, self.checkouts, self.caches = spark, (encoder_a, encoder_b), checkouts, caches
        self.opened: dict[str, Opened] = {}
        self._progress, self._lock, self._job, self._stop = Progress(), threading.Lock(), threading.Lock(), threading.Event()

    @property
    def progress(self) -> Progress:
        with self._lock:
            return self._progress

    def _at(self, **change) -> None:
        if self._stop.is_set() and change.get("stage") not in ("cancelled", "error"):
            raise Cancelled()
        with self._lock:
            self._progress = replace(self._progress, **change)

    def cancel(self) -> None:
        """Stops between steps, and the Spark jobs of the step that is running."""
        self._stop.set()
        self.spark.sparkContext.cancelJobGroup("spanseek-index")

    def open(self, link: str) -> Opened:
        with self._job:
            self._stop.clear()
            self._progress = Progress("cloning", "fetching the repository")
            try:
                owner, name = parse_link(link)
                checkout, commit = fetch(owner, name, self.checkouts)
                got = self._index(str(checkout), f"{owner}/{name}", commit)
            except Exception as e:
                stopped = isinstance(e, Cancelled) or self._stop.is_set()
                self._at(stage="cancelled" if stopped else "error", error="" if stopped else str(e))
                raise (Cancelled() if stopped else e) from None
            return got

    def open_checkout(self, checkout: str, label: str, commit: str) -> Opened:
        with self._job:
            return self._index(checkout, label, commit)

    def _index(self, checkout: str, label: str, commit: str) -> Opened:
        began = time.perf_counter()
        self.spark.sparkContext.setJobGroup("spanseek-index", f"index {label}", interruptOnCancel=True)
        self._at(stage="chunking", message="splitting the files")
        units = split_checkout(self.spark, checkout)
        self._at(stage="embedding", message="embedding the units", units=units.count())
        a, b = build_pair(self.spark, checkout, *self.encoders, caches=self.caches, units=units)
        self._at(stage="finishing", message="opening the index", units=a.meta.first()["n_units"])
        got = Opened(label.lower().replace("/", "__"), label, commit, a, b, time.perf_counter() - began)
        self.opened[got.key] = got
        self._at(stage="done", message="ready")
        return got

    def ask(self, key: str, questions: list[str], k: int = fv.TOP_K, tests: str = "auto") -> DataFrame:
        """Result cards of a batch of questions over an opened repository, with query_id as the position in the list."""
        if key not in self.opened:
            raise KeyError(f"no opened repository {key!r}")
        repo = self.opened[key]
        q = self.spark.createDataFrame(list(enumerate(questions)), "query_id long, query string")
        q = q.withColumn("vector", self.encoders[0].embed(F.col("query"), "query")).withColumn(
            "vector_b", self.encoders[1].embed(F.col("query"), "query"))
        hits = fusion_search(q, repo.a.units, vectors_for(repo.a.units, repo.b.units), k, mode=tests)
        spans = repo.a.units.select("unit_id", "path", "kind", F.col("name").alias("unit_name"), "qualname", "start_line", "end_line", "text")
        return cards(hits.join(spans, "unit_id"), repo.label, repo.commit, name="unit_name")
