"""Toxicity: linear classifier on character n-grams, each scaled by its naive Bayes log-count ratio.

Texts are lowered, everything but letters and digits becomes one blank, and the n-grams (4 to 6 bytes of UTF-8, none reaching over a blank, but
with the blank at a word's edge) are hashed to ``BUCKETS``. A text is the set of its n-grams. Fitting uses at most ``SAMPLE`` labelled rows: their
class counts per bucket are added up by Spark in slices, the buckets that tell the classes apart are kept (at most ``FEATURES``, by their chi-square),
and a logistic regression is fitted to the ratio-scaled features of the sample. Scoring reads every text once and moves nothing.

Null and empty texts have no n-gram and get the score of the intercept alone. Equal texts get equal scores; rows are never merged. Without
labelled rows of both classes the score is the share of toxic rows (0 for none). Further columns of ``docs`` are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanseek.llm.common import blocks, flat, fold_of, lowered, mixed, query, table, whole
from spanseek.session import written

BUCKETS = 1 << 20
SLICES = 64
SAMPLE = 12_000    # labelled rows that a model is fitted on at most
FEATURES = 4_000   # buckets that take part at most
SIZES = (4, 5, 6)
CHI_SQUARE = 12.0  # least evidence for a bucket

_LETTER = np.zeros(256, bool)
for _low, _high in ((48, 58), (97, 123), (128, 256)):
    _LETTER[_low:_high] = True


def grams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of every text, and the text it is in (a pair occurs as often as the n-gram)."""
    low = lowered(raw)
    letter = _LETTER[low]
    # a blank before every text, so that no n-gram reaches over two of them and first words have their edge
    padded = np.full(len(low) + len(at), 32, np.uint8)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    padded[np.arange(len(low)) + row + 1] = np.where(letter, low, 32)
    blank = padded == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[0] = True
    keep[at[:-1] + np.arange(len(at) - 1)] = True
    place = np.flatnonzero(keep)
    text, blank = padded[place].astype(np.uint64), blank[place]
    owner = np.searchsorted(at[1:] + np.arange(1, len(at)), place, side="right")
    buckets, owners = [], []
    rolled = text.copy()
    crosses = np.zeros(len(text), bool)
    for n in range(2, max(SIZES) + 1):
        if len(text) < n:
            break
        rolled = rolled[:-1] * np.uint64(257) + text[n - 1:]
        if n > 2:
            crosses = crosses[:len(text) - n + 1] | blank[n - 2:len(text) - 1]
        if n in SIZES:
            good = ~crosses[:len(rolled)]
            buckets.append((mixed(rolled[good] + np.uint64(n << 56)) >> np.uint64(44)).astype(np.int32))
            owners.append(owner[:len(rolled)][good])
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


def text_sets(raw: np.ndarray, at: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs; with ``wanted``, only its buckets."""
    bucket, owner = grams(raw, at)
    if wanted is not None:
        hit = wanted[bucket]
        bucket, owner = bucket[hit], owner[hit]
    pair = np.unique(owner.astype(np.int64) * BUCKETS + bucket)
    return pair // BUCKETS, (pair % BUCKETS).astype(np.int64)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # one per bucket, 0 where it takes no part
    intercept: float


def _class_counts(batches):
    counts = np.zeros((2, BUCKETS), np.int32)
    for block in blocks(batches, "text"):
        label = np.asarray(block.column("label")).astype(np.int64)
        owner, bucket = text_sets(*flat(block.column("text")))
        for side in (0, 1):
            counts[side] += np.bincount(bucket[label[owner] == side], minlength=BUCKETS).astype(np.int32)
    step = BUCKETS // SLICES
    for i in range(SLICES):
        part = counts[:, i * step:(i + 1) * step]
        if part.any():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "counts": pa.array([part.tobytes()], pa.binary())})


def _select(n0: int, n1: int):
    def select(frame: pd.DataFrame) -> pd.DataFrame:
        step = BUCKETS // SLICES
        total = np.zeros((2, step), np.int64)
        for raw in frame["counts"]:
            total += np.frombuffer(raw, np.int32).reshape(2, step)
        c0, c1 = total.astype(float)
        both, n = c0 + c1, n0 + n1
        expected = both * n1 / n
        chi = (c1 - expected) ** 2 / np.maximum(expected * (1 - both / n) * n0 / n, 1e-9)
        ratio = np.log((c1 + 1) / (n1 + 2)) - np.log((c0 + 1) / (n0 + 2))
        good = np.flatnonzero((both >= 3) & (both < n) & (chi >= CHI_SQUARE))
        return pd.DataFrame({"bucket": good + int(frame["slice"].iloc[0]) * step, "ratio": ratio[good], "chi": chi[good]})
    return select


def fit(docs: DataFrame, marks: DataFrame) -> Model:
    """``docs``: doc_id, text; ``marks``: doc_id, label (0 or 1). Marked ids beyond ``SAMPLE`` are left out by a hash of the id."""
    ids = (marks.where("label IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("label").cast("int").alias("label"))
           .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(SAMPLE))
    sample = (docs.select("doc_id", whole().alias("text")).join(F.broadcast(ids), "doc_id")  # SAMPLE rows at most
              .repartition(8, "doc_id").select("text", "label"))
    sample = written(sample)
    n0, n1 = sample.agg(F.expr("count_if(label = 0)"), F.expr("count_if(label = 1)")).first()
    empty = np.zeros(BUCKETS, np.float32)
    if not n0 or not n1:
        share = (n1 or 0) / max(1, (n0 or 0) + (n1 or 0))
        return Model(empty, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    counts = sample.mapInArrow(_class_counts, "slice int, counts binary")
    chosen = counts.groupBy("slice").applyInPandas(_select(n0, n1), "bucket long, ratio double, chi double")
    chosen = chosen.orderBy(F.desc("chi"), "bucket").limit(FEATURES).toPandas()  # bounded by FEATURES
    buckets, ratio = chosen["bucket"].to_numpy(np.int64), chosen["ratio"].to_numpy(float)
    rank = np.full(BUCKETS, -1, np.int32)
    rank[buckets] = np.arange(len(buckets))
    wanted = rank >= 0

    def features(batches):
        for block in blocks(batches, "text"):
            owner, bucket = text_sets(*flat(block.column("text")), wanted)
            cuts = np.searchsorted(owner, np.arange(block.num_rows + 1))
            yield pa.RecordBatch.from_pydict({
                "label": block.column("label").cast(pa.int32()),
                "features": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(rank[bucket], pa.int32()))})

    rows = sample.mapInArrow(features, "label int, features array<int>").toArrow()  # at most SAMPLE rows of FEATURES numbers
    label = np.asarray(rows["label"]).astype(float)
    lists = rows["features"].combine_chunks()
    column = np.asarray(lists.values if not isinstance(lists, pa.ChunkedArray) else lists.chunk(0).values).astype(np.int64)
    sizes = np.diff(np.asarray(lists.offsets))
    row = np.repeat(np.arange(len(label)), sizes)
    order = np.lexsort((column, row))
    weights, intercept = logistic(row[order], column[order], ratio, label, len(buckets))
    empty[buckets] = weights * ratio
    return Model(empty, intercept)


def logistic(row: np.ndarray, column: np.ndarray, scale: np.ndarray, label: np.ndarray, width: int,
             penalty: float = 1e-2, steps: int = 300) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on sparse scaled indicators by accelerated gradient steps."""
    n = len(label)
    value = scale[column] if len(column) else np.zeros(0)
    mass = np.bincount(row, value * value, minlength=n)
    step = 4.0 / (np.mean(mass) + 1 + 4 * penalty) if n else 1.0
    w, b, mw, mb = np.zeros(width), float(np.log((label.sum() + 0.5) / (n - label.sum() + 0.5))), np.zeros(width), 0.0
    loss_before = np.inf
    for _ in range(steps):
        aw, ab = w + 0.9 * mw, b + 0.9 * mb
        z = np.bincount(row, value * aw[column], minlength=n) + ab
        miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label
        gw = np.bincount(column, value * miss[row], minlength=width) / n + penalty * aw / np.sqrt(n)
        loss = float(np.mean(np.logaddexp(0, z) - label * z))
        if loss > loss_before + 1e-3:
            step, mw, mb = step / 2, np.zeros(width), 0.0
        loss_before = loss
        mw, mb = 0.9 * mw - step * gw, 0.9 * mb - step * float(miss.mean())
        w, b = w + mw, b + mb
    return w, b


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every row and its score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))  # BUCKETS numbers, whatever the input
    kept = docs.select(*keep, whole().alias("_whole_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.drop("_whole_text").schema) + ", score double"

    def run(batches):
        weights, intercept = shared.value
        wanted = weights != 0
        for block in blocks(batches, "_whole_text"):
            owner, bucket = text_sets(*flat(block.column("_whole_text")), wanted)
            z = np.bincount(owner, weights[bucket].astype(float), minlength=block.num_rows) + intercept
            value = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            yield pa.RecordBatch.from_arrays([block.column(c) for c in keep] + [pa.array(value, pa.float64())], names=[*keep, "score"])

    return kept.mapInArrow(run, schema)


def training_marks(labels: DataFrame) -> DataFrame:
    """doc_id, label outside the held-out fifth."""
    marks = labels.where("toxic IN (0, 1)").select("doc_id", F.col("toxic").alias("label"))
    return marks.where(F.col("doc_id").isNotNull() & (fold_of("doc_id", 5) != 0))


@query("op9_toxicity")
def toxicity(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = fit(docs, training_marks(table(spark, folder, "labels")))
    return (score(docs, model)
            .select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score",
                    F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted")))
