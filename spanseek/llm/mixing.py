"""Mixing by soft membership: rates for documents whose expected token totals per domain meet target weights.

A multinomial logistic regression on hashed byte trigrams, fitted on at most ``SAMPLE`` labelled rows, gives every document a probability for each
domain (``DOMAINS``, read from the labels quality and toxic). With ``n`` the tokens of a document and ``p`` its probabilities, rates ``r >= 0``
minimize ``| sum(n * p * r) - targets |^2``, beginning at 1, by projected gradient steps with momentum in the norm weighted by tokens: a step adds
``p . g`` to a rate, whatever the document's length, and cuts it at 0. The gradient ``g`` is one number a domain, so an iteration is one sum over
a small table; a task replays the past steps instead of keeping a state, and nothing is lost with an executor.

Targets that no rates meet (every document has some share of every domain) are met as nearly as squares tell.

Null and empty texts have no tokens: their rate follows their probabilities like any other and changes no total. Repeated rows get equal rates.
Without labelled rows, all domains are equally probable. An empty table gives no rows. Tokens are runs of letters and digits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanseek.llm.common import blocks, flat, lowered, query, table, whole, words
from spanseek.session import written

DOMAINS = ("good", "poor", "toxic")
TARGETS = {"good": 0.85, "poor": 0.08, "toxic": 0.07}
WIDTH = 2048
SAMPLE = 8_000
STEPS = 150  # far targets end here, as near as that many steps come
CLOSE = 1e-4  # largest miss, as a share of all tokens
STILL = 1e-6  # targets that no rates can meet: the totals have stopped moving
ROWS = 512


def features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logarithms of hashed trigram counts, scaled to length 1; a text with none is zero."""
    rows = len(at) - 1
    out = np.zeros((rows, WIDTH), np.float32)
    if len(raw) >= 3:
        low = lowered(raw).astype(np.uint32)
        gram = ((low[:-2] * np.uint32(0x9E3779B1) + low[1:-1] * np.uint32(0x85EBCA77) + low[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - 11)).astype(np.int64)
        row = np.repeat(np.arange(rows), np.diff(at))
        inside = row[:-2] == row[2:]
        out[:] = np.log1p(np.bincount(row[:-2][inside] * WIDTH + gram[inside], minlength=rows * WIDTH).reshape(rows, WIDTH))
        out /= np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-9)
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # WIDTH x domains
    bias: np.ndarray


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """``labels``: doc_id, quality, toxic. Ids beyond ``SAMPLE`` are left out by a hash of the id."""
    k = len(DOMAINS)
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    ids = (labels.select("doc_id", domain.alias("domain")).where("domain IS NOT NULL AND doc_id IS NOT NULL")
           .orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(SAMPLE))
    sample = docs.select("doc_id", whole().alias("text")).join(F.broadcast(ids), "doc_id")  # SAMPLE rows at most

    def run(batches):
        for block in blocks(batches, "text"):
            for s in range(0, block.num_rows, ROWS):
                part = block.slice(s, ROWS)
                x = features(*flat(part.column("text"))).astype(np.float16)
                yield pa.RecordBatch.from_pydict({"domain": part.column("domain").cast(pa.int32()), "x": pa.array([v.tobytes() for v in x], pa.binary())})

    rows = sample.mapInArrow(run, "domain int, x binary").toArrow()  # SAMPLE rows of WIDTH half-floats
    if rows.num_rows == 0:
        return Model(np.zeros((WIDTH, k)), np.zeros(k))
    x = np.stack([np.frombuffer(v, np.float16) for v in rows["x"].to_pylist()]).astype(np.float32)
    y = np.eye(k, dtype=np.float32)[np.asarray(rows["domain"])]
    order = np.lexsort((x[:, :4].sum(1), y.argmax(1)))  # the sums below do not depend on how rows arrived
    x, y = x[order], y[order]
    w, b = np.zeros((WIDTH, k), np.float32), np.log((y.sum(0) + 1) / (len(y) + k)).astype(np.float32)
    mw, mb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(250):
        z = x @ (w + 0.9 * mw) + b + 0.9 * mb
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        miss = (p - y) / len(y)
        mw = 0.9 * mw - 4.0 * (x.T @ miss + 1e-4 * w)
        mb = 0.9 * mb - 0.5 * miss.sum(0)
        w, b = w + mw, b + mb
    return Model(w.astype(float), b.astype(float))


def posteriors(docs: DataFrame, model: Model, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns, n_tokens and one probability a domain (p_<domain>) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))  # WIDTH rows
    rows = docs.select(*keep, whole().alias("_text"))
    names = [f"p_{d}" for d in DOMAINS]

    def run(batches):
        w, b = shared.value
        for block in blocks(batches, "_text"):
            for s in range(0, block.num_rows, ROWS):
                part = block.slice(s, ROWS)
                raw, at = flat(part.column("_text"))
                z = features(raw, at) @ w + b
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                tokens = np.bincount(words(raw, at)[2], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(tokens, pa.int64()), *[pa.array(v) for v in p.T.astype(float)]],
                                                 names=[*keep, "n_tokens", *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_text").schema)
    return rows.mapInArrow(run, f"{schema}, n_tokens long, " + ", ".join(f"{n} double" for n in names))


def replay(p: np.ndarray, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the steps, and the point ahead of them that the next gradient is taken at."""
    rate = np.ones(len(p))
    ahead = rate
    for t, g in enumerate(steps):
        after = np.maximum(0.0, ahead + p @ g)
        ahead = np.maximum(0.0, after + t / (t + 3) * (after - rate))
        rate = after
    return rate, ahead


def fit_rates(soft: DataFrame, targets: dict[str, float]) -> list[np.ndarray]:
    """The steps that lead to the rates. ``soft``: n_tokens and p_<domain>, as a written table."""
    names = [f"p_{d}" for d in DOMAINS]
    moments = soft.agg(F.sum("n_tokens"), *[F.sum(F.col("n_tokens") * F.col(a) * F.col(b)) for a in names for b in names]).first()
    total = moments[0] or 0
    if not total:
        return []
    k = len(DOMAINS)
    step = 1.0 / np.linalg.eigvalsh(np.array(moments[1:], float).reshape(k, k)).max()
    share = np.array([targets.get(d, 0.0) for d in DOMAINS])
    wanted = share / share.sum() * total
    steps: list[np.ndarray] = []
    before = np.full(k, np.inf)
    for _ in range(STEPS):
        def run(batches, steps=tuple(steps)):
            for batch in batches:
                p = np.stack([np.asarray(batch.column(n)) for n in names], 1)
                n = np.asarray(batch.column("n_tokens")).astype(float)
                rate, ahead = replay(p, steps)
                sums = np.r_[(n * rate) @ p, (n * ahead) @ p]
                yield pa.RecordBatch.from_pydict({f"s{i}": [v] for i, v in enumerate(sums)})

        sums = soft.select("n_tokens", *names).mapInArrow(run, ", ".join(f"s{i} double" for i in range(2 * k)))
        sums = np.array(sums.agg(*[F.sum(f"s{i}") for i in range(2 * k)]).first(), float)
        if np.abs(sums[:k] - wanted).max() <= CLOSE * total or np.abs(sums[:k] - before).max() <= STILL * total:
            break
        before = sums[:k]
        steps.append(step * (wanted - sums[k:]))
    return steps


def mixed(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...], targets: dict[str, float] | None = None) -> DataFrame:
    """``keep`` columns, n_tokens, probabilities, ``rate`` and ``copies`` of every row.

    ``copies`` is the rate rounded up or down by a hash of doc_id and text length, so that it has the rate as its mean."""
    soft = written(posteriors(docs, fit(docs, labels), keep))
    steps = fit_rates(soft, targets or TARGETS)
    names = [f"p_{d}" for d in DOMAINS]

    def run(batches):
        for batch in batches:
            p = np.stack([np.asarray(batch.column(n)) for n in names], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replay(p, steps)[0])], names=[*batch.schema.names, "rate"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in soft.schema)
    rated = soft.mapInArrow(run, f"{schema}, rate double")
    draw = F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return rated.withColumn("copies", (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long"))


@query("op4_mix")
def mix(spark, folder: str) -> DataFrame:
    return mixed(table(spark, folder, "documents"), table(spark, folder, "labels"), ("doc_id",))
