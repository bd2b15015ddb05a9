"""Approximate nearest neighbours by cosine: inverted lists, and inside a probed list an adaptive scan over the dimensions.

Vectors are scaled to length 1 and rotated by a random orthogonal matrix, after which the first columns are an unbiased sample of a distance.
A list is scanned in blocks of columns: after each block a candidate is abandoned when its distance so far, scaled to all columns, is larger than
the query's present k-th distance by more than the test ``(1 + EPSILON / sqrt(columns)) ** 2`` allows. Those that reach the last block are scored
in double precision on the original vectors.

The lists are fitted on at most ``SAMPLE`` vectors, every vector is indexed. How many lists a query probes is chosen at fitting time: the least
number that reaches ``TARGET`` recall inside the sample, where neighbours lie further apart than among all rows. A list with many vectors or many
queries is cut into parts of at most about ``PART`` rows each way, so a hot list (copies of one vector) is many groups; a group gives at most k rows
for each of its queries.

Vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part. Candidates of a query are all rows
with another vec_id; several rows of one id are separate candidates, and one query (the least vector). Ties go to the smaller vec_id. Empty
tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanseek.llm.common import query, table
from spanseek.session import written

SAMPLE = 32_768
ROWS_A_LIST = 256
MAX_LISTS = 4_096
TARGET = 0.96
PART = 2_048
COLUMNS = 16
EPSILON = 2.1
BATCH = 512


@dataclass(frozen=True)
class Index:
    rotation: np.ndarray   # dim x dim
    centers: np.ndarray    # lists x dim, rotated
    probes: int
    sizes: np.ndarray      # vectors in each list
    vector_parts: np.ndarray
    query_parts: np.ndarray


def _usable(column: pa.Array, dim: int) -> np.ndarray:
    """Positions of the vectors that take part."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(lists.value_lengths().fill_null(-1))
    at = np.flatnonzero(sizes == dim)
    if len(at) == 0:
        return at
    v = _matrix(lists.take(pa.array(at)), dim)
    with np.errstate(invalid="ignore"):
        return at[np.isfinite(v).all(1) & ((v * v).sum(1) > 0)]


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows as doubles, null components as NaN."""
    values = lists.flatten().cast(pa.float64())
    return np.asarray(values.fill_null(float("nan")) if values.null_count else values, dtype=np.float64).reshape(-1, dim)


def _unit(v: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    return ((v / np.sqrt((v * v).sum(1, keepdims=True))) @ rotation).astype(np.float32)


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for a in range(0, len(x), 4096):
        out[a:a + 4096] = np.argmax(x[a:a + 4096] @ centers.T, axis=1)
    return out


def _centers(x: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means; an empty list takes the vector that fits its own list worst."""
    rng = np.random.default_rng(11)
    centers = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, centers)
        total = np.zeros_like(centers)
        np.add.at(total, at, x)
        held = np.bincount(at, minlength=lists)
        empty = np.flatnonzero(held == 0)
        if len(empty):
            fit = (x * centers[at]).sum(1)
            total[empty] = x[np.argsort(fit, kind="stable")[:len(empty)]]
        length = np.sqrt((total * total).sum(1, keepdims=True))
        centers = np.where(length > 0, total / np.maximum(length, 1e-30), centers).astype(np.float32)
    return centers


def _probes(x: np.ndarray, centers: np.ndarray, k: int) -> int:
    """Least number of lists that finds ``TARGET`` of the true neighbours of some sample vectors."""
    asked = x[:: max(1, len(x) // 512)][:512]
    own = _nearest(x, centers)
    close = asked @ x.T
    true = np.argpartition(-close, min(k, len(x) - 1), axis=1)[:, :k + 1]
    order = np.argsort(-(asked @ centers.T), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(centers))[None, :], axis=1)
    needed = np.sort(np.take_along_axis(rank, own[true], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(TARGET * len(needed))))]) + 1


def _lists_of(x: np.ndarray, index: Index, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, list) pairs: the nearest lists, and further ones until they hold ``least`` vectors."""
    order = np.argsort(-(x @ index.centers.T), axis=1, kind="stable")
    before = np.cumsum(index.sizes[order], axis=1) - index.sizes[order]
    take = (np.arange(order.shape[1])[None, :] < index.probes) | (before < least)
    q, r = np.nonzero(take)
    return q, order[q, r]


def scan(q: np.ndarray, q64: np.ndarray, q_id: np.ndarray, c: np.ndarray, c64: np.ndarray, c_id: np.ndarray, k: int):
    """The k best candidates of each query as (query position, vec_id, score); ``q`` and ``c`` are rotated, the others original."""
    dim = q.shape[1]
    cuts = list(range(0, dim, COLUMNS)) + [dim]
    q_norm, c_norm = np.sqrt((q64 * q64).sum(1)), np.sqrt((c64 * c64).sum(1))
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    limit = np.full(len(q), np.inf, np.float32)  # squared distance of the k-th best so far
    for a in range(0, len(c), BATCH):
        part, ids = c[a:a + BATCH], c_id[a:a + BATCH]
        qi = ci = so_far = None
        for lo, hi in zip(cuts, cuts[1:]):
            allowed = limit * np.float32((1 + EPSILON / np.sqrt(hi)) ** 2 * hi / dim) + np.float32(1e-5)
            if hi == dim:
                allowed = limit + np.float32(1e-5)
            if qi is None:  # the first columns of all pairs
                near = ((q[:, :hi] ** 2).sum(1)[:, None] + (part[:, :hi] ** 2).sum(1)[None, :] - 2 * (q[:, :hi] @ part[:, :hi].T))
                qi, ci = np.nonzero(near <= allowed[:, None])
                so_far = near[qi, ci]
            else:
                for s in range(0, len(qi), 1 << 16):
                    gap = q[qi[s:s + (1 << 16)], lo:hi] - part[ci[s:s + (1 << 16)], lo:hi]
                    so_far[s:s + (1 << 16)] += (gap * gap).sum(1)
                keep = so_far <= allowed[qi]
                qi, ci, so_far = qi[keep], ci[keep], so_far[keep]
            if hi == cuts[1]:
                other = q_id[qi] != ids[ci]
                qi, ci, so_far = qi[other], ci[other], so_far[other]
        if len(qi) == 0:
            continue
        score = np.empty(len(qi))
        for s in range(0, len(qi), 1 << 15):
            x, y = qi[s:s + (1 << 15)], ci[s:s + (1 << 15)] + a
            score[s:s + (1 << 15)] = (q64[x] * c64[y]).sum(1) / (q_norm[x] * c_norm[y])
        merged = tuple(np.concatenate(p) for p in zip(best, (qi, ids[ci], score)))
        order = np.lexsort((merged[1], -merged[2], merged[0]))
        mq = merged[0][order]
        rank = np.arange(len(mq)) - np.searchsorted(mq, mq, side="left")
        order = order[rank < k]
        best = tuple(p[order] for p in merged)
        full = rank[rank < k] == k - 1
        limit[best[0][full]] = (2 - 2 * best[2][full]).astype(np.float32)
    return best


def build(vectors: DataFrame, queries: DataFrame, k: int) -> tuple[Index, DataFrame, DataFrame] | None:
    """The index, and the vectors and queries dealt to the parts of the lists they belong to. Both inputs: vec_id, embedding."""
    spark = vectors.sparkSession
    vectors, queries = (d.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
                        .where("vec_id IS NOT NULL AND embedding IS NOT NULL") for d in (vectors, queries))
    lengths = vectors.groupBy(F.size("embedding").alias("n")).count().where("n > 0").orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return None
    dim, total = lengths["n"], lengths["count"]
    sample = (vectors.where(F.size("embedding") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow())
    column = sample["embedding"].combine_chunks()
    usable = _usable(column, dim)
    if len(usable) == 0:
        return None
    rotation = np.linalg.qr(np.random.default_rng(5).standard_normal((dim, dim)))[0]
    x = _unit(_matrix((column.chunk(0) if isinstance(column, pa.ChunkedArray) else column).take(pa.array(usable)), dim), rotation)
    lists = int(max(1, min(MAX_LISTS, total // ROWS_A_LIST, len(x) // 8)))
    centers = _centers(x, lists)
    bare = Index(rotation, centers, _probes(x, centers, k), np.zeros(lists, np.int64), np.ones(lists, np.int64), np.ones(lists, np.int64))
    shared = spark.sparkContext.broadcast(bare)  # MAX_LISTS centers at most

    def placed(batches):
        index = shared.value
        for batch in batches:
            at = _usable(batch.column("embedding"), dim)
            if len(at):
                kept = batch.take(pa.array(at))
                list_of = _nearest(_unit(_matrix(kept.column("embedding"), dim), index.rotation), index.centers)
                yield pa.RecordBatch.from_arrays([kept.column("vec_id"), pa.array(list_of, pa.int32()), kept.column("embedding")],
                                                 names=["vec_id", "list", "embedding"])

    stored = written(vectors.mapInArrow(placed, "vec_id long, list int, embedding array<double>"))
    sizes = np.zeros(lists, np.int64)
    for row in stored.groupBy("list").count().collect():  # one row a list
        sizes[row["list"]] = row["count"]
    sized = Index(rotation, centers, bare.probes, sizes, bare.vector_parts, bare.query_parts)
    shared_sized = spark.sparkContext.broadcast(sized)

    def asked(batches):
        index = shared_sized.value
        for batch in batches:
            at = _usable(batch.column("embedding"), dim)
            for s in range(0, len(at), 1024):
                kept = batch.take(pa.array(at[s:s + 1024]))
                q, lists_of = _lists_of(_unit(_matrix(kept.column("embedding"), dim), index.rotation), index, 4 * (k + 1))
                yield pa.RecordBatch.from_arrays([kept.column("vec_id").take(pa.array(q)), pa.array(lists_of, pa.int32()),
                                                  kept.column("embedding").take(pa.array(q))], names=["vec_id", "list", "embedding"])

    one_each = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    probing = written(one_each.mapInArrow(asked, "vec_id long, list int, embedding array<double>"))
    asking = np.zeros(lists, np.int64)
    for row in probing.groupBy("list").count().collect():
        asking[row["list"]] = row["count"]
    index = Index(rotation, centers, bare.probes, sizes, np.maximum(1, -(-sizes // PART)), np.maximum(1, -(-asking // PART)))
    parts = spark.createDataFrame([(i, int(index.vector_parts[i]), int(index.query_parts[i])) for i in range(lists)], "list int, vps int, qps int")

    def dealt(rows: DataFrame, own: str, others: str, name: str) -> DataFrame:
        rows = rows.join(F.broadcast(parts), "list")  # MAX_LISTS rows at most
        mine = F.pmod(F.xxhash64("vec_id", F.lit(name)), F.col(own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(others) - 1))
        columns = {own: mine, others: every}
        return rows.select("list", columns["vps"].alias("vp"), columns["qps"].alias("qp"), "vec_id", "embedding")

    return index, dealt(stored, "vps", "qps", "v"), dealt(probing, "qps", "vps", "q")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for every query."""
    empty = "query_id long, rank int, vec_id long, score double"
    built = build(vectors, queries, k)
    if built is None:
        return vectors.sparkSession.createDataFrame([], empty)
    index, candidates, asking = built
    dim = len(index.rotation)
    rotation = vectors.sparkSession.sparkContext.broadcast(index.rotation)

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if left.num_rows == 0 or right.num_rows == 0:
            return none
        left, right = left.sort_by("vec_id"), right.sort_by("vec_id")
        c64, q64 = (_matrix(t["embedding"].combine_chunks(), dim) for t in (left, right))
        c_id, q_id = (np.asarray(t["vec_id"].combine_chunks()) for t in (left, right))
        qi, ids, score = scan(_unit(q64, rotation.value), q64, q_id, _unit(c64, rotation.value), c64, c_id, k)
        return pa.table({"query_id": q_id[qi], "vec_id": ids, "score": score})

    keys = ("list", "vp", "qp")
    found = candidates.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(group, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows a probed part
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


@query("op6_ann")
def ann(spark, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)
