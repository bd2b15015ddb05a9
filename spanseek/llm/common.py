"""Tables, whole texts as byte arrays, and word hashes shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanseek.session import ship

BLOCK_BYTES = 1 << 20  # texts are worked on in blocks of about this many bytes; a longer text is a block of its own

_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _IS_WORD[_low:_high] = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole(text: str = "text") -> Column:
    """The text of a row, null read as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    while name in docs.columns:
        name += "_"
    return name


def fold_of(key: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(folds))


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, cut so that a block has about ``limit`` bytes of text: bounds memory for long texts."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
        group = (np.cumsum(sizes) - sizes) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts one after the other as UTF-8 bytes, and where each begins (one entry more than there are texts)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def lowered(raw: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the Latin-1 letters, whose second UTF-8 byte tells the case."""
    low = _UPPER[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3) + 1
    if len(lead):
        second = raw[lead]
        low[lead[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]] += 32
    return low


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash; wraps silently."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def words(raw: np.ndarray, at: np.ndarray, is_word: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word (run of letters and digits, never across two texts), and the text each is in."""
    inside = is_word[raw]
    if len(raw) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    first = np.zeros(len(raw) + 1, bool)
    first[at[:-1]] = True
    start = inside & (np.r_[True, ~inside[:-1]] | first[:-1])
    end = inside & (np.r_[~inside[1:], True] | first[1:])
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    first, last = int(starts[0]), int(ends[-1])
    up, down = _powers(last - first)
    # running sums over all bytes; what stands before a word falls out by its power
    sums = np.zeros(last - first + 1, np.uint64)
    np.cumsum((low[first:last].astype(np.uint64) + np.uint64(1)) * up[:last - first], out=sums[1:])
    values = (sums[ends - first] - sums[starts - first]) * down[starts - first]
    return mixed(values + (ends - starts).astype(np.uint64))


FACTOR = 0x9E3779B97F4A7C15  # odd, so it has an inverse
_POWERS = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least the first ``n`` powers of the factor and of its inverse. Those of a block are kept."""
    global _POWERS
    if n <= len(_POWERS[0]):
        return _POWERS
    made = tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, f, np.uint64)]) for f in (FACTOR, pow(FACTOR, -1, 1 << 64)))
    if n <= 2 * BLOCK_BYTES:
        _POWERS = made
    return made


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register
