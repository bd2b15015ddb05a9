"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and items are lowered, every run of signs that are no letters or digits becomes one blank. A region of a text that is within ``k`` edits of an
item of ``m`` bytes shares at least ``m - q + 1 - k * q`` q-grams with it, on diagonals (place in text less place in item) that lie at most ``k``
apart. So shared q-grams are counted in overlapping diagonal bands of width ``2 * (k + 1)``; a band with enough of them is aligned with the item
inside the band, and reported when the alignment needs at most ``k`` edits. ``k`` is a tenth of the item's length.

Items with fewer than ``Q`` bytes (and null ones) cannot be told from ordinary text and give no result. Null and empty texts match nothing. Repeated
rows give repeated results; equal items under different ids are each reported. Items are broadcast in blocks of at most ``ITEM_BYTES``, and the
texts are read once a block, so no bound on the benchmark is needed. Other columns are ignored or passed through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanseek.llm.common import blocks, flat, lowered, query, table, whole

Q = 8
RATE = 0.1
ITEM_BYTES = 1 << 20
FILTER_BITS = 22
_WORD = np.zeros(256, bool)
for _low, _high in ((48, 58), (97, 123), (128, 256)):
    _WORD[_low:_high] = True
_UNIT = 1 << 16  # weight of one edit; below it stands the place where an alignment began


@dataclass(frozen=True)
class Items:
    ids: np.ndarray
    raw: np.ndarray       # normalized bytes of all items
    at: np.ndarray
    budget: np.ndarray    # edits allowed
    need: np.ndarray      # q-grams that must be shared
    filter: np.ndarray    # one flag for each value of a q-gram's leading bits
    grams: np.ndarray     # sorted
    first: np.ndarray     # where the postings of a q-gram begin
    item: np.ndarray
    place: np.ndarray


def normal(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalized bytes, the offsets of the texts in them, and the byte that each came from."""
    low = lowered(raw)
    word = _WORD[low]
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first blank after a word
    starts = at[:-1][at[:-1] < at[1:]]
    keep[starts] = word[starts]
    source = np.flatnonzero(keep)
    return np.where(word, low, 32)[source], np.searchsorted(source, at), source


def grams(text: np.ndarray) -> np.ndarray:
    """The Q = 8 bytes that begin at each place, read as one number: equal numbers are equal q-grams."""
    if len(text) < Q:
        return np.zeros(0, np.uint64)
    text = np.ascontiguousarray(text)
    return np.ndarray((len(text) - Q + 1,), np.dtype("<u8"), text.data, strides=(1,)).astype(np.uint64)


def _flag(g: np.ndarray) -> np.ndarray:
    return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def prepare(ids: list[int], texts: list[str | None]) -> Items:
    raw, at, _ = normal(*flat(pa.array(texts, pa.string())))
    size = np.diff(at)
    # blanks at the end carry nothing
    budget = np.minimum(np.floor(RATE * size), np.maximum(0, (size - Q) // Q)).astype(np.int64)
    need = size - Q + 1 - budget * Q
    g = grams(raw)
    owner = np.searchsorted(at, np.arange(len(g)), side="right") - 1
    inside = np.arange(len(g)) + Q <= at[owner + 1]
    g, owner, place = g[inside], owner[inside], (np.arange(len(g)) - at[owner])[inside]
    order = np.argsort(g, kind="stable")
    values, first = np.unique(g[order], return_index=True)
    flags = np.zeros(1 << FILTER_BITS, bool)
    flags[_flag(values)] = True
    return Items(np.array(ids, np.int64), raw, at, budget, need, flags, values, np.r_[first, len(g)], owner[order], place[order])


def _candidates(text: np.ndarray, at: np.ndarray, items: Items):
    """(text, item, first diagonal of the band) of every band with enough shared q-grams."""
    g = grams(text)
    hit = np.flatnonzero(items.filter[_flag(g)])
    row = np.searchsorted(at, hit, side="right") - 1
    within = hit + Q <= at[row + 1]
    hit, row = hit[within], row[within]
    slot = np.searchsorted(items.grams, g[hit])
    slot[slot == len(items.grams)] = 0
    same = items.grams[slot] == g[hit] if len(items.grams) else np.zeros(len(hit), bool)
    hit, row, slot = hit[same], row[same], slot[same]
    if len(hit) == 0:
        return (np.zeros(0, np.int64),) * 3
    # an item can only be in a text that holds enough of the q-grams at all
    count = items.first[slot + 1] - items.first[slot]
    posting = np.repeat(items.first[slot] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
    place, row, item = np.repeat(hit, count) - items.place[posting], np.repeat(row, count), items.item[posting]
    pair = row * len(items.ids) + item
    if len(at) * len(items.ids) <= 1 << 22:  # the same counts, by place or by sorting
        enough = np.bincount(pair)[pair] >= items.need[item]
    else:
        _, of, held = np.unique(pair, return_inverse=True, return_counts=True)
        enough = held[of] >= items.need[item]
    place, row, item, sign = place[enough], row[enough], item[enough], items.place[posting[enough]]
    width = items.budget[item] + 1
    band = (place - at[row] + (1 << 20)) // width  # diagonals may be negative at the start of a text
    span = np.int64(1) << 32
    keys = np.concatenate([pair[enough] * span + band, pair[enough] * span + band - 1])
    order = np.lexsort((np.r_[sign, sign], keys))
    keys, sign = keys[order], np.r_[sign, sign][order]
    new = np.r_[True, (np.diff(keys) != 0) | (np.diff(sign) != 0)] if len(keys) else np.zeros(0, bool)
    keys, held = np.unique(keys[new], return_counts=True)  # a q-gram of the item counts once, however often the text repeats it
    pair, band = keys // span, keys % span
    row, item = pair // len(items.ids), pair % len(items.ids)
    good = held >= items.need[item]
    row, item, band = row[good], item[good], band[good]
    return row, item, band * (items.budget[item] + 1) - (1 << 20) + at[row]


def align(text: np.ndarray, low: np.ndarray, high: np.ndarray, patterns: list[np.ndarray], diagonal: np.ndarray, width: np.ndarray):
    """Fewest edits between each pattern and a part of the text in its band, with the part's start and end.

    A row of the table is (candidate, diagonal); candidates stand by falling length, so those that still have signs are the first ones. Text
    outside [low, high) matches nothing.
    """
    size = np.array([len(p) for p in patterns])
    order = np.argsort(-size, kind="stable")
    low, high, diagonal, width, size = low[order], high[order], diagonal[order], width[order], size[order]
    signs = np.zeros((len(size), int(size[0])), np.uint8)
    for row, i in enumerate(order):
        signs[row, :size[row]] = patterns[i]
    never = np.int64(1) << 40
    places = np.arange(int(width.max()))
    value = np.broadcast_to(places, (len(size), len(places))).copy()
    origin = diagonal[:, None] + places[None, :]
    beyond = places[None, :] >= width[:, None]
    value[(origin < low[:, None]) | (origin > high[:, None]) | beyond] = never
    padded = np.r_[text, np.uint8(0)]
    slope = places * _UNIT
    active = np.searchsorted(-size, -np.arange(int(size[0])), side="left")  # patterns longer than p
    for p in range(int(size[0])):
        n = int(active[p])
        where = origin[:n] + p
        outside = (where < low[:n, None]) | (where >= high[:n, None])
        sign = padded[np.where(outside, len(text), where)]
        kept = value[:n] + np.where(sign == signs[:n, p, None], 0, _UNIT)
        kept[outside | beyond[:n]] = never
        kept[:, :-1] = np.minimum(kept[:, :-1], value[:n, 1:] + _UNIT)    # a sign of the item is missing in the text
        value[:n] = np.minimum.accumulate(kept - slope, axis=1) + slope   # signs of the text that the item lacks
        value[:n][beyond[:n]] = never
    best = np.argmin(value, axis=1)
    least = value[np.arange(len(size)), best]
    out = np.stack([least // _UNIT, diagonal + least % _UNIT, np.minimum(diagonal + best + size, high)])
    back = np.empty_like(out)
    back[:, order] = out
    return back


def matches(raw: np.ndarray, at: np.ndarray, items: Items) -> tuple[np.ndarray, ...]:
    """(text, item, start, end, edits) with one entry for each text and item: the best region, in bytes of the raw texts."""
    text, offsets, source = normal(raw, at)
    row, item, diagonal = _candidates(text, offsets, items)
    plain = text.tobytes() if len(row) else b""
    patterns = [items.raw[items.at[i]:items.at[i + 1]] for i in item]
    k = items.budget[item]
    low, high = offsets[row], offsets[row + 1]
    parts, rest = [], []
    for c, pattern in enumerate(patterns):  # an unchanged copy needs no alignment
        start = plain.find(pattern.tobytes(), max(low[c], diagonal[c]), min(high[c], diagonal[c] + 2 * (k[c] + 1) + len(pattern)))
        if start >= 0:
            parts.append(np.array([[row[c]], [item[c]], [start], [start + len(pattern)], [0]]))
        else:
            rest.append(c)
    for s in range(0, len(rest), 128):
        some = np.array(rest[s:s + 128])
        edits, start, end = align(text, low[some], high[some], [patterns[c] for c in some], diagonal[some] - k[some], 2 * (k[some] + 1) + 2 * k[some])
        good = edits <= k[some]
        parts.append(np.stack([row[some], item[some], start, end, edits])[:, good])
    if not parts:
        return tuple([np.zeros(0, np.int64)] * 5)
    all_ = np.concatenate(parts, axis=1)
    all_ = all_[:, np.lexsort((all_[2], all_[4], all_[1], all_[0]))]
    first = np.r_[True, (np.diff(all_[0]) != 0) | (np.diff(all_[1]) != 0)] if all_.shape[1] else np.zeros(0, bool)
    r, i, start, end, edits = all_[:, first]
    last = np.maximum(end - 1, start)
    padded = np.r_[source, len(raw)]
    return r, i, padded[np.minimum(start, len(source))], padded[np.minimum(last, len(source))] + 1, edits


def item_blocks(items: DataFrame) -> list[Items]:
    """The items in blocks that fit a broadcast. ``items``: item_id, text."""
    kept = items.select(F.col("item_id").cast("long").alias("item_id"), whole().alias("text")).where("item_id IS NOT NULL AND text <> ''").distinct()
    total = kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // ITEM_BYTES)
    for b in range(n):
        part = kept.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).orderBy("item_id", "text").collect()  # about ITEM_BYTES
        if part:
            yield prepare([r["item_id"] for r in part], [r["text"] for r in part])


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end (code points, end exclusive), edits: the best region of every item in every text that holds it."""
    schema = "doc_id long, item_id long, start long, end long, edits int"
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    found = kept.sparkSession.createDataFrame([], schema)
    for block_of_items in item_blocks(items):
        shared = kept.sparkSession.sparkContext.broadcast(block_of_items)

        def run(batches, shared=shared):
            held = shared.value
            for block in blocks(batches, "text"):
                raw, at = flat(block.column("text"))
                r, i, start, end, edits = matches(raw, at, held)
                if len(r):
                    points = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
                    yield pa.RecordBatch.from_arrays(
                        [block.column("doc_id").take(pa.array(r)), pa.array(held.ids[i]), pa.array(points[start] - points[at[r]]),
                         pa.array(points[end] - points[at[r]]), pa.array(edits, pa.int32())], names=["doc_id", "item_id", "start", "end", "edits"])

        found = found.unionByName(kept.mapInArrow(run, schema))
    return found


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, with all their columns."""
    for block_of_items in item_blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block_of_items)

        def run(batches, shared=shared):
            for block in blocks(batches, "text"):
                bad = np.unique(matches(*flat(block.column("text")), shared.value)[0])
                good = np.setdiff1d(np.arange(block.num_rows), bad)
                if len(good):
                    yield block.take(pa.array(good))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


@query("op3_decontaminate")
def decontaminate(spark, folder: str) -> DataFrame:
    return find(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
