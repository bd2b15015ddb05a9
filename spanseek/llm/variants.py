"""Spelling variants: words one edit apart, and the much more frequent form that each of them stands for.

Near words are found by scanning sorted lists. Rows of the edit matrix between a block of words and the list word are kept by depth; the next list
word reuses the rows of the prefix it shares with the one before and computes the others, three cells wide (one edit leaves the diagonal by one
place). Words whose rows hold no value below two are dropped at that depth, and where none is left, all list words with that prefix are skipped.

Not every word is scanned against the whole list: of two words one edit apart, of which the shorter has L code points, either the first half
(L div 2) is equal, or the last L - L div 2 code points are. So lists are made per length and half, read backwards for the second kind, and a pair
counts in the list of its first half if that is equal, else in the other. A list of more than ``CELLS`` code points is scanned by blocks of its
words, each block in a task of its own that streams the sorted list, so no task holds a list that grows with the data.

Words are distinct, so only their counts depend on how often texts repeat. Null texts and words give nothing; an empty vocabulary gives no rows.
The words of a very long run are compared like others. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanseek.llm.common import query, table
from spanseek.session import broadcast_if_small, written

LEAST_LENGTH = 7
LEAST_COUNT = 2
FACTOR = 10          # a form occurs at least this many times as often
CELLS = 1 << 16      # code points of the words that one scan compares with its list
FEW = 64             # up to as many words are compared number by number, more in arrays
TASK_ROWS = 40_000
RUN = "[A-Za-zÀ-ÿ]"
_NEAR = "word string, n_near long, best_n long, best_word string"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def runs(docs: DataFrame, least: int = LEAST_LENGTH, text: str = "text") -> DataFrame:
    """(doc_id, run): the runs of letters of at least ``least`` code points, A-Z lower-cased. A null doc_id is read as empty."""
    found = F.regexp_extract_all(F.translate(F.col(text).cast("string"), _UPPER, _UPPER.lower()), F.lit(f"{RUN}{{{least},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode_outer(found).alias("run"))
    return rows.where("run IS NOT NULL")


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough. One partial count per word and task is shuffled."""
    return (words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= least_count))


def _lists(words: DataFrame, least: int) -> DataFrame:
    """Every word in the lists where its near words can stand: (kind, size, key, block, role, word, n).

    ``role`` 2: compared with its list and part of it; in a list that is cut, 0: compared by this block, 1: part of the list.
    """
    size, length = F.col("size"), F.length("word")
    sized = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("size")).where(size >= least)
    half = F.expr("size div 2")
    both = sized.select("word", "n", "size", F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("word").alias("turned"), half.alias("shared")),
        F.struct(F.lit(1).alias("kind"), F.reverse("word").alias("turned"), (size - half).alias("shared")))).alias("side"))
    keyed = both.select("side.kind", "size", F.xxhash64(F.substring(F.col("side.turned"), F.lit(1), F.col("side.shared"))).alias("key"),
                        F.col("side.turned").alias("word"), "n")
    cells = F.count(F.lit(1)) * (size + 1)
    cut = (keyed.groupBy("kind", "size", "key").agg(F.ceil(cells / CELLS).cast("int").alias("blocks")).where("blocks > 1"))
    cut = broadcast_if_small(written(cut))
    placed = keyed.join(cut, ["kind", "size", "key"], "left")
    one = F.struct(F.lit(0).alias("block"), F.lit(2).alias("role"))
    own = F.struct(F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("role"))
    copies = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), F.lit(1).alias("role")))
    where = F.when(F.col("blocks").isNull(), F.array(one)).otherwise(F.concat(F.array(own), copies))
    return placed.select("kind", "size", "key", F.explode(where).alias("at"), "word", "n").select("kind", "size", "key", "at.*", "word", "n")


class Scan:
    """A block of words against a sorted list: ``feed`` takes the list word by word and returns the places of the words one edit away."""

    def __init__(self, words: list[tuple[str, int]], size: int):
        self.words, self.size, self.before = words, size, ""

    def shared(self, word: str) -> int:
        """Length of the prefix that ``word`` has in common with the list word before."""
        before, most = self.before, min(len(self.before), len(word))
        self.before = word
        if before[:most] == word[:most]:
            return most
        at = 0
        while before[at] == word[at]:
            at += 1
        return at


class SmallScan(Scan):
    """For a few words: rows of three numbers, one list of rows per word. None stands for a row without a value below two."""

    def __init__(self, words: list[tuple[str, int]], size: int):
        super().__init__(words, size)
        self.compared = [("\0" + word + "\0" * (size + 3 - len(word)), len(word), [(2, 0, 1)]) for word, _ in words]

    def feed(self, word: str) -> list[int]:
        shared, length, found = self.shared(word), len(word), []
        for at, (signs, other_length, rows) in enumerate(self.compared):
            if rows[-1] is None and shared >= len(rows) - 1:
                continue
            del rows[shared + 1:]
            low, mid, high = rows[-1]
            for depth in range(len(rows), length + 1):
                sign = word[depth - 1]
                if signs[depth - 1] != sign:
                    low += 1
                if mid < low:
                    low = mid + 1 if mid + 1 < low else low
                if signs[depth] != sign:
                    mid += 1
                mid = min(mid, high + 1, low + 1)
                if signs[depth + 1] != sign:
                    high += 1
                high = min(high, mid + 1)
                if low > 1 and mid > 1 and high > 1:
                    rows.append(None)
                    break
                rows.append((low, mid, high))
            else:
                beside = other_length - length
                if -2 < beside < 2 and (low, mid, high)[beside + 1] == 1:
                    found.append(at)
        return found


class LargeScan(Scan):
    """For many words: their rows lie beside each other in arrays, and a word leaves them at the depth where it cannot match any more."""

    def __init__(self, words: list[tuple[str, int]], size: int):
        super().__init__(words, size)
        self.length = np.array([len(w) for w, _ in words])
        signs = np.zeros((len(words), size + 4), np.uint32)  # no word has the sign 0, so the border never matches
        for row, (word, _) in enumerate(words):
            signs[row, 1:len(word) + 1] = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        self.signs = np.ascontiguousarray(signs.T)
        every = np.arange(len(words))
        self.rows = [(every, np.full(len(words), 2, np.uint8), np.zeros(len(words), np.uint8), np.ones(len(words), np.uint8))]

    def feed(self, word: str) -> list[int]:
        shared, rows = self.shared(word), self.rows
        if len(rows[-1][0]) == 0 and shared >= len(rows) - 1:
            return []
        del rows[shared + 1:]
        active, low, mid, high = rows[-1]
        for depth in range(len(rows), len(word) + 1):
            if len(active) == 0:
                return []
            sign = ord(word[depth - 1])
            now = self.signs[depth - 1:depth + 2].take(active, axis=1) != sign
            low = np.minimum(low + now[0], mid + 1)
            mid = np.minimum(np.minimum(mid + now[1], high + 1), low + 1)
            high = np.minimum(high + now[2], mid + 1)
            alive = np.minimum(np.minimum(low, mid), high) < 2
            if not alive.all():
                active, low, mid, high = active[alive], low[alive], mid[alive], high[alive]
            rows.append((active, low, mid, high))
        if len(active) == 0:
            return []
        beside = self.length[active] - len(word)
        value = np.where(beside == 0, mid, np.where(beside == -1, low, np.where(beside == 1, high, 2)))
        return active[value == 1].tolist()


def _scan_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: list[tuple[str, int, int, str]] = []
    rows = chain.from_iterable(zip(*(c.to_pylist() for c in batch.columns)) for batch in batches)
    for (kind, size, _, _), group in groupby(rows, lambda r: r[:4]):
        compared, first = [], None
        for row in group:
            if row[4] == 1:
                first = row
                break
            compared.append((row[5], row[6]))
        if not compared or (first is None and len(compared) < 2):
            continue
        listed = compared if first is None else chain([first[5:7]], (row[5:7] for row in group))
        turn = (lambda w: w[::-1]) if kind else (lambda w: w)
        half, scan = size // 2, (SmallScan if len(compared) <= FEW else LargeScan)(compared, size)
        near: dict[int, list] = {}
        for word, n in listed:
            for at in scan.feed(word):
                other = compared[at][0]
                if len(word) > size and len(other) > size:
                    continue  # a pair of the next length
                straight = turn(word)
                if (straight[:half] == turn(other)[:half]) == bool(kind):
                    continue  # a pair of the other kind of list
                best = near.setdefault(at, [0, (0, "")])
                best[0] += 1
                best[1] = min(best[1], (-n, straight)) if best[0] > 1 else (-n, straight)
        found += [(turn(compared[at][0]), count, -least, best_word) for at, (count, (least, best_word)) in near.items()]
        if len(found) >= 10_000:
            yield _batch(found)
            found = []
    if found:
        yield _batch(found)


def _batch(found: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
    word, n_near, best_n, best_word = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(n_near, pa.int64()), pa.array(best_n, pa.int64()),
                                       pa.array(best_word, pa.string())], names=["word", "n_near", "best_n", "best_word"])


def near_words(words: DataFrame, least: int = 1) -> DataFrame:
    """``words``: word, n, distinct; words of less than ``least`` code points take no part. (word, n_near, best_n, best_word) of the words that have
    near ones: how many, and the most frequent of them (ties: the least)."""
    lists = written(_lists(words.where(F.length("word") >= least), least))
    tasks = max(lists.sparkSession.sparkContext.defaultParallelism * 2, lists.count() // TASK_ROWS + 1)
    group = ["kind", "size", "key", "block"]
    ordered = lists.repartition(tasks, *group).sortWithinPartitions(*group, "role", "word").select(*group, "role", "word", "n")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best_word").alias("word")))
    return (ordered.mapInArrow(_scan_lists, _NEAR).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
            .select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best_word")))


def roots(forms: DataFrame) -> DataFrame:
    """``forms``: word, form (never null, no circles). (word, root): where following the forms ends. Every round doubles the steps taken."""
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = written(now.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), "_next"))
        now = joined.select("word", "root")
        if joined.where("_next IS NOT NULL").isEmpty():
            return now


def group_variants(words: DataFrame, factor: int = FACTOR, least: int = 1) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``words`` (word, n)."""
    words = written(words.where("word <> ''").select("word", F.col("n").cast("long").alias("n")))
    joined = words.join(near_words(words, least), "word", "left")
    frequent = F.col("best_n") >= F.col("n") * factor
    judged = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                   F.when(frequent, F.col("best_word")).alias("form"), F.when(frequent, F.col("best_n")).alias("form_n")))
    ends = roots(judged.where("form IS NOT NULL").select("word", "form"))
    return (judged.join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def damaged(found: DataFrame, one_in: int = 31) -> DataFrame:
    """(word): runs as the contract of the query wants them, one in ``one_in`` without one of its code points."""
    drawn = found.select("run", F.crc32(F.encode(F.concat(F.col("doc_id"), F.lit(":"), F.col("run")), "UTF-8")).alias("h"))
    place = F.pmod(F.col("h"), F.length("run").cast("long")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), place), F.substring(F.col("run"), place + 2, F.length("run")))
    return drawn.select(F.when(F.col("h") % one_in == 0, shorter).otherwise(F.col("run")).alias("word"))


@query("op12_spelling_variants")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(vocabulary(damaged(runs(table(spark, sf_dir, "documents")))), least=LEAST_LENGTH)
