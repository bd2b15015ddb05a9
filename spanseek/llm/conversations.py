"""Repair of conversations: the cheapest edits that make their roles follow ``(s?(ua)+)?``, found by aligning turns to that string.

A row is blank (no sign but white space), a duplicate (role and text stood earlier in the conversation) or truncated (the last sign ends no
sentence); the first that holds counts. Edits: Keep, Rerole to user or assistant (2), Delete (3; needed for blank rows and duplicates), Insert an empty
turn (2); a truncated row that stays adds 1. Of equally cheap edits the least sequence of initials is taken.

*Alignment.* The last r signs of the alternating string are the same for every length, so one edit table over (row, signs still to come) holds the
alignments to all lengths. A path that leaves the diagonal by w signs costs at least 2 w more than the edits nobody can avoid, so only a band is
computed; it is doubled until the incumbent, the cheapest alignment found inside, cannot be matched outside. The feasible lengths that reach its
cost, with a leading system turn or without, are traced back and their sequences compared.

*Long conversations.* Beyond ``LONG`` rows or ``LONG_BYTES`` of text a conversation is not gathered in one task. Its rows are sorted over all tasks
and cut into segments of ``SEGMENT`` rows. There the string's position only matters as one of four states, so a segment is a four by four table of
costs; tables are combined, and every segment then traces its own edits. Only its resulting line, which is one value, is put together at the end.

Rows are ordered by turn (nulls first), then role and text. A null role or text is read as one blank, a null conv_id is a conversation of its own.
Equal rows are all kept, as duplicates. A conversation whose rows are all absent has zeros, no edits and the empty text. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanseek.llm.common import query, table
from spanseek.session import broadcast_if_small, written

LONG, LONG_BYTES = 2_000, 32 << 20
SEGMENT, SEGMENT_BYTES = 4_096, 8 << 20
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
FAR = 1 << 40
BLANK_SIGN = r"\x20\x09-\x0D"
KEY, RESULT = "_conversation", ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired")
_RESULT = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string"


def align(initials: str, must: list[bool], cut: list[bool]) -> tuple[int, str]:
    """(cost, edits) of a conversation given each row's role initial, whether it has to be deleted, and whether it is truncated."""
    n = len(initials)
    left = np.zeros(n + 1, np.int64)
    left[:n] = np.cumsum(~np.array(must, bool)[::-1])[::-1] if n else 0  # rows that may stay, from here on
    least = DELETE * sum(must) + TRUNCATED * sum(c and not m for c, m in zip(cut, must))
    width = 1
    while True:
        rows = _table(initials, must, cut, left, width)
        cost, starts = _starts(rows, initials, must, cut, left, width)
        if INSERT * (width + 1) > cost - least:
            return cost, min(_trace(rows, initials, must, cut, left, width, *start) for start in starts)
        width *= 2


def _table(initials, must, cut, left, width) -> list[np.ndarray]:
    """``rows[i][k]``: least cost of rows i.. against the last r = left[i] + k - width signs."""
    n, offsets = len(initials), np.arange(2 * width + 1)
    tolls = INSERT * offsets
    signs = offsets - width
    rows = [np.where(signs >= 0, INSERT * signs, FAR)]
    for i in range(n - 1, -1, -1):
        below = rows[-1]
        if must[i]:
            row = below + DELETE
        else:
            to_come = signs + left[i]
            fits = {"u": 0, "a": 1}.get(initials[i], 2)  # an even number of signs to come means that the next one is u
            step = np.where(to_come % 2 == fits, 0, REROLE) + (TRUNCATED if cut[i] else 0)
            row = np.where(to_come > 0, below + step, FAR)
            row[:-1] = np.minimum(row[:-1], below[1:] + DELETE)
            row[to_come < 0] = FAR
        row = np.minimum.accumulate(row - tolls) + tolls
        row[signs + left[i] < 0] = FAR
        rows.append(np.minimum(row, FAR))
    return rows[::-1]


def _starts(rows, initials, must, cut, left, width) -> tuple[int, list[tuple[int, int]]]:
    """Least cost, and the (rows before a leading system turn or -1, signs after it) that reach it."""
    n, found = len(initials), []
    signs = np.arange(2 * width + 1) - width + left[0]
    even = (signs % 2 == 0) & (signs >= 0)
    cost = int(rows[0][even].min(initial=FAR))
    found += [(int(rows[0][k]), -1, int(signs[k])) for k in np.flatnonzero(even & (rows[0] == cost))]
    for i in range(n):
        if DELETE * i > cost:
            break
        if initials[i] != "s" or must[i]:
            continue
        before = DELETE * i + (TRUNCATED if cut[i] else 0)
        signs = np.arange(2 * width + 1) - width + left[i + 1]
        good = (signs % 2 == 0) & (signs >= 2)
        best = int(rows[i + 1][good].min(initial=FAR)) + before
        if best <= cost:
            cost = best
            found += [(best, i, int(signs[k])) for k in np.flatnonzero(good & (rows[i + 1] + before == best))]
    return cost, [(i, r) for c, i, r in found if c == cost]


def _trace(rows, initials, must, cut, left, width, lead, to_come) -> str:
    n = len(initials)
    edits = ["D" * lead + "K"] if lead >= 0 else []

    def cost(i, r):
        k = r - left[i] + width
        return rows[i][k] if r >= 0 and 0 <= k <= 2 * width else FAR

    i, r = lead + 1, to_come
    while i < n or r:
        now = cost(i, r)
        if i < n and cost(i + 1, r) + DELETE == now:
            edits.append("D")
            i += 1
        elif r and cost(i, r - 1) + INSERT == now:
            edits.append("I")
            r -= 1
        else:
            edits.append("K" if initials[i] == "ua"[r % 2] and cost(i + 1, r - 1) + TRUNCATED * cut[i] == now else "R")
            i, r = i + 1, r - 1
    return "".join(edits)


def apply_edits(edits: str, rows: list[tuple[str, str]], state: str = "") -> tuple[list[str], str]:
    """Lines ``role:text`` after the edits, and the initial of the last role. ``state``: the initial of the role before."""
    lines, at = [], 0
    for edit in edits:
        role, text = ("", "") if edit == "I" else rows[at]
        at += edit != "I"
        if edit == "D":
            continue
        state = "s" if edit == "K" and not state and role[:1] == "s" else "a" if state == "u" else "u"
        lines.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[state]}:{text}")
    return lines, state


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _gaps(turns: list[int]) -> int:
    return max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations one after the other; rows come sorted."""
    first = next(batches, None)
    if first is None:
        return
    schema = pa.schema([first.schema.field("conv_id"), *(pa.field(c, pa.int64()) for c in RESULT[1:7]), *(pa.field(c, pa.string()) for c in RESULT[7:])])
    rows = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns)) for b in chain([first], batches))
    found, size = [], 0
    for _, group in groupby(rows, lambda r: r[0]):
        conv, turns, said, faults = None, [], [], []
        seen = set()
        for _, conv, turn, role, text, present, blank, ended in group:
            if not present:
                continue
            turns.append(turn)
            duplicate = (role, text) in seen
            seen.add((role, text))
            said.append((role, text))
            faults.append("blank" if blank else "duplicate" if duplicate else "" if ended else "truncated")
        initials = [role[:1] or " " for role, _ in said]
        cost, audit = align("".join(initials), [f in ("blank", "duplicate") for f in faults], [f == "truncated" for f in faults])
        values = [conv, _gaps([t for t in turns if t is not None]), faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
                  _illegal(initials), cost, audit, "\n".join(apply_edits(audit, said)[0])]
        found.append(values)
        size += len(values[-1])
        if len(found) >= 1_000 or size > LONG_BYTES:
            yield _results(found, schema)
            found, size = [], 0
    if found:
        yield _results(found, schema)


def _results(found: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(zip(*found), schema)], schema=schema)


# ---- conversations that no single task should hold ----------------------------------------------------

STATES = ("", "s", "u", "a")     # initial of the last role that is out; "" and "a" may end a conversation
AFTER = (2, 2, 3, 2)             # state after the next user or assistant turn
ENDS = np.array([0, FAR, FAR, 0], np.int64)


def _insert(values: np.ndarray) -> np.ndarray:
    for _ in range(2):
        values = np.minimum(values, values[list(AFTER)] + INSERT)
    return values


def _back(values: np.ndarray, initial: str, must: bool, cut: bool) -> np.ndarray:
    """Costs to go before a row, from those after it: one row of four states, or one column per wanted end."""
    out = values + DELETE
    if not must:
        toll = TRUNCATED if cut else 0
        for state in range(4):
            out[state] = np.minimum(out[state], values[AFTER[state]] + REROLE + toll)
            if initial == STATES[AFTER[state]]:
                out[state] = np.minimum(out[state], values[AFTER[state]] + toll)
        if initial == "s":
            out[0] = np.minimum(out[0], values[1] + toll)
    return np.minimum(_insert(out), FAR)


def _segment_costs(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("place")
    costs = np.where(np.eye(4, dtype=bool), 0, FAR)
    for row in frame[::-1].itertuples():
        costs = _back(costs, row.initial, row.must, row.cut)
    initials = frame["initial"].tolist()
    return pd.DataFrame({KEY: [key[0]], "segment": [key[1]], "costs": [costs.ravel().tolist()], "first": initials[:1], "last": initials[-1:],
                         "illegal": [_illegal(initials)]})


def _to_go(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Backward over the segments of a conversation: what is to come after each, the least cost, and the pairs over borders."""
    frame = frame.sort_values("segment")
    after, out = _insert(ENDS.copy()), []
    for costs in frame["costs"][::-1]:
        out.append(after.tolist())
        after = np.minimum((np.array(costs).reshape(4, 4) + after[None, :]).min(axis=1), FAR)
    borders = sum(a + b not in ("su", "ua", "au") for a, b in zip(frame["last"], frame["first"].iloc[1:]))
    return pd.DataFrame({KEY: key[0], "segment": frame["segment"].tolist(), "after": out[::-1], "final": [*[False] * (len(out) - 1), True],
                         "cost": int(after[0]), "illegal": int(frame["illegal"].sum() + borders)})


def _segment_edits(key: tuple, rows: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    """The edits of a segment for each state that it may begin in, and the state they end in."""
    rows = rows.sort_values("place")
    facts = list(zip(rows["initial"], rows["must"], rows["cut"]))
    costs = [np.array(ends["after"].iloc[0])]
    for fact in facts[::-1]:
        costs.append(_back(costs[-1], *fact))
    costs = costs[::-1]
    audits, finals = [], []
    for state in range(4):
        edits, i = [], 0
        while costs[0][state] < FAR and (i < len(facts) or (ends["final"].iloc[0] and costs[i][state] > 0)):
            now, after = costs[i][state], AFTER[state]
            if i < len(facts) and costs[i + 1][state] + DELETE == now:
                edits.append("D")
                i += 1
            elif costs[i][after] + INSERT == now:
                edits.append("I")
                state = after
            else:
                initial, _, cut = facts[i]
                i += 1
                target = 1 if initial == "s" and state == 0 and costs[i][1] + TRUNCATED * cut == now else after
                edits.append("K" if initial == STATES[target] and costs[i][target] + TRUNCATED * cut == now else "R")
                state = target
        audits.append("".join(edits))
        finals.append(state)
    return pd.DataFrame({KEY: [key[0]], "segment": [key[1]], "audits": [audits], "finals": [finals]})


def _chosen(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("segment")
    state, begins, audits = 0, [], []
    for choices, finals in zip(frame["audits"], frame["finals"]):
        begins.append(STATES[state])
        audits.append(choices[state])
        state = int(finals[state])
    return pd.DataFrame({KEY: key[0], "segment": frame["segment"].tolist(), "begin": begins, "audit": audits})


def _segment_text(key: tuple, rows: pd.DataFrame, edits: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("place")
    lines, _ = apply_edits(edits["audit"].iloc[0], list(zip(rows["role"], rows["text"])), edits["begin"].iloc[0])
    return pd.DataFrame({KEY: [key[0]], "segment": [key[1]], "audit": [edits["audit"].iloc[0]], "piece": ["\n".join(lines) if lines else None]})


def _segments(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one partition, with their segment; an equal row directly before makes a duplicate."""
    before, segment, place, size = None, -1, 0, 0
    for batch in batches:
        numbers, places, repeats = [], [], []
        for key, turn, role, text, part in zip(*(batch.column(c).to_pylist() for c in (KEY, "turn", "role", "text", "part"))):
            if before is None or before[0] != key or place + 1 >= rows or size >= SEGMENT_BYTES:
                segment, place, size = segment + 1, -1, 0
            repeats.append(before == (key, turn, role, text))
            before, place, size = (key, turn, role, text), place + 1, size + 4 * len(text)
            numbers.append(part << 32 | segment)
            places.append(place)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64()), pa.array(places, pa.int64()), pa.array(repeats, pa.bool_())],
                                         names=[*batch.schema.names, "segment", "place", "repeated"])


def _long(rows: DataFrame, segment: int) -> DataFrame:
    present = rows.where("present").drop("present")
    said = F.md5(F.encode(F.concat_ws("\0", "role", "text"), "UTF-8"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    marked = written(present.withColumn("said", said))
    first = marked.groupBy(KEY, "said").agg(F.min(order).alias("first"))
    parts = max(marked.sparkSession.sparkContext.defaultParallelism, marked.count() // 50_000 + 1)
    marked = (marked.join(first, [KEY, "said"]).withColumn("later", F.col("first") < order).drop("first", "said")
              .repartitionByRange(parts, KEY, "turn", "role", "text").sortWithinPartitions(KEY, "turn", "role", "text")
              .withColumn("part", F.spark_partition_id().cast("long")))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in marked.schema.fields) + ", segment long, place long, repeated boolean"
    marked = marked.mapInArrow(lambda batches: _segments(batches, segment), schema)
    duplicate = ~F.col("blank") & (F.col("later") | F.col("repeated"))
    marked = written(marked.withColumn("duplicate", duplicate).withColumn("must", F.col("blank") | duplicate)
                     .withColumn("cut", ~F.col("blank") & ~duplicate & ~F.col("ended")).withColumn("initial", F.substring("role", 1, 1)))
    light = marked.select(KEY, "segment", "place", "initial", "must", "cut")
    costs = written(light.groupBy(KEY, "segment").applyInPandas(
        _segment_costs, f"{KEY} string, segment long, costs array<long>, first string, last string, illegal long"))
    ends = written(costs.groupBy(KEY).applyInPandas(
        _to_go, f"{KEY} string, segment long, after array<long>, final boolean, cost long, illegal long"))
    edits = (light.groupBy(KEY, "segment").cogroup(ends.select(KEY, "segment", "after", "final").groupBy(KEY, "segment"))
             .applyInPandas(_segment_edits, f"{KEY} string, segment long, audits array<string>, finals array<int>"))
    edits = written(edits.groupBy(KEY).applyInPandas(_chosen, f"{KEY} string, segment long, begin string, audit string"))
    texts = (marked.select(KEY, "segment", "place", "role", "text").groupBy(KEY, "segment").cogroup(edits.groupBy(KEY, "segment"))
             .applyInPandas(_segment_text, f"{KEY} string, segment long, audit string, piece string"))
    ordered = F.sort_array(F.collect_list(F.struct("segment", "audit", "piece")))
    joined = texts.groupBy(KEY).agg(ordered.alias("all")).select(
        KEY, F.array_join(F.transform("all", lambda x: x["audit"]), "").alias("audit"),
        F.array_join(F.transform("all", lambda x: x["piece"]), "\n").alias("repaired"))
    counts = marked.groupBy(KEY).agg(
        *[F.sum(F.col(c).cast("long")).alias(n) for c, n in (("blank", "blank"), ("duplicate", "duplicate"), ("cut", "truncated"))])
    turns = marked.where("turn IS NOT NULL").select(KEY, "turn").distinct().groupBy(KEY).agg(
        (F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    found = counts.join(joined, KEY).join(ends.select(KEY, "cost", "illegal").distinct(), KEY).join(turns, KEY, "left")
    names = rows.groupBy(KEY).agg(F.first("conv_id").alias("conv_id"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return names.join(found, KEY, "left").select(
        "conv_id", *[v.alias(c) for c, v in zero.items()], *[F.coalesce(c, F.lit("")).alias(c) for c in ("audit", "repaired")])


def repair(rows: DataFrame, present: Column | None = None, long: int = LONG, segment: int = SEGMENT) -> DataFrame:
    """``rows``: conv_id, turn, role, text. One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired.

    A row for which ``present`` does not hold only makes its conversation appear. ``gaps`` counts the turn numbers missing between the first and
    the last one. ``repaired`` holds the lines ``role:text``.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    rows = rows.select(key.alias(KEY), "conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), there.alias("present"))
    rows = rows.withColumn("blank", ~F.col("text").rlike(f"[^{BLANK_SIGN}]")).withColumn(
        "ended", F.col("text").rlike(f"[.!?][{BLANK_SIGN}]*\\z"))
    size = F.sum(F.octet_length("text") + F.octet_length("role"))
    large = written(rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), size.alias("size"))
                    .where((F.col("n") > long) | (F.col("size") > LONG_BYTES)).select(KEY))
    kind = rows.schema["conv_id"].dataType.simpleString()
    any_large = not large.isEmpty()
    large = broadcast_if_small(large)
    short = rows.join(large, KEY, "left_anti") if any_large else rows
    columns = (KEY, "conv_id", "turn", "role", "text", "present", "blank", "ended")
    done = (short.select(*columns).repartition(KEY).sortWithinPartitions(KEY, "turn", "role", "text")
            .mapInArrow(_whole, _RESULT.format(kind)))
    return done.unionByName(_long(rows.join(large, KEY, "left_semi"), segment)) if any_large else done


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows as the contract of the query damages them; ``present`` is false for dropped ones."""
    part = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fault = F.crc32(F.encode(F.concat(part["conv_id"], F.lit(":"), part["turn"]), "UTF-8")) % 20
    drawn = conversations.select("conv_id", "turn", part["role"].alias("role"), part["text"].alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return drawn.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
                        F.when(F.col("fault") == 0, "").otherwise(text).alias("text"), (F.col("fault") != 0).alias("present"),
                        F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


@query("op13_conversation_repair")
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair(damaged(table(spark, sf_dir, "conversations")), F.col("present"))
    return found.withColumn("repaired_sha256", F.sha2(F.encode("repaired", "UTF-8"), 256)).drop("repaired")
