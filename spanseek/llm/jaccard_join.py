"""N-gram Jaccard self-join by chosen paths.

A text is the set of its runs of five words (lower case, letters and digits; a shorter text is one run). Equal sets are one representative. Every
representative walks down a tree: at a node it is sent on to the children named by the values of its minhash at a few positions that the node's
path samples, so sets that share much meet again with the probability of their similarity at each position. Nodes with at most ``LEAF`` sets are
compared outright. A larger node whose sets are much alike on average would not split further and is compared in blocks; any other is split again.
``RUNS`` independent trees bring the recall of a pair at the threshold to ``RECALL`` (``runs_for``), with the sketch test below counted in.

Pairs whose minhash sketches agree enough become the links of candidate groups; only a spanning forest leaves a task. Inside a candidate group all pairs
are compared exactly, in blocks, on the full sets, which gives every document's number of links and the links that make the classes.

Null and empty texts, and texts without words, are equal to each other (one class). Rows are never merged: every row comes back, repeated rows
and repeated doc_ids with the same class. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanseek.llm.common import blocks, flat, fresh, lowered, mixed, query, table, whole, word_hashes, words
from spanseek.llm.graph import components
from spanseek.session import written

WORDS = 5
THRESHOLD = 0.8
MINHASHES = 64
AGREE = 34         # of MINHASHES: a pair at the threshold has fewer with probability 3.2e-7 (``gate_miss``)
FAN = 3            # children that a set is sent to at a node
RECALL = 0.99999
LEAF = 2048
ALIKE = 0.5        # average similarity from which a node is compared instead of split
DEPTH = 8
BLOCK_SETS = 512
BLOCK_RUNS = 400_000
FILTER_BITS = 19   # 4 MB
_SEEDS = np.random.default_rng(17).integers(1, 1 << 32, (MINHASHES, 2), dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def runs_for(recall: float, similarity: float, fan: int = FAN, depth: int = 2) -> int:
    """Trees until a pair of this similarity is met with probability ``recall``, if its nodes split ``depth`` times."""
    p = 1.0
    for _ in range(depth):
        p = 1 - (1 - similarity * p) ** fan
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def gate_miss(similarity: float) -> float:
    """Probability that a pair of this similarity agrees in fewer than ``AGREE`` minhashes, and so is no link although it meets."""
    return sum(math.comb(MINHASHES, i) * similarity ** i * (1 - similarity) ** (MINHASHES - i) for i in range(AGREE))


RUNS = runs_for(RECALL / (1 - gate_miss(THRESHOLD)), THRESHOLD)


def shingles(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, run of words) pairs, sorted by both."""
    low = lowered(raw)
    start, end, row = words(low, at)
    h = word_hashes(low, start, end)
    held = np.bincount(row, minlength=len(at) - 1)
    total = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
    for i in range(WORDS if len(total) else 0):
        total = total * np.uint64(0xBF58476D1CE4E5B9) + h[i:i + len(total)]
    inside = row[:len(total)] == row[WORDS - 1:] if len(total) else np.zeros(0, bool)
    value, owner = mixed(total[inside]), row[:len(total)][inside]
    short = np.flatnonzero((held > 0) & (held < WORDS))
    if len(short):
        first = np.searchsorted(row, short)
        whole_text = [mixed(np.array([sum(int(x) * 31 ** k for k, x in enumerate(h[f:f + held[r]])) % (1 << 64)], np.uint64))[0]
                      for r, f in zip(short, first)]
        value, owner = np.r_[value, np.array(whole_text, np.uint64)], np.r_[owner, short]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])] if len(value) else np.zeros(0, bool)
    return owner[new], value[new]


def _keys(owner: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set, and the sizes of the sets."""
    size = np.bincount(owner, minlength=rows)
    out = np.zeros((rows, 2), np.uint64)
    at = np.flatnonzero(size)
    if len(at):
        begin = (np.cumsum(size) - size)[at]
        out[at, 0] = mixed(np.add.reduceat(value, begin) + size[at].astype(np.uint64))
        out[at, 1] = mixed(np.add.reduceat(mixed(value ^ np.uint64(0x5851F42D4C957F2D)), begin))
    return out, size


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a matrix."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)), pa.py_buffer(rows)])


def _minhashes(owner: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    out = np.full((rows, MINHASHES), 0xFFFFFFFF, np.uint32)
    if len(owner):
        begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        half, other = (value >> np.uint64(32)).astype(np.uint32), value.astype(np.uint32)
        for i, (a, b) in enumerate(_SEEDS):
            x = half * a + other * b
            x ^= x >> np.uint32(16)
            x *= np.uint32(0x7FEB352D)
            out[owner[begin], i] = np.minimum.reduceat(x, begin)
    return out


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, key (names the set), size, sketch for every row."""
    def run(batches):
        for block in blocks(batches, "text"):
            owner, value = shingles(*flat(block.column("text")))
            keys, size = _keys(owner, value, block.num_rows)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), _binary(keys), pa.array(size, pa.int64()), _binary(_minhashes(owner, value, block.num_rows))],
                names=["doc_id", "key", "size", "sketch"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    return rows.mapInArrow(run, "doc_id long, key binary, size long, sketch binary")


def _children(path: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    """Paths of the FAN children of each (node, set): the node's path samples the positions, without repetition."""
    start, step = mixed(path), mixed(path ^ np.uint64(0xA5A5A5A5)) | np.uint64(1)
    out = np.empty((len(path), FAN), np.uint64)
    for j in range(FAN):
        position = ((start + np.uint64(j) * step) % np.uint64(MINHASHES)).astype(np.int64)
        out[:, j] = mixed(path * np.uint64(0x9E3779B97F4A7C15) + mixed((position.astype(np.uint64) << np.uint64(32))
                                                                       | sketches[np.arange(len(path)), position].astype(np.uint64)))
    return out


def _matrix(column: pa.Array, kind) -> np.ndarray:
    raw, at = flat_binary(column)
    return np.frombuffer(raw, kind).reshape(len(at) - 1, -1)


def flat_binary(column: pa.Array) -> tuple[bytes, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return (data.to_pybytes()[at[0]:at[-1]] if data is not None else b""), at - at[0]


def _split(nodes: DataFrame) -> DataFrame:
    """key, parent, path of the children. ``nodes``: key, path, sketch."""
    def run(batches):
        for batch in batches:
            path = np.asarray(batch.column("path")).view(np.uint64)
            child = _children(path, _matrix(batch.column("sketch"), np.uint32))
            rows = pa.array(np.repeat(np.arange(batch.num_rows), FAN))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(rows), batch.column("path").take(rows), pa.array(child.ravel().view(np.int64))],
                                             names=["key", "parent", "path"])
    return nodes.mapInArrow(run, "key binary, parent long, path long")


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of a symmetric matrix of links."""
    seen, a, b = np.zeros(len(linked), bool), [], []
    for root in np.flatnonzero(linked.any(1)):
        if seen[root]:
            continue
        seen[root], todo = True, [root]
        while todo:
            node = todo.pop()
            new = np.flatnonzero(linked[node] & ~seen)
            seen[new] = True
            todo.extend(new)
            a.extend([node] * len(new))
            b.extend(new)
    return np.array(a, np.int64), np.array(b, np.int64)


def _parts(rows: DataFrame, blocks_column: str) -> DataFrame:
    """Rows dealt to the pairs of blocks of their group: ``bi`` <= ``bj``, ``left`` tells the side. A group of one block has one pair."""
    n = F.col(blocks_column)
    mine = F.pmod(F.xxhash64("key"), n).cast("int")
    return (rows.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)))
            .withColumn("bi", F.least("_mine", "_other")).withColumn("bj", F.greatest("_mine", "_other")).drop("_other"))


def candidates(reps: DataFrame) -> DataFrame:
    """a, b: links between representatives whose sketches agree, enough of them to connect all such pairs that meet."""
    live = reps.where("size > 0").select("key", "sketch")
    nodes = live.select("key", "sketch", F.explode(F.array(*[F.lit(r).cast("long") for r in range(RUNS)])).alias("path"))
    leaves = None
    for depth in range(DEPTH):
        children = written(_split(nodes))
        sizes = children.groupBy("path").agg(F.count("*").alias("n"), F.any_value("parent").alias("parent"))
        many = written(sizes.where("n > 1"))
        if depth:
            # average similarity of a node's sets: the chance that two of them fall into the same child at a position
            alike = (many.groupBy("parent").agg(F.sum(F.col("n") * F.col("n")).alias("pairs")).join(held, "parent")
                     .where(F.col("pairs") >= F.lit(ALIKE * FAN) * F.col("n") * F.col("n")).select("parent"))
            alike = written(alike)
            whole_nodes = big.join(alike, F.col("path") == F.col("parent"), "left_semi")
            leaves = leaves.unionByName(whole_nodes.withColumn("blocks", F.ceil(F.col("n") / BLOCK_SETS).cast("int")))
            many = many.join(alike, "parent", "left_anti")
        met = written(children.drop("parent").join(many.select("path", "n"), "path"))
        small = met.where(F.col("n") <= LEAF).withColumn("blocks", F.ceil(F.col("n") / BLOCK_SETS).cast("int"))
        leaves = small if leaves is None else leaves.unionByName(small)
        big = met.where(F.col("n") > LEAF).select("path", "key", "n")
        if big.isEmpty():
            break
        if depth == DEPTH - 1:
            leaves = leaves.unionByName(big.withColumn("blocks", F.ceil(F.col("n") / BLOCK_SETS).cast("int")))
            break
        held = big.groupBy("path").agg(F.any_value("n").alias("n")).withColumnRenamed("path", "parent")
        nodes = big.select("key", "path").join(live, "key")

    def compare(batches):
        """Batches of a partition sorted by group; a group that a batch cuts is finished with the next one."""
        rest = None
        for batch in batches:
            here = pa.Table.from_batches([batch])
            here = here if rest is None else pa.concat_tables([rest, here])
            group = _groups(here)
            last = group[-1] if len(group) else 0
            rest = here.slice(int(last))
            if last:
                yield _links(here.slice(0, int(last)), group[:-1])
        if rest is not None and rest.num_rows:
            yield _links(rest, np.zeros(1, np.int64))

    dealt = _parts(leaves.join(live, "key"), "blocks").select("path", "bi", "bj", "key", "sketch")
    return (dealt.repartition("path", "bi", "bj").sortWithinPartitions("path", "bi", "bj").mapInArrow(compare, "a binary, b binary"))


def _groups(rows: pa.Table) -> np.ndarray:
    """Where each group of a sorted table begins."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for name in ("path", "bi", "bj"):
        x = np.asarray(rows[name].combine_chunks())
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _links(rows: pa.Table, begin: np.ndarray) -> pa.RecordBatch:
    """Links of all groups: every agreeing pair of groups with up to 8 sets, a spanning forest of larger ones."""
    sketches = _matrix(rows["sketch"], np.uint32)
    size = np.diff(np.r_[begin, rows.num_rows])
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in range(2, 9):
        at = begin[size == n]
        for s in range(0, len(at), 2048):
            for i in range(n):
                for j in range(i + 1, n):
                    x, y = at[s:s + 2048] + i, at[s:s + 2048] + j
                    good = (sketches[x] == sketches[y]).sum(1) >= AGREE
                    a.append(x[good])
                    b.append(y[good])
    for at, n in zip(begin[size > 8], size[size > 8]):
        held = sketches[at:at + n]
        agree = np.zeros((n, n), np.uint8)
        for i in range(MINHASHES):
            agree += held[:, i][:, None] == held[:, i][None, :]
        linked = agree >= AGREE
        np.fill_diagonal(linked, False)
        x, y = _forest(linked)
        a.append(at + x)
        b.append(at + y)
    key = rows["key"].combine_chunks()
    key = key.chunk(0) if isinstance(key, pa.ChunkedArray) else key
    return pa.RecordBatch.from_arrays([key.take(pa.array(np.concatenate(a))), key.take(pa.array(np.concatenate(b)))], names=["a", "b"])


def exact_links(members: DataFrame) -> DataFrame:
    """Rows (a, b, links): links of set ``a`` to other sets of its candidate group counted by their copies (b null), and forest links (links 0).

    ``members``: label, key, size, copies, runs (the set as sorted 64-bit numbers)."""
    shape = members.groupBy("label").agg(F.count("*").alias("n"), F.sum("size").alias("runs_held"))
    shape = shape.select("label", F.greatest(F.ceil(F.col("n") / BLOCK_SETS), F.ceil(F.col("runs_held") / BLOCK_RUNS)).cast("int").alias("blocks"))
    dealt = _parts(members.join(shape, "label"), "blocks")

    def verify(group: pa.Table) -> pa.Table:
        raw, at = flat_binary(group["runs"])
        value = np.frombuffer(raw, np.uint64)
        size = np.diff(at) // 8
        row = np.repeat(np.arange(len(size)), size)
        _, name, held = np.unique(value, return_inverse=True, return_counts=True)
        shared = held[name] > 1
        _, name = np.unique(name[shared], return_inverse=True)
        row = row[shared]
        order = np.argsort(name, kind="stable")
        row, name = row[order], name[order]
        both = np.zeros((len(size), len(size)), np.float32)
        width = max(256, (1 << 24) // max(1, len(size)) // 4)
        for low in range(0, int(name[-1]) + 1 if len(name) else 0, width):
            a, b = np.searchsorted(name, [low, low + width])
            part = np.zeros((len(size), width), np.float32)
            part[row[a:b], name[a:b] - low] = 1
            both += part @ part.T
        union = size[:, None] + size[None, :] - both
        linked = both >= THRESHOLD * union - 1e-6
        np.fill_diagonal(linked, False)
        mine, bi, bj = (np.asarray(group[c].combine_chunks()) for c in ("_mine", "bi", "bj"))
        if bi[0] != bj[0]:  # pairs inside one block belong to that block's own group
            linked &= mine[:, None] != mine[None, :]
        links = linked.astype(np.float64) @ np.asarray(group["copies"].combine_chunks()).astype(np.float64)
        a, b = _forest(linked)
        key = group["key"].combine_chunks()
        some = np.flatnonzero(links > 0)
        none = pa.nulls(len(some), pa.binary())
        return pa.table({"a": pa.concat_arrays([key.take(pa.array(some)), key.take(pa.array(a))]),
                         "b": pa.concat_arrays([none, key.take(pa.array(b))]),
                         "links": pa.array(np.r_[links[some], np.zeros(len(a))].astype(np.int64))})

    return (dealt.select("label", "bi", "bj", "_mine", "key", "copies", "runs").groupBy("label", "bi", "bj")
            .applyInArrow(verify, "a binary, b binary, links long"))


def _slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mixed(keys[:, 0])
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64), np.uint64(1) << (h & np.uint64(63))


def key_filter(keys: DataFrame):
    """A broadcast filter of fixed size (2 ** FILTER_BITS numbers of 64 flags) that knows every key of a table, and by chance some others.

    Rows it does not know need no shuffle to be told from the table; the others go through an exact join. With very many keys it only
    lets more rows through to that join."""
    def run(batches):
        for batch in batches:
            slot, bit = _slots(_matrix(batch.column("key"), np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(bit.view(np.int64))], names=["slot", "bit"])

    rows = keys.select("key").mapInArrow(run, "slot long, bit long").groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    flags = np.zeros(1 << FILTER_BITS, np.uint64)
    flags[np.asarray(rows["slot"])] = np.asarray(rows["bits"]).view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(flags)


def _known(flags: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot, bit = _slots(keys)
    return (flags[slot] & bit) != 0


def _sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """key, runs of the rows that may be members; of equal rows of a task, one."""
    flags = key_filter(members)

    def run(batches):
        met: set[bytes] = set()  # at most the members that this task meets
        for block in blocks(batches, "text"):
            owner, value = shingles(*flat(block.column("text")))
            keys, size = _keys(owner, value, block.num_rows)
            wanted = _known(flags.value, keys)
            for row in np.flatnonzero(wanted):
                name = keys[row].tobytes()
                wanted[row] = name not in met
                met.add(name)
            ends = np.r_[0, np.cumsum(size[wanted])] * 8
            runs = pa.Array.from_buffers(pa.large_binary(), int(wanted.sum()),
                                         [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(value[wanted[owner]].tobytes())])
            yield pa.RecordBatch.from_arrays([_binary(keys[wanted]), runs.cast(pa.binary())], names=["key", "runs"])
    return docs.select(whole().alias("text")).mapInArrow(run, "key binary, runs binary")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sketch table (doc_id, key, ...) of all rows, and key, label, class_id, copies, links for every set that several rows or a link share.

    class_id is the least doc_id of the class; ``keep`` tells the set that holds that document."""
    sketches = written(sketch(docs))
    reps = written(sketches.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"), F.any_value("size").alias("size"),
                                               F.any_value("sketch").alias("sketch")))
    groups = written(components(candidates(reps)))
    members = groups.withColumnRenamed("node", "key").join(reps.select("key", "copies", "size", "first_doc"), "key")
    members = written(members)
    sets = _sets(docs, members).join(members.select("key", "label", "copies", "size"), "key")
    one_each = written(sets.dropDuplicates(["key"]))  # several tasks may have met a set
    found = written(exact_links(one_each))
    links = found.where("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    labels = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "key")
    shared = (reps.where("copies > 1").select("key").unionByName(labels.select("key")).distinct()
              .join(labels, "key", "left").join(links, "key", "left").join(reps.select("key", "copies", "first_doc"), "key")
              .select("key", F.coalesce("label", "key").alias("label"), "copies", "first_doc", F.coalesce("links", F.lit(0)).alias("links")))
    shared = written(shared)
    heads = shared.groupBy("label").agg(F.min(F.struct(F.col("first_doc").isNull().alias("none"), "first_doc", "key")).alias("head"))
    return sketches, written(shared.join(heads, "label").select(
        "key", "label", F.col("head.first_doc").alias("class_id"), "copies", "links", (F.col("head.key") == F.col("key")).alias("keep")))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_copies (rows with the same set, itself included), n_links (other rows with a similarity of the threshold or more)."""
    sketches, shared = classes(docs)
    rows = sketches.select("doc_id", "key").join(shared.drop("label", "keep"), "key", "left")
    return rows.select("doc_id", F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                       F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
                       (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without all but one row of every class; the row with the least doc_id stays."""
    _, shared = classes(docs)
    key, label, head, keep = (fresh(docs, n) for n in ("_key", "_label", "_class_id", "_keep"))
    schema = T.StructType([*docs.schema.fields, T.StructField(key, T.BinaryType())])
    text = docs.columns.index("text")
    flags = key_filter(shared)

    def named(batches):
        """The rows with their key; without one if no other row can be in their class."""
        for block in blocks(batches, "text"):
            owner, value = shingles(*flat(block.column(text)))
            keys, _ = _keys(owner, value, block.num_rows)
            known = pa.array(_known(flags.value, keys))
            yield pa.RecordBatch.from_arrays([*block.columns, pc.if_else(known, _binary(keys), pa.scalar(None, pa.binary()))], names=[*block.schema.names, key])

    rows = docs.mapInArrow(named, schema)
    single = rows.where(F.col(key).isNull()).select(*docs.columns)
    told = shared.select(F.col("key").alias(key), F.col("label").alias(label), F.col("class_id").alias(head), F.col("keep").alias(keep))
    rest = rows.where(F.col(key).isNotNull()).join(told, key, "left")
    rest = rest.where(F.col(label).isNull() | (F.col(keep) & F.col("doc_id").eqNullSafe(F.col(head))))
    first = rest.withColumn(label, F.coalesce(label, key)).dropDuplicates([label]).select(*docs.columns)
    return single.unionByName(first)


@query("op10_jaccard_join")
def jaccard_join(spark, folder: str) -> DataFrame:
    return join(table(spark, folder, "documents"))
