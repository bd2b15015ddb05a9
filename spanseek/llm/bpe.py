"""Byte-pair encoding and decoding of whole texts by a walk over a trie of their distinct words.

A text is cut at the special tokens of the vocabulary and then into words (``PATTERN``, fixed by the vocabulary's kind). Words that were not seen
before are put into a trie in sorted order, so that its nodes stand in depth-first order. One walk over the nodes then carries two things from
a node to those below it: the state of an automaton that knows every token ending here, and the *last token* of the encoding of the path so far.
The encoding of a path ends with exactly one token t such that the encoding before t ends with a token that keeps apart from t (no merge would
reach over their border). So the last token of a node follows from the one at the depth where t begins, shared prefixes are encoded once, and
a word's ids are read off by stepping back from its node.

The vocabulary is read once on the driver and broadcast (its size does not depend on the data). Nothing is shuffled. A worker keeps the ids of at
most ``KEPT_WORDS`` words between blocks; a word longer than ``LONG_WORD`` characters is never kept. Texts are worked on in blocks of about 1 MB and a
longer text in pieces of that size, cut where a blank follows another sign, which is always a border between words. A run without such a place is
one word: its walk takes memory in proportion to its length.

Null and empty texts have no ids. Rows are neither merged nor dropped, so repeated rows give repeated results. An output column is lengthened by
underscores where ``keep`` has its name.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanseek.llm.common import BLOCK_BYTES, blocks, fresh, query, table, whole

# Fixed values of the vocabulary's kind: its word pattern, and how its file writes a byte as a letter.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHOWN_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # stand for themselves; the others follow from U+0100 on

KEPT_WORDS = 300_000
LONG_WORD = 64
KEPT_PAIRS = 1_000_000


@dataclass(frozen=True)
class Vocabulary:
    """The parts of a byte-level tokenizer file that matter: small, and sent to every worker as they are."""

    token_bytes: dict[int, bytes]
    merges: list[tuple[int, int, int]]  # left, right, result, by rank
    special: dict[str, int]


def load(path: str) -> Vocabulary:
    """ValueError for a file whose settings this reader does not follow."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model = file["model"]
    splits = file["pre_tokenizer"] or {}
    options = (model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if model["type"] != "BPE" or any(options) or file["normalizer"] or file["post_processor"]:
        raise ValueError("only plain byte-pair models without normalizer and post-processor can be read")
    if splits.get("type") != "ByteLevel" or splits["add_prefix_space"] or not splits["use_regex"] or file["decoder"]["type"] != "ByteLevel":
        raise ValueError("only byte-level vocabularies with the usual word pattern can be read")
    hidden = (b for b in range(256) if b not in set(SHOWN_BYTES))
    byte_of = {chr(b): b for b in SHOWN_BYTES} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ids = model["vocab"]
    merges = []
    for pair in model["merges"]:
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merges.append((ids[left], ids[right], ids[left + right]))
    special = {}
    for token in file["added_tokens"]:
        if token["lstrip"] or token["rstrip"] or token["single_word"]:
            raise ValueError(f"special token {token['content']!r} takes blanks or whole words only")
        special[token["content"]] = token["id"]
    spelled = {i: bytes(byte_of[c] for c in word) for word, i in ids.items() if word not in special}
    return Vocabulary(spelled | {i: s.encode() for s, i in special.items()}, merges, special)


class Encoder:
    """One per worker process: automaton of the tokens, and the words already encoded."""

    def __init__(self, vocabulary: Vocabulary):
        self.special = vocabulary.special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        size = max(vocabulary.token_bytes) + 1
        self.length = [0] * size
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank = [-1] * size
        self.pair_rank: dict[int, int] = {}
        self.size = size
        for rank, (left, right, made) in enumerate(vocabulary.merges):
            if max(self.rank[left], self.rank[right]) >= rank:
                raise ValueError("a merge uses a token that is made later")
            self.parts[made], self.rank[made], self.pair_rank[left * size + right] = (left, right), rank, rank
        plain = {i: b for i, b in vocabulary.token_bytes.items() if i not in self.special.values()}
        self._automaton(plain)
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        self.special_ids = {word: self.packed[i] for word, i in self.special.items()}
        self.known: dict[str, bytes] = dict(self.special_ids)  # no word of the pattern is a special token: texts are cut there
        self.judged: dict[int, bool] = {}

    def _automaton(self, tokens: dict[int, bytes]) -> None:
        """States are the prefixes of tokens. ``longest``: the longest token a state ends with; ``shorter``: the next one after a token."""
        edges: dict[int, int] = {}
        token_of = [-1]
        for token, word in tokens.items():
            self.length[token] = len(word)
            state = 0
            for byte in word:
                key = state << 8 | byte
                state = edges.setdefault(key, len(token_of))
                if state == len(token_of):
                    token_of.append(-1)
            token_of[state] = token
        fall = [0] * len(token_of)
        below: list[list[int]] = [[] for _ in token_of]
        for key in edges:
            below[key >> 8].append(key)
        longest = token_of[:]
        self.shorter = [-1] * self.size
        queue = [0]
        for state in queue:
            for key in below[state]:
                child, byte = edges[key], key & 255
                back = fall[state]
                while back and (back << 8 | byte) not in edges:
                    back = fall[back]
                fall[child] = edges.get(back << 8 | byte, 0) if state else 0
                if token_of[child] >= 0:
                    self.shorter[token_of[child]] = longest[fall[child]]
                else:
                    longest[child] = longest[fall[child]]
                queue.append(child)
        self.edges, self.fall, self.longest = edges, fall, longest

    def _apart(self, left: int, right: int) -> bool:
        """Whether no merge reaches over the border of two tokens while both are being made.

        Merges run in order of rank, from left to right. On the border stand the right edge of ``left`` and the left edge of ``right``; an edge
        lasts until its token is merged into a larger one.
        """
        edge, ends = left, len(self.rank) + len(self.pair_rank)
        while True:
            other, other_ends = right, len(self.rank) + len(self.pair_rank)
            while True:
                rank = self.pair_rank.get(edge * self.size + other)
                if rank is not None and rank < ends and rank <= other_ends:
                    return False
                if other not in self.parts:
                    break
                other_ends, other = self.rank[other], self.parts[other][0]
            if edge not in self.parts:
                return True
            ends, edge = self.rank[edge], self.parts[edge][1]

    def encode_words(self, words: Sequence[bytes]) -> Iterator[bytes]:
        """Packed ids of distinct words given in sorted order."""
        byte_of, depth_of, ends = trie(words)
        deepest = max(map(len, words), default=0) + 1
        states, lasts = [0] * deepest, [-1] * deepest
        edges, fall, longest, shorter = self.edges, self.fall, self.longest, self.shorter
        length, judged, packed = self.length, self.judged, self.packed
        for byte, depth, ends_here in zip(byte_of, depth_of, ends):
            state = states[depth - 1]
            while (state << 8 | byte) not in edges:
                state = fall[state]
            state = edges[state << 8 | byte]
            token = longest[state]
            while (before := depth - length[token]) > 0:
                key = lasts[before] * self.size + token
                fits = judged.get(key)
                if fits is None:
                    fits = judged[key] = self._apart(lasts[before], token)
                if fits:
                    break
                token = shorter[token]
            states[depth], lasts[depth] = state, token
            if ends_here:
                if length[token] == depth:
                    yield packed[token]
                    continue
                ids = []
                while depth:
                    ids.append(packed[lasts[depth]])
                    depth -= length[lasts[depth]]
                yield b"".join(ids[::-1])
        if len(judged) > KEPT_PAIRS:
            judged.clear()

    def _words(self, text: str) -> list[str]:
        """The pattern's letters and digits must be those of the library's Unicode version: where a text has letters that this Python does not
        know, the library's own splitter says where they belong."""
        if not text.isascii() and any(c > "՗" and unicodedata.category(c) == "Cn" for c in set(text)):
            from tokenizers import pre_tokenizers

            spans = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)
            return [text[a:b] for a, b in dict.fromkeys(span for _, span in spans)]
        return self.pattern.findall(text)

    def _cut(self, text: str) -> Iterator[str]:
        return (part for part in self.cut.split(text) if part) if self.cut else iter([text])

    def _learn(self, words: set[str]) -> list[str]:
        """Make the ids of these words known; returns those that are too long to be kept."""
        if len(self.known) + len(words) > KEPT_WORDS:
            self.known = dict(self.special_ids)
        spelled = sorted((w.encode("utf-8"), w) for w in words.difference(self.known))
        self.known.update(zip((w for _, w in spelled), self.encode_words([b for b, _ in spelled])))
        return [w for _, w in spelled if len(w) > LONG_WORD]

    def _forget(self, words: list[str]) -> None:
        for word in words:
            del self.known[word]

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """All ids of each text, as little-endian unsigned 32-bit integers. The words of the whole block share one trie; texts larger than a
        block go piece by piece."""
        if sum(map(len, texts)) > 2 * BLOCK_BYTES:
            return [b"".join(self._encode_pieces(text)) for text in texts]
        lists = [list(chain.from_iterable([part] if part in self.special else self._words(part) for part in self._cut(text))) for text in texts]
        once = self._learn(set(chain.from_iterable(lists)))
        ids = [b"".join(map(self.known.__getitem__, words)) for words in lists]
        self._forget(once)
        return ids

    def _encode_pieces(self, text: str) -> Iterator[bytes]:
        for part in self._cut(text):
            for piece in [part] if part in self.special else pieces(part):
                words = [piece] if piece in self.special else self._words(piece)
                once = self._learn(set(words))
                yield b"".join(map(self.known.__getitem__, words))
                self._forget(once)


def trie(words: Sequence[bytes]) -> tuple[bytearray, list[int], bytearray]:
    """Nodes of the trie of distinct sorted words in depth-first order: byte, depth, and whether a word ends there."""
    byte_of, depth_of, ends = bytearray(), [], bytearray()
    before = b""
    for word in words:
        shared, most = 0, min(len(before), len(word))
        if before[:most] == word[:most]:
            shared = most
        else:
            while before[shared] == word[shared]:
                shared += 1
        byte_of += word[shared:]
        depth_of += range(shared + 1, len(word) + 1)
        ends += bytes(len(word) - shared - 1) + b"\1"
        before = word
    return byte_of, depth_of, ends


_BORDER = regex.compile(r"\S(?=\s)")


def pieces(text: str, size: int = BLOCK_BYTES) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut before a blank that follows another sign."""
    at = 0
    while len(text) - at > size:
        border = _BORDER.search(text, at + size)
        if border is None:
            break
        yield text[at:border.end()]
        at = border.end()
    yield text[at:]


_current: list = [None, None]


def _encoder(shared) -> Encoder:
    """The worker's encoder; building its automaton takes about a second, so it is kept while the vocabulary is the same object."""
    if _current[0] is not shared.value:
        _current[:] = [shared.value, Encoder(shared.value)]
    return _current[1]


def _binary_texts(column: pa.Array) -> Iterator[str]:
    for raw in column.cast(pa.binary()):
        yield (raw.as_py() or b"").decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary: Vocabulary, keep: Sequence[str] = (), text: str = "text", *, packed: bool = False) -> DataFrame:
    """``keep`` columns and ``ids``: array<int>, or with ``packed`` binary (little-endian, four bytes an id)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kept = docs.select(*keep)
    name = fresh(kept, "ids")
    column = fresh(kept, "text")
    rows = docs.select(*keep, whole(text).alias(column))
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.BinaryType() if packed else T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for block in blocks(batches, column):
            ids = encoder.encode(list(_binary_texts(block.column(column))))
            if packed:
                made = pa.array(ids, pa.binary())
            else:
                offsets = np.cumsum([0, *(len(i) // 4 for i in ids)]).astype(np.int32)
                made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*block.columns[:-1], made], names=[*block.schema.names[:-1], name])

    return rows.mapInArrow(run, schema)


def decode(coded: DataFrame, vocabulary: Vocabulary, keep: Sequence[str] = (), ids: str = "ids") -> DataFrame:
    """``keep`` columns and ``text``. ``ids``: array<int> or the packed form; null gives the empty text. Unknown ids are left out, and bytes that
    are no UTF-8 become the replacement sign, as the library does."""
    shared = coded.sparkSession.sparkContext.broadcast(vocabulary)
    kept = coded.select(*keep)
    name, column = fresh(kept, "text"), fresh(kept, "ids")
    packed = isinstance(coded.schema[ids].dataType, T.BinaryType)
    rows = coded.select(*keep, F.col(ids).alias(column))
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.StringType())])

    def numbers(value) -> list[int]:
        if value is None:
            return []
        return np.frombuffer(value, "<u4").tolist() if packed else [i for i in value if i is not None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = shared.value.token_bytes
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [b"".join([spelled.get(i, b"") for i in numbers(v.as_py())]).decode("utf-8", "replace") for v in part.column(column)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*part.schema.names[:-1], name])

    return rows.mapInArrow(run, schema)


@query("op11_bpe")
def bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = load(public_tokenizers.path("byte_bpe_50k.json"))
    coded = encode(table(spark, sf_dir, "documents"), vocabulary, ["doc_id"], packed=True)
    back = decode(coded, vocabulary, ["doc_id", "ids"])
    return back.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2(F.col("ids"), 256).alias("ids_sha256"),
                       F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))
