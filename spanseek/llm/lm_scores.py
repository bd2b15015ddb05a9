"""Log-likelihood of whole documents under a gated recurrent language model.

Tokens are the runs of signs other than white space, A-Z lowered, and one end a document. Counts of all tokens of the training documents are a Spark
table. The ``HEAD`` most frequent tokens stand in classes of ``CLASS`` words; all other words share the tail class. A gated recurrent unit reads a
document from its start and predicts the class of the next token, then the word in its class; inside the tail class a word has its share of the tail's
counts (with 0.1 added, and one place for unknown words), so the probabilities of all tokens sum to 1. The network begins on the driver with
truncated backpropagation on at most ``WINDOWS`` windows of ``WINDOW`` training tokens, which only spares the tasks the first steps. Then it learns from every
token of every training document: each task goes on from there through all of its texts, and the weights are averaged by the tokens they have seen. Scoring takes documents window by window side by side and carries
their states along, so a document of any length is scored whole in bounded memory.

The counts of the ``LOOKUP`` most frequent words are broadcast; for the rest, each document's distinct rare words are joined with the count table.

Null and empty texts consist of the end alone. Repeated rows get equal scores. Without training documents every probability is 1 (score 0). Words are told
apart by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import copy
import math
import threading
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanseek.llm.common import blocks, flat, fold_of, query, table, whole, word_hashes, words
from spanseek.session import written

CLASS = 64
CLASSES = 64
HEAD = CLASS * CLASSES
LOOKUP = 1 << 17
PLACE_BITS = 20
HIDDEN = 24
TAIL_INPUTS = 32            # a tail word is read as one of so many signs, by its hash
SAMPLE_DOCS, WINDOWS, WINDOW = 2_000, 1_200, 512
BATCH, UNROLL, EPOCHS = 64, 32, 3
WIDE, RATE = 512, 0.002     # streams side by side and step size of the pass over all texts
LEAST_STEPS = 16            # a short stream is read by fewer side by side, in about so many steps
FULL = WIDE * UNROLL * LEAST_STEPS  # tokens that fill all streams
ROWS, ROUNDS = 512, 32      # rows whose scores are worked out at once, few enough for a core's cache; rows of a word that are added one by one
SLOT = 1 << 14              # weights are added up in runs of so many
SCORE_TOKENS = 3_000_000    # texts of about so many tokens advance together
END = np.uint64(0x454E44)   # not the hash of a word, as far as hashes go

_SIGN = np.ones(256, bool)
_SIGN[[32, 9, 10, 11, 12, 13]] = False
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token of every text, ends included, and where each text's tokens begin."""
    low = _LOW[raw]
    start, end, row = words(low, at, _SIGN)
    held = np.bincount(row, minlength=len(at) - 1)
    begin = np.r_[0, np.cumsum(held + 1)]
    out = np.full(begin[-1], END, np.uint64)
    out[np.arange(len(row)) + row] = word_hashes(low, start, end)
    return out, begin


def count_tokens(training: DataFrame) -> DataFrame:
    """word (64-bit hash), n over all rows of ``training`` (a column text)."""
    def merged(parts):
        word, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        word, of = np.unique(word, return_inverse=True)
        return word, np.bincount(of, n, minlength=len(word)).astype(np.int64)

    def run(batches):
        parts, held = [], 0
        for block in blocks(batches, "text"):
            word, n = np.unique(tokens(*flat(block.column("text")))[0], return_counts=True)
            parts.append((word, n))
            held += len(word)
            if held > 2_000_000:
                word, n = merged(parts)
                parts, held = [(word, n)], len(word)
                if held > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])
                    parts, held = [], 0
        if parts:
            word, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

    return training.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    words: np.ndarray    # sorted hashes of the LOOKUP most frequent tokens
    counts: np.ndarray
    ids: np.ndarray      # place among the head, or HEAD for the tail
    total: int
    distinct: int
    tail_total: int
    tail_distinct: int
    head_counts: np.ndarray

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Head place (HEAD: tail) and count (-1: not among the LOOKUP words) of each hash."""
        if len(self.words) == 0:
            return np.full(len(h), HEAD), np.full(len(h), -1)
        place = (h & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        first, shared = self.places
        slot = first[place]
        known = self.words[slot] == h
        rest = np.flatnonzero(shared[place] & ~known)
        if len(rest):
            slot[rest] = np.minimum(np.searchsorted(self.words, h[rest]), len(self.words) - 1)
            known[rest] = self.words[slot[rest]] == h[rest]
        return np.where(known, self.ids[slot], HEAD), np.where(known, self.counts[slot], -1)

    @cached_property
    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """By the low bits of a hash: one of the words that have them, and whether there are more."""
        place = (self.words & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        first, shared = np.zeros(1 << PLACE_BITS, np.int64), np.zeros(1 << PLACE_BITS, bool)
        first[place] = np.arange(len(place))
        shared[place[first[place] != np.arange(len(place))]] = True
        return first, shared


def vocabulary(counts: DataFrame) -> Vocabulary:
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    top = counts.orderBy(F.desc("n"), "word").limit(LOOKUP).toArrow()  # LOOKUP rows
    word = np.asarray(top["word"]).view(np.uint64) if top.num_rows else np.zeros(0, np.uint64)
    n = np.asarray(top["n"]) if top.num_rows else np.zeros(0, np.int64)
    by_count = np.lexsort((word, -n))
    word, n = word[by_count], n[by_count]
    ids = np.minimum(np.arange(len(word)), HEAD)
    head = n[:HEAD]
    order = np.argsort(word)
    return Vocabulary(word[order], n[order], ids[order], total or 0, distinct or 0, int((total or 0) - head.sum()), int((distinct or 0) - len(head)), head)


class _Room(threading.local):
    """Arrays that a thread uses again and again: fresh memory for every step costs more than the step."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.held or len(self.held[name]) < size:
            self.held[name] = np.empty(size, np.float32)
        return self.held[name][:size].reshape(shape)


_room = _Room()


def _topped(weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Weights with the biases as one more row, less a bound of all scores: no part of a state is beyond 1. States have a 1 more to read them with."""
    top = (bias + np.abs(weight).sum(-2)).max(-1, keepdims=True)
    return np.concatenate([weight, (bias - top)[..., None, :]], axis=-2)


def _powers(h: np.ndarray, weight: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row's scores ``h @ weight``: the powers of e of all, their sum, and the power at the place ``at``, a number in all rows' places.

    Rows whose scores are all far below 0 are taken from their own largest score."""
    z = np.matmul(h, weight, out=_room("powers", len(h), weight.shape[1]))
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], np.float32)
    if total.min() < 1e-20:
        for row in np.flatnonzero(total < 1e-20):
            own = h[row] @ weight
            z[row] = np.exp(own - own.max())
            total[row] = z[row].sum()
    flat = z.reshape(-1)
    return z, total, np.arange(0, len(flat), z.shape[1]) + at


def _slopes(h: np.ndarray, weight: np.ndarray, at: np.ndarray, rows: int, back: np.ndarray) -> np.ndarray:
    """How a softmax's mean loss over ``rows`` changes by the weights; by the states, into ``back``. What is common to a row multiplies the narrow sides."""
    z, total, place = _powers(h, weight, at)
    z.reshape(-1)[place] -= total
    share = (1 / (total * np.float32(rows)))[:, None]
    np.matmul(z, weight[:-1].T, out=back)
    back *= share
    return np.multiply(h, share, out=_room("shared", *h.shape)).T @ z


def _sums_by(ids: np.ndarray, parts: np.ndarray, names: int) -> np.ndarray:
    """Sums of the rows of every part that have the same id. The first rows of all ids are added together, then the second, and so on."""
    order = np.argsort(ids.astype(np.int16), kind="stable")
    count = np.bincount(ids, minlength=names)
    name = np.argsort(-count, kind="stable")[:np.count_nonzero(count)]
    first, n = (np.cumsum(count) - count)[name], count[name]
    sums = np.zeros((len(parts), len(name), parts.shape[2]), np.float32)
    for r in range(ROUNDS):
        m = int(np.searchsorted(-n, -r))
        if m:
            sums[:, :m] += np.take(parts, order[first[:m] + r], axis=1, out=_room("round", len(parts), m, parts.shape[2]), mode="clip")
    for i in range(int(np.searchsorted(-n, -ROUNDS))):
        rest = order[first[i] + ROUNDS:first[i] + n[i]]
        held = np.take(parts, rest, axis=1, out=_room("round", len(parts), len(rest), parts.shape[2]), mode="clip")
        sums[:, i] += np.matmul(np.ones(len(rest), np.float32), held)
    out = np.zeros((len(parts), names, parts.shape[2]), np.float32)
    out[:, name] = sums
    return out


class _Steps:
    """Steps along gradients with momentum, each weight by its own scale."""

    PARAMS = ("read", "carry", "carry_bias", "to_class", "class_bias", "to_word", "word_bias")

    def __init__(self, net: Network):
        self.net, self.done = net, 0
        for p in self.PARAMS:  # changed in place from here on
            setattr(net, p, getattr(net, p).copy())
        self.m = {p: np.zeros_like(getattr(net, p)) for p in self.PARAMS}
        self.v = {p: np.zeros_like(getattr(net, p)) for p in self.PARAMS}

    def take(self, grads: dict[str, np.ndarray], rate: float):
        self.done += 1
        norm = math.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
        scale = np.float32(min(1.0, 1.0 / (norm + 1e-9)))
        first, second = np.float32(1 - 0.9 ** self.done), np.float32(1 - 0.99 ** self.done)
        for p, g in grads.items():
            m, v = self.m[p], self.v[p]
            x = _room("step", *g.shape)
            m *= 0.9
            m += np.multiply(g, np.float32(0.1) * scale, out=x)
            np.multiply(g, scale, out=x)
            x *= x
            x *= 0.01
            v *= 0.99
            v += x
            np.divide(v, second, out=x)
            np.sqrt(x, out=x)
            x += 1e-6
            np.divide(m, x, out=x)
            x *= np.float32(rate) / first
            getattr(self.net, p).__isub__(x)


class Network:
    """The recurrent unit and its two softmaxes, in single precision."""

    def __init__(self, head_counts: np.ndarray, tail_total: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        n = len(head_counts)
        apart = lambda a: np.ascontiguousarray(a.reshape(-1, 3, HIDDEN).transpose(1, 0, 2), np.float32)  # noqa: E731  two gates and the new state
        self.read = apart(0.1 * rng.standard_normal((HEAD + TAIL_INPUTS, 3 * HIDDEN)))
        self.carry = apart(rng.standard_normal((HIDDEN, 3 * HIDDEN)) / np.sqrt(HIDDEN))
        self.carry_bias = np.zeros((3, 1, HIDDEN), np.float32)
        self.to_class = np.zeros((HIDDEN, CLASSES + 1), np.float32)
        self.to_word = np.zeros((CLASSES, HIDDEN, CLASS), np.float32)
        counts = np.zeros(HEAD)
        counts[:n] = head_counts
        mass = counts.reshape(CLASSES, CLASS).sum(1)
        self.class_bias = np.log(np.r_[mass, tail_total + 0.1] + 1e-6).astype(np.float32)
        self.class_bias -= self.class_bias.max()
        self.class_bias[:-1][mass == 0] = -1e9  # places that no word has
        self.word_bias = np.where(counts > 0, np.log(np.maximum(counts, 1e-9)), -1e9).reshape(CLASSES, CLASS).astype(np.float32)

    def _gates(self, ids: np.ndarray, h: np.ndarray, carry: np.ndarray, gates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both gates after the words ``ids`` from the states ``h`` with a 1 more; what the new state takes from the old one, and from the words."""
        u = np.matmul(h, carry, out=_room("carried", 3, len(h), HIDDEN))
        x = np.take(self.read, ids, axis=1, out=_room("words", 3, len(h), HIDDEN), mode="clip")
        np.add(u[:2], x[:2], out=gates)
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        return u[2], x[2]

    def biased(self) -> np.ndarray:
        return np.concatenate([self.carry, self.carry_bias], axis=1)

    def advance(self, ids: np.ndarray, h: np.ndarray, carry: np.ndarray, out: np.ndarray):
        """The next states, into ``out``; ``carry``: of ``biased``."""
        gates = _room("gates", 2, len(h), HIDDEN)
        new, x = self._gates(ids, h, carry, gates)
        new *= gates[1]
        new += x
        np.tanh(new, out=new)
        h, out = h[:, :HIDDEN], out[:, :HIDDEN]
        np.subtract(h, new, out=out)
        out *= gates[0]
        out += new

    def log_probs(self, h: np.ndarray, target: np.ndarray, tops: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Natural logarithm of the probability of each target: a head place, or HEAD for the tail class as a whole. ``h``: states with a 1 more; ``tops``: of
        ``topped``."""
        kind = (target // CLASS).astype(np.int8)
        out = np.empty(len(target))

        def taken(h, weight, at):
            z, total, place = _powers(h, weight, at)
            p = z.reshape(-1)[place] / total
            if p.min() < 1e-30:  # too little for a power of e
                own = (h @ weight).astype(np.float64)
                own -= own.max(1, keepdims=True)
                return own[np.arange(len(h)), at] - np.log(np.exp(own).sum(1))
            return np.log(p)

        for a in range(0, len(target), ROWS):
            x = slice(a, a + ROWS)
            out[x] = taken(h[x], tops[0], kind[x])
        order = np.argsort(kind, kind="stable")
        cut = np.r_[0, np.cumsum(np.bincount(kind, minlength=CLASSES + 1))]
        inside, place = np.take(h, order, axis=0, out=_room("sorted", *h.shape), mode="clip"), target[order] % CLASS
        added = np.zeros(len(target))
        for c in range(CLASSES):
            for a in range(cut[c], cut[c + 1], ROWS):
                x = slice(a, min(a + ROWS, cut[c + 1]))
                added[x] = taken(inside[x], tops[1][c], place[x])
        out[order] += added
        return out

    def topped(self) -> tuple[np.ndarray, np.ndarray]:
        return _topped(self.to_class, self.class_bias), _topped(self.to_word, self.word_bias)

    def train(self, windows: list[tuple[np.ndarray, np.ndarray]]):
        """``windows``: (inputs, targets) as ids; inputs begin with the end, which stands before every text."""
        steps = _Steps(self)
        stream_in = np.concatenate([w[0] for w in windows])
        stream_out = np.concatenate([w[1] for w in windows])
        fresh = np.concatenate([np.r_[True, np.zeros(len(w[0]) - 1, bool)] for w in windows])  # state begins anew
        batch = max(1, min(BATCH, len(stream_in) // UNROLL))
        length = len(stream_in) // batch
        shape = lambda a: a[:batch * length].reshape(batch, length)
        stream_in, stream_out, fresh = shape(stream_in), shape(stream_out), shape(fresh)
        total = EPOCHS * max(1, -(-length // UNROLL))
        for _ in range(EPOCHS):
            h = np.zeros((batch, HIDDEN), np.float32)
            for s in range(0, length, UNROLL):
                grads, h = self._gradients(stream_in[:, s:s + UNROLL], stream_out[:, s:s + UNROLL], fresh[:, s:s + UNROLL], h)
                steps.take(grads, 0.01 * (1 - 0.9 * (steps.done + 1) / total))

    def follow(self, steps: _Steps, read: np.ndarray, target: np.ndarray, fresh: np.ndarray):
        """One pass over a stream of texts, every token of it once; ``fresh`` marks where a text begins."""
        while len(read):
            batch = max(1, min(WIDE, len(read) // (UNROLL * LEAST_STEPS)))
            length = len(read) // batch
            part = [a[:batch * length].reshape(batch, length) for a in (read, target, fresh)]
            h = np.zeros((batch, HIDDEN), np.float32)
            for s in range(0, length, UNROLL):
                grads, h = self._gradients(*(a[:, s:s + UNROLL] for a in part), h)
                steps.take(grads, RATE)
            read, target, fresh = (a[batch * length:] for a in (read, target, fresh))

    def weights(self) -> np.ndarray:
        return np.concatenate([getattr(self, p).ravel() for p in _Steps.PARAMS]).astype(np.float64)

    def with_weights(self, flat: np.ndarray) -> Network:
        out, at = copy.copy(self), 0
        for p in _Steps.PARAMS:
            like = getattr(self, p)
            setattr(out, p, flat[at:at + like.size].reshape(like.shape).astype(np.float32))
            at += like.size
        return out

    def _gradients(self, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, h: np.ndarray):
        k, (n, steps) = HIDDEN, inputs.shape
        rows = n * steps
        ids, begins = np.ascontiguousarray(inputs.T), fresh.any(0)
        wide_before, wide_states = _room("before", steps, n, k + 1), _room("states", steps, n, k + 1)  # states with a 1 more
        before, states = wide_before[..., :k], wide_states[..., :k]
        gates, new, held, carry = _room("all gates", steps, 2, n, k), _room("new", steps, n, k), _room("held", steps, n, k), self.biased()
        for t in range(steps):
            before[t] = h
            if begins[t]:
                before[t][fresh[:, t]] = 0
            wide_before[t, :, k] = 1
            u, x = self._gates(ids[t], wide_before[t], carry, gates[t])
            held[t] = u
            np.multiply(u, gates[t, 1], out=new[t])
            new[t] += x
            np.tanh(new[t], out=new[t])
            h = states[t]
            np.subtract(before[t], new[t], out=h)
            h *= gates[t, 0]
            h += new[t]
        wide_states[..., k] = 1
        g, dh = self._softmax_gradients(wide_states.reshape(rows, k + 1), targets.T.reshape(-1))
        dh = dh.reshape(steps, n, k)
        dx, du = _room("dx", 3, steps, n, k), _room("du", n, k)  # by both gates and the new state; by what the new state takes of the old one
        back, later, one = self.carry.transpose(0, 2, 1), np.zeros((n, k), np.float32), _room("one", n, k)
        carry = np.zeros_like(carry)
        for t in range(steps - 1, -1, -1):
            (z, r), d, (dz, dr, d_new) = gates[t], dh[t], dx[:, t]
            d += later
            np.multiply(new[t], new[t], out=d_new)
            np.subtract(1, d_new, out=d_new)
            d_new *= d
            np.subtract(1, z, out=one)
            d_new *= one
            np.subtract(before[t], new[t], out=dz)
            dz *= one
            d *= z
            dz *= d
            np.subtract(1, r, out=dr)
            dr *= held[t]
            dr *= np.multiply(d_new, r, out=du)
            np.matmul(dz, back[0], out=later)
            later += d
            later += np.matmul(dr, back[1], out=one)
            later += np.matmul(du, back[2], out=one)
            for i, part in enumerate((dz, dr, du)):
                carry[i] += wide_before[t].T @ part
            if begins[t]:
                later[fresh[:, t]] = 0
        g |= {"read": _sums_by(ids.reshape(-1), dx.reshape(3, rows, k), self.read.shape[1]), "carry": carry[:, :k], "carry_bias": carry[:, k:]}
        return g, h.copy()

    def _softmax_gradients(self, h: np.ndarray, target: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean loss: by the weights of both softmaxes, and by the states. ``h``: states with a 1 more."""
        kind = (target // CLASS).astype(np.int8)
        to_class, to_word = self.topped()
        by_class, by_word = np.zeros_like(to_class), np.zeros_like(to_word)
        dh = _room("dh", len(h), HIDDEN)
        for a in range(0, len(h), ROWS):
            x = slice(a, a + ROWS)
            by_class += _slopes(h[x], to_class, kind[x], len(h), dh[x])
        order = np.argsort(kind, kind="stable")
        cut = np.r_[0, np.cumsum(np.bincount(kind, minlength=CLASSES + 1))].tolist()
        order = order[:cut[CLASSES]]  # the tail class has no words
        inside, place = np.take(h, order, axis=0, out=_room("sorted", len(order), h.shape[1]), mode="clip"), target[order] % CLASS
        back = _room("back", len(order), HIDDEN)
        for c in range(CLASSES):
            for a in range(cut[c], cut[c + 1], ROWS):
                x = slice(a, min(a + ROWS, cut[c + 1]))
                by_word[c] += _slopes(inside[x], to_word[c], place[x], len(h), back[x])
        dh[order] += back
        return {"to_class": by_class[:-1], "class_bias": by_class[-1], "to_word": by_word[:, :-1], "word_bias": by_word[:, -1]}, dh


def input_ids(ids: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.where(ids < HEAD, ids, HEAD + (h % np.uint64(TAIL_INPUTS)).astype(np.int64))


def shifted(read: np.ndarray, begin: np.ndarray, start_id: int) -> np.ndarray:
    """What the network reads before each token: the token before it, at the start of a text the end."""
    out = np.r_[start_id, read[:-1]]
    out[begin[:-1]] = start_id
    return out


def start_of(vocab: Vocabulary) -> int:
    return int(vocab.find(np.array([END]))[0][0]) % HEAD


def score_texts(net: Network, read: np.ndarray, target: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sum of the natural log probabilities of each text's tokens; all texts advance together, window by window."""
    length = np.diff(begin)
    order = np.argsort(-length, kind="stable")
    total = np.zeros(len(length))
    state = np.zeros((len(length), HIDDEN + 1), np.float32)
    state[:, HIDDEN] = 1
    carry, tops = net.biased(), net.topped()
    length, begin = length[order], begin[:-1][order]
    longest = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(longest), side="left")  # texts with more than t tokens
    t = 0
    while t < longest:
        places = active[t:t + 256]
        places = places[:max(1, int(np.searchsorted(np.cumsum(places), 1 << 16)))]
        at = np.r_[0, np.cumsum(places)]
        states, reached = _room("states", int(at[-1]), HIDDEN + 1), np.empty(at[-1], np.int64)
        states[:, HIDDEN] = 1
        for i, (n, a, b) in enumerate(zip(places.tolist(), at.tolist(), at[1:].tolist())):
            np.add(begin[:n], t + i, out=reached[a:b])
            net.advance(read[reached[a:b]], state[:n], carry, states[a:b])
            state = states[a:b]
        rows = np.arange(at[-1]) - np.repeat(at[:-1], places)
        total += np.bincount(rows, net.log_probs(states, target[reached], tops), minlength=len(total))
        state, t = state.copy(), t + len(places)
    out = np.empty(len(total))
    out[order] = total
    return out


def fit(training: DataFrame, vocab: Vocabulary) -> Network | None:
    """``training``: doc_id, text."""
    net = Network(vocab.head_counts, vocab.tail_total)
    if not vocab.total:
        return None
    ids = training.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).distinct()
    shared = training.sparkSession.sparkContext.broadcast(vocab)
    start_id = start_of(vocab)

    def run(batches):
        for block in blocks(batches, "text"):
            h, begin = tokens(*flat(block.column("text")))
            target = shared.value.find(h)[0]
            read = shifted(input_ids(target, h), begin, start_id)
            for a, b in zip(begin, begin[1:]):
                for s in range(a, b, WINDOW):
                    e = min(b, s + WINDOW)
                    order = int(np.bitwise_xor.reduce(h[s:e] * np.arange(1, e - s + 1, dtype=np.uint64)) >> np.uint64(1))
                    yield pa.RecordBatch.from_pydict({"order": [order], "read": pa.array([read[s:e].astype(np.int32).tobytes()], pa.binary()),
                                                      "target": pa.array([target[s:e].astype(np.int32).tobytes()], pa.binary())})

    sample = training.join(F.broadcast(ids), "doc_id").select("text").mapInArrow(run, "order long, read binary, target binary")  # SAMPLE_DOCS ids
    rows = sample.orderBy("order", "read", "target").limit(WINDOWS).toArrow().to_pylist()
    if rows:
        net.train([(np.frombuffer(r["read"], np.int32).astype(np.int64), np.frombuffer(r["target"], np.int32).astype(np.int64)) for r in rows])
    return taught(training, vocab, net)


def taught(training: DataFrame, vocab: Vocabulary, net: Network) -> Network:
    """``net`` after a pass over every token of ``training`` (a column text), all tasks side by side from the same start."""
    shared = training.sparkSession.sparkContext.broadcast((vocab, net))
    start_id = start_of(vocab)

    def run(batches):
        vocab, own = shared.value[0], copy.copy(shared.value[1])
        steps, seen, held = _Steps(own), 0, [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
        for block in blocks(batches, "text"):
            h, begin = tokens(*flat(block.column("text")))
            target = vocab.find(h)[0]
            fresh = np.zeros(len(h), bool)
            fresh[begin[:-1]] = True
            held = [np.concatenate(x) for x in zip(held, (shifted(input_ids(target, h), begin, start_id), target, fresh))]
            full = len(held[0]) // FULL * FULL  # what is left over goes before the next block's texts
            own.follow(steps, *(x[:full] for x in held))
            held = [x[full:] for x in held]
            seen += len(h)
        own.follow(steps, *held)
        if seen:
            found = own.weights() * seen
            slots = range(0, len(found), SLOT)
            n = len(slots)
            yield pa.RecordBatch.from_pydict({"slot": pa.array(range(n), pa.int32()), "task": pa.array([TaskContext.get().partitionId()] * n, pa.int32()),
                                              "seen": pa.array([seen] * n, pa.int64()), "sums": pa.array([found[a:a + SLOT] for a in slots], pa.list_(pa.float64()))})

    def added(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("task")
        total = sum(x.values.to_numpy() for x in rows["sums"].combine_chunks())
        return pa.table({"slot": rows["slot"][:1], "mean": pa.array([total / pc.sum(rows["seen"]).as_py()], pa.list_(pa.float64()))})

    means = training.select("text").mapInArrow(run, "slot int, task int, seen long, sums array<double>").groupBy("slot").applyInArrow(
        added, "slot int, mean array<double>").toArrow().sort_by("slot")  # the weights of one network
    return net.with_weights(np.concatenate([x.values.to_numpy() for x in means["mean"].combine_chunks()])) if means.num_rows else net


def scores(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row. Rows that ``held_out`` marks teach nothing."""
    rows = docs.select(F.col("doc_id"), whole().alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    training = rows.where(~F.col("held_out")).select("doc_id", "text")
    counts = written(count_tokens(training))
    vocab = vocabulary(counts)
    net = fit(training, vocab)
    base = vocab.total + 0.1 * (vocab.distinct + 1)
    tail = vocab.tail_total + 0.1 * (vocab.tail_distinct + 1)
    start_id = start_of(vocab)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, net))  # LOOKUP words and the network

    def counted(block, vocab):
        """What a block's texts need of the network (ids to read and to predict), and its columns without the network's part."""
        h, begin = tokens(*flat(block.column("text")))
        n = np.diff(begin)
        ids, c = vocab.find(h)
        row = np.repeat(np.arange(block.num_rows), n)
        seen = c >= 0
        in_tail = seen & (ids == HEAD)
        model = np.bincount(row[in_tail], np.log10((c[in_tail] + 0.1) / tail), minlength=block.num_rows).astype(float)
        known = np.bincount(row[seen], minlength=block.num_rows)
        sums = np.bincount(row[seen], np.log10((c[seen] + 0.1) / base), minlength=block.num_rows).astype(float)
        order = np.lexsort((h[~seen], row[~seen]))
        rare, rare_row = h[~seen][order], row[~seen][order]
        first = np.flatnonzero(np.r_[True, (rare[1:] != rare[:-1]) | (rare_row[1:] != rare_row[:-1])]) if len(rare) else np.zeros(0, np.int64)
        times = np.diff(np.r_[first, len(rare)]) if len(first) else np.zeros(0, np.int64)
        offsets = pa.array(np.searchsorted(rare_row[first], np.arange(block.num_rows + 1)), pa.int32())
        columns = [block.column("doc_id"), block.column("held_out"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(sums),
                   pa.ListArray.from_arrays(offsets, pa.array(rare[first].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))]
        return shifted(input_ids(ids, h), begin, start_id).astype(np.int16), ids.astype(np.int16), n, model, columns

    def run(batches):
        vocab, net = shared.value

        def finished(held):
            n = np.concatenate([x[2] for x in held])
            model = np.zeros(len(n))
            if net is not None:
                model = score_texts(net, np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), np.r_[0, np.cumsum(n)]) / np.log(10)
            at = 0
            for _, _, n, tails, columns in held:
                score = pa.array(model[at:at + len(n)] + tails)
                at += len(n)
                yield pa.RecordBatch.from_arrays([*columns[:5], score, *columns[5:]],
                                                 names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "times"])

        held, size = [], 0
        for block in blocks(batches, "text"):
            held.append(counted(block, vocab))
            size += int(held[-1][2].sum())
            if size >= SCORE_TOKENS:  # many texts side by side, so that a step of the network is worth its call
                yield from finished(held)
                held, size = [], 0
        if held:
            yield from finished(held)

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
                                  "rare array<long>, times array<long>")
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()))  # the number holds from here on: the table is stored
    rare = scored.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select(
        "row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    n = F.coalesce("n", F.lit(0))
    rest = (rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("known"), F.sum(F.col("times") * F.log10((n + 0.1) / F.lit(base))).alias("base"),
        F.sum(F.col("times") * F.log10((n + 0.1) / F.lit(tail))).alias("model")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return (scored.drop("rare", "times").join(rest, "row", "left")
            .select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
                    F.lit(vocab.total).cast("long").alias("train_tokens"), (F.col("base_score") + zero("base")).alias("base_score"),
                    (F.col("score") + zero("model")).alias("score")))


@query("op8_lm_scores")
def lm_scores(spark, folder: str) -> DataFrame:
    return scores(table(spark, folder, "documents"), fold_of("doc_id", 10) == 0)
