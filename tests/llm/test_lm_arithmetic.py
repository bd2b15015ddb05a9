"""The network's passes work in cache-sized runs of rows; what they return does not depend on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from spanseek.llm import common, lm_scores


def _network(rng, strength):
    net = lm_scores.Network(np.sort(rng.integers(1, 500, 150))[::-1], 90)
    for p in ("read", "carry", "carry_bias", "to_class", "to_word"):
        setattr(net, p, (strength * rng.standard_normal(getattr(net, p).shape)).astype(np.float32))
    return net


def _plain_loss(net, read, target):
    """Mean loss of streams that begin with no state, in doubles, word by word."""
    w = {p: getattr(net, p).astype(np.float64) for p in lm_scores._Steps.PARAMS}
    total = 0.0
    for ids, wanted in zip(read, target):
        h = np.zeros(lm_scores.HIDDEN)
        for i, t in zip(ids, wanted):
            u, x = h @ w["carry"] + w["carry_bias"][:, 0], w["read"][:, i]
            z, r = 1 / (1 + np.exp(-(u[0] + x[0]))), 1 / (1 + np.exp(-(u[1] + x[1])))
            new = np.tanh(x[2] + r * u[2])
            h = new + z * (h - new)
            scores = h @ w["to_class"] + w["class_bias"]
            total -= scores[t // lm_scores.CLASS] - np.logaddexp.reduce(scores)
            if t < lm_scores.HEAD:
                c = t // lm_scores.CLASS
                scores = h @ w["to_word"][c] + w["word_bias"][c]
                total -= scores[t % lm_scores.CLASS] - np.logaddexp.reduce(scores)
    return total / read.size


@pytest.mark.parametrize("strength", [0.5, 12.0])  # with strong weights most scores are far below what the weights allow
def test_scores_and_gradients_are_those_of_the_plain_formula(monkeypatch, strength):
    monkeypatch.setattr(lm_scores, "ROWS", 7)
    monkeypatch.setattr(lm_scores, "ROUNDS", 2)
    rng = np.random.default_rng(5)
    net = _network(rng, strength)
    read, target = rng.integers(0, 12, (5, 9)), np.where(rng.random((5, 9)) < 0.2, lm_scores.HEAD, rng.integers(0, 150, (5, 9)))
    scored = lm_scores.score_texts(net, read.ravel(), target.ravel(), np.arange(0, 46, 9))
    assert -scored.sum() / read.size == pytest.approx(_plain_loss(net, read, target), rel=1e-4)
    if strength > 1:
        return
    g, _ = net._gradients(read, target, np.zeros(read.shape, bool), np.zeros((5, lm_scores.HIDDEN), np.float32))
    for p in lm_scores._Steps.PARAMS:
        for place in rng.choice(np.flatnonzero(np.abs(g[p].ravel()) > 1e-4), 2):
            value, losses = getattr(net, p), []
            for step in (1e-3, -1e-3):
                moved = value.astype(np.float64)
                moved.ravel()[place] += step
                setattr(net, p, moved)
                losses.append(_plain_loss(net, read, target))
            setattr(net, p, value)
            assert g[p].ravel()[place] == pytest.approx((losses[0] - losses[1]) / 2e-3, rel=2e-3, abs=1e-6)


def test_hash_of_a_word_does_not_depend_on_its_place():
    raw = np.frombuffer(b"  one two one\n" * 3 + b"three", np.uint8)
    start, end, _ = common.words(raw, np.array([0, len(raw)]))
    found, power = common.word_hashes(raw, start, end), np.uint64(common.FACTOR)
    for h, a, b in zip(found, start, end):
        sums = np.uint64(b - a)
        for i, x in enumerate(raw[a:b]):
            sums = np.add(sums, np.multiply(np.uint64(int(x) + 1), np.power(power, np.uint64(i))))
        assert h == common.mixed(np.array([sums]))[0]


def test_words_with_the_same_low_bits_are_found(monkeypatch):
    monkeypatch.setattr(lm_scores, "PLACE_BITS", 2)
    words = np.sort(np.random.default_rng(1).integers(0, 2**60, 40).astype(np.uint64))
    vocab = lm_scores.Vocabulary(words, np.arange(40), np.arange(40), 40, 40, 0, 0, np.arange(40))
    ids, counts = vocab.find(np.r_[words, np.uint64(3), words[::-1] + np.uint64(1)])
    assert ids[:40].tolist() == counts[:40].tolist() == list(range(40)) and set(ids[40:]) == {lm_scores.HEAD} and set(counts[40:]) == {-1}


def test_tokens_left_over_by_a_block_are_read_with_the_next(monkeypatch):
    """Ten blocks of 37 tokens fill eleven runs of 32 tokens, two steps each; only the 18 tokens at the end take smaller steps."""
    class Training:
        class sparkSession:
            class sparkContext:
                broadcast = staticmethod(lambda value: type("Shared", (), {"value": value}))

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            self.run = run
            raise NotImplementedError

    for name, value in {"WIDE": 4, "UNROLL": 4, "LEAST_STEPS": 2, "FULL": 32}.items():
        monkeypatch.setattr(lm_scores, name, value, raising=False)
    monkeypatch.setattr(lm_scores, "blocks", lambda batches, _: batches)
    monkeypatch.setattr(lm_scores, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("T", (), {"partitionId": lambda _: 0})())}))
    rows, real = [], lm_scores.Network._gradients
    monkeypatch.setattr(lm_scores.Network, "_gradients", lambda net, read, *rest: rows.append(read.shape) or real(net, read, *rest))
    words = np.sort(np.random.default_rng(2).integers(0, 2**60, 40).astype(np.uint64))
    vocab = lm_scores.Vocabulary(words, np.ones(40, np.int64), np.arange(40), 40, 40, 0, 0, np.ones(40, np.int64))
    training = Training()
    with pytest.raises(NotImplementedError):
        lm_scores.taught(training, vocab, _network(np.random.default_rng(3), 0.5))
    batches = [pa.RecordBatch.from_pydict({"text": [" ".join(f"w{i}" for i in range(18)), "x " * 17]}) for _ in range(10)]
    found = list(training.run(iter(batches)))
    assert sum(n * m for n, m in rows) == 370 and found[0].column("seen")[0].as_py() == 370
    assert rows[:22] == [(4, 4)] * 22 and len(rows) <= 28
