"""Byte-pair encoding against the public library, spelling variants and conversation repair against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm.conftest import prose
from spanseek.llm import bpe, conversations, variants

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load(PATH)


def strings() -> list[str]:
    rng = random.Random(7)
    bits = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'ll", "é", "日本", "1", "23", "!", "--", "aaaa", "xx", "ing", "tion", "<|endoftext|>", "<|", "՘", "Ƛ",
            "\U00010940", "\x1c", "　", "\x85", "e", "n", "zzz", "\0", "👩‍👧"]
    mixed = ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(1500)]
    words = ["".join(rng.choice("abcdeth ino") for _ in range(rng.randrange(80))) for _ in range(1500)]
    return mixed + words + ["a" * n for n in range(70)] + ["", "ab" * 4000, prose(3, 3000), "<|endoftext|>" * 3]


def test_trie_is_in_depth_first_order():
    byte_of, depth_of, ends = bpe.trie([b"a", b"ab", b"abc", b"abd", b"b", b"bcd"])
    assert (bytes(byte_of), depth_of, bytes(ends)) == (b"abcdbbcd"[:4] + b"bcd", [1, 2, 3, 3, 1, 2, 3], b"\1\1\1\1\1\0\1")


def test_ids_equal_the_library(vocabulary, library):
    encoder, texts = bpe.Encoder(vocabulary), strings()
    wanted = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == wanted
    assert [encoder.encode([t])[0] for t in texts] == wanted  # known words, one text a block


def test_words_are_forgotten_without_harm(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 40)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 10)
    encoder = bpe.Encoder(vocabulary)
    for text in strings()[::40]:
        assert encoder.encode([text])[0] == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(encoder.known) < 2000 and all(len(w) <= bpe.LONG_WORD for w in encoder.known)


def test_pieces_of_a_long_text_change_nothing(vocabulary, library, monkeypatch):
    text = prose(5, 4000) + " \n\n  x" + "y" * 500 + " <|endoftext|>  z" + prose(6, 100)
    assert "".join(bpe.pieces(text, 50)) == text and len(list(bpe.pieces(text, 50))) > 100
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 64)
    monkeypatch.setattr(bpe.pieces, "__defaults__", (64,))
    ids = bpe.Encoder(vocabulary).encode([text])[0]
    assert ids == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("packed", [False, True])
def test_there_and_back_on_odd_rows(spark, odd, none, vocabulary, library, packed):
    clash = odd.withColumn("ids", F.lit("taken")).withColumn("text_", F.lit("t"))
    coded = bpe.encode(clash, vocabulary, ["doc_id", "ids", "text", "text_"], packed=packed)
    assert coded.columns == ["doc_id", "ids", "text", "text_", "ids_"]
    rows = bpe.decode(coded, vocabulary, ["doc_id", "text", "text_", "ids_"], ids="ids_").collect()
    assert len(rows) == odd.count()
    for r in rows:
        wanted = library.encode(r.text or "", add_special_tokens=False).ids
        assert (np.frombuffer(r["ids_"], "<u4").tolist() if packed else r["ids_"]) == wanted and r["text__"] == (r.text or "")
    assert bpe.decode(bpe.encode(none, vocabulary, ["doc_id"], packed=packed), vocabulary).count() == 0


def test_decode_takes_any_ids(spark, vocabulary, library):
    rng = random.Random(2)
    lists = [[rng.randrange(50257) for _ in range(rng.randrange(12))] for _ in range(200)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)] + [(200, None), (201, [99999, None, 64])], "n int, ids array<int>")
    got = {r.n: r.text for r in bpe.decode(rows, vocabulary, ["n"]).collect()}
    assert all(got[i] == library.decode(x, skip_special_tokens=False) for i, x in enumerate(lists)) and got[200] == "" and got[201] == "a"


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.load(public_tokenizers.path("word_bpe_49k.json"))


def test_query_op11(spark, tmp_path, library):
    from spanseek.llm.common import QUERIES

    rows = [(1, "Hello there"), (None, None), (3, ""), (3, ""), (4, prose(8, 300)), (5, "a <|endoftext|> b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["op11_bpe"](spark, str(tmp_path)).collect()), key=repr)

    def line(doc, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return (doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert got == sorted((line(*r) for r in rows), key=repr)


# ---- spelling variants ----------------------------------------------------------------------------------

def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    c = 0
    while c < min(len(a), len(b)) and a[c] == b[c]:
        c += 1
    return a[c + (len(a) >= len(b)):] == b[c + (len(b) >= len(a)):]


def brute_variants(counts: dict[str, int], factor: int = 10) -> dict[str, tuple]:
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    best = {w: min(near[w], key=lambda v: (-counts[v], v), default=None) for w in counts}
    form = {w: b if b is not None and counts[b] >= factor * counts[w] else None for w, b in best.items()}
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] is not None else None)
    return out


def similar_words(n: int, seed: int, letters: str, low: int, high: int) -> dict[str, int]:
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(low, high))) for _ in range(n)}
    for w in list(words):
        for _ in range(3):
            at = rng.randrange(len(w))
            words.add(rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1:]]))
    return {w: int(10 ** (4 * rng.random())) for w in words if w}


@pytest.mark.parametrize("cells", [variants.CELLS, 60])
def test_variants_equal_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(variants, "CELLS", cells)  # small lists are cut into blocks too
    counts = similar_words(150, 1, "abé", 7, 12) | similar_words(60, 2, "ab", 1, 6) | {"x" * 400: 50, "x" * 401: 2, "y" + "x" * 399: 5}
    words = spark.createDataFrame(list(counts.items()), "word string, n int")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.group_variants(words).collect()}
    assert got == brute_variants(counts)


def test_both_scans_find_what_all_pairs_find():
    rng = random.Random(5)
    for _ in range(150):
        size = rng.randrange(1, 11)
        stem = ("ab" * 20)[:size // 2]
        words = sorted({stem + "".join(rng.choice("abc") for _ in range(size - size // 2 + rng.randrange(2))) for _ in range(20)} - {""})
        scans = [kind([(w, 1) for w in words], size) for kind in (variants.SmallScan, variants.LargeScan)]
        for word in words:
            wanted = [i for i, w in enumerate(words) if one_edit(word, w)]
            assert [scan.feed(word) for scan in scans] == [wanted, wanted]


def test_roots_follow_long_chains(spark):
    chain = [f"w{i:02d}" for i in range(20)]
    forms = spark.createDataFrame(list(zip(chain, chain[1:])), "word string, form string")
    assert {r.root for r in variants.roots(forms).collect()} == {"w19"}


def test_query_op12(spark, tmp_path):
    from spanseek.llm.common import QUERIES

    rng = random.Random(9)
    stems = ["Conversation", "Größenordnung", "ÉCLATANTE", "hydrogen", "seventh", "xylophone", "short"]
    rows = [(i if i else None, " ".join(rng.choice(stems) + rng.choice(["", "", ",", "1"]) for _ in range(40))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "hydrogén hydrogén xylofone xylofone " + "z" * 3000), (202, "hydrogén " + "z" * 3000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    wanted = brute_variants({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in QUERIES["op12_spelling_variants"](spark, str(tmp_path)).collect()}
    assert got == wanted and any(v[0] for v in wanted.values())
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert variants.group_variants(variants.vocabulary(variants.damaged(variants.runs(empty)))).count() == 0


# ---- conversation repair --------------------------------------------------------------------------------

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def brute_edits(initials: str, must: list[bool], cut: list[bool]) -> tuple[int, str]:
    """All edits, by the grammar's states and with at most two inserted turns in a row."""
    @lru_cache(None)
    def go(i: int, state: str, inserted: int):
        found = [(0, "")] if i == len(initials) and state in ("", "a") else []
        steps = [(2, "I", i, NEXT[state], inserted + 1)] if inserted < 2 else []
        if i < len(initials):
            steps.append((3, "D", i + 1, state, 0))
            toll = int(cut[i])
            if not must[i]:
                steps.append((2 + toll, "R", i + 1, NEXT[state], 0))
                if initials[i] == NEXT[state] or (state == "" and initials[i] == "s"):
                    steps.append((toll, "K", i + 1, initials[i], 0))
        for cost, edit, *then in steps:
            rest = go(*then)
            if rest is not None:
                found.append((cost + rest[0], edit + rest[1]))
        return min(found, default=None)
    return go(0, "", 0)


def test_alignment_equals_brute_force():
    rng = random.Random(3)
    for _ in range(1500):
        n = rng.randrange(13)
        initials = "".join(rng.choice("uuuaaaasst") for _ in range(n))
        must = [rng.random() < .15 for _ in range(n)]
        cut = [not m and rng.random() < .3 for m in must]
        assert conversations.align(initials, must, cut) == brute_edits(initials, must, cut)


def brute_repair(rows: list[tuple]) -> dict:
    kept: dict = {}
    for conv, turn, role, text in rows:
        kept.setdefault(conv, [])
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        kept[conv] += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = {}
    for conv, said in kept.items():
        said.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in said:
            signs = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("b" if not signs else "d" if (role, text) in seen else "" if signs[-1] in ".!?" else "t")
            seen.add((role, text))
        initials = "".join(role[:1] or " " for _, role, _ in said)
        cost, audit = brute_edits(initials, [f in ("b", "d") for f in faults], [f == "t" for f in faults])
        turns = [t for t, _, _ in said if t is not None]
        lines, left, state = [], list(said), ""
        for edit in audit:
            _, role, text = left.pop(0) if edit != "I" else (0, "", "")
            if edit == "K":
                state = role[0]
                lines.append(f"{role}:{text}")
            elif edit != "D":
                state = NEXT[state]
                lines.append({"u": "user", "a": "assistant"}[state] + f":{text}")
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost,
                     audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def spoken() -> list[tuple]:
    rng = random.Random(4)
    texts = ["Hi.", "ok", "Good day!", "  ", "", None, "x?", "y. ", "A", "B.", "\x0b\x0c", "\x1f", "long " * 4000 + "end.", *[f"{i}." for i in range(60)]]
    rows = []
    for conv in range(60):
        for i in range(rng.randrange(1, 25)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool", ""])
            rows.append((conv or None, rng.choice([i, i, i, i + 3, None, i // 2]), role, rng.choice(texts)))
    return rows + rows[-3:] + [(99, 3, "user", "Dropped?")] * 0


@pytest.mark.parametrize("limits", [{}, {"long": 3, "segment": 4}])
def test_repair_equals_brute_force(spark, limits):
    rows = spoken()
    gone = next(c for c in range(100, 200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "Nothing stays.")] * 5
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, cost int")
    got = conversations.repair(conversations.damaged(frame), F.col("present"), **limits)
    assert got.columns == list(conversations.RESULT)
    found = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, hashlib.sha256(r.repaired.encode()).hexdigest())
             for r in got.collect()}
    assert found == brute_repair(rows) and found[gone] == (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())


def test_repair_of_nothing_and_of_plain_rows(spark):
    schema = "conv_id string, turn int, role string, text string"
    assert conversations.repair(spark.createDataFrame([], schema)).count() == 0
    row = conversations.repair(spark.createDataFrame([("a", 1, "system", "Be."), ("a", 3, "user", "Hm")], schema)).first()
    assert (row.gaps, row.truncated, row.illegal, row.cost, row.audit, row.repaired) == (1, 1, 0, 3, "KKI", "system:Be.\nuser:Hm\nassistant:")


def test_query_op13(spark, tmp_path):
    from spanseek.llm.common import QUERIES

    rows = spoken()
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()
    assert {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))
            for r in got} == brute_repair(rows)
