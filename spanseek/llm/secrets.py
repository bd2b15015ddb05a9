"""Secret scans: proposals filtered by a random forest.

A proposal is a run of at least ``SHORTEST`` signs of keys (letters, digits, ``+ / _ -``) with both a letter and a digit, or any run of that length
that a word for secrets is assigned to (``password: ...``). A forest of decision trees then tells secrets from what only looks like them, by length,
transitions between kinds of characters, coverage by dictionary words, the path (``source``) and the neighbouring words. It is fitted on the driver
from labelled findings; ``labelled_findings`` builds a documented set of them, and any other list of the same shape can be given.

Null and empty texts have no proposals. A run of any length is proposed, and all of it is described; the forest tells long keys and tokens from data.
Positions count code points, the end is exclusive. Repeated rows give repeated findings; nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanseek.llm.common import blocks, flat, query, table, whole

SHORTEST = 8
TREES, DEEPEST, LEAST = 40, 8, 4
NEAR = 32  # bytes looked at on either side

_KEY = np.zeros(256, bool)
for _low, _high in ((48, 58), (65, 91), (97, 123)):
    _KEY[_low:_high] = True
_KEY[[43, 45, 47, 95]] = True
_ASSIGNED = re.compile(rb"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|credential|auth|bearer|api[_-]?key|access[_-]?key|private[_-]?key|key)[\"']?\s{0,2}[:=]\s{0,2}[\"']?\Z")
_WORDS_FOR = re.compile(rb"(?i)pass(?:word|wd|phrase)?|pwd|secret|token|credential|auth|bearer|api[_-]?key|access[_-]?key|private[_-]?key|aws|stripe|slack")
_WORDS_AGAINST = re.compile(rb"(?i)commit|sha-?\d*|md5|hash|uuid|guid|version|checksum|digest|example|sample|placeholder|dummy|test|isbn|order|invoice|ticket|https?:|www|id[:=]")
_TEST_PATH = re.compile(rb"(?i)test|example|sample|doc|fixture|mock|spec")
_FORMAT = re.compile(rb"AKIA[0-9A-Z]{16}\Z|gh[pousr]_[A-Za-z0-9]{36}\Z|xox[abprs]-[A-Za-z0-9-]{10,}\Z|sk_live_[A-Za-z0-9]{16,}\Z|AIza[0-9A-Za-z_-]{35}\Z|glpat-[A-Za-z0-9_-]{20}\Z|eyJ[A-Za-z0-9_-]{10,}")
_UUID = re.compile(rb"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\Z")

# Common parts of identifiers and prose.
DICTIONARY = tuple(b"""about access account action admin after agent alert align alpha amount android apple array article asset async author back backup
balance bank base batch before beta block board body book border bottom branch browser buffer build button cache call camera card case center change
channel chapter character check child class clean click client clock close cloud code color column comment commit common company config connect content
control copy count country course cover create credit current custom customer daily dark data date debug default delete demo design desktop detail
device digital direct display document domain download draft driver edit email employee enable engine error event example export failed false field
figure file filter final find first folder font footer form format forum frame free friday from front function game gallery general global google green
group guide handler header health height hello help hidden history home host hotel house hover http image import index info input insert install
internal invoice issue item january java july june keep kernel language large last latest layout left legal length level library light limit line link
linux list load local location login long machine mail main manager march margin market master match media member memory menu merge message method
middle minute mobile model module monday money month mouse movie music name network news next node north note null number object office online open
option order other output owner package page panel paper parent part password path payment people phone photo picture pixel place plan play player
plugin point policy popup post power press price print private process product profile program project public query queue quick random read record
region release remote report request reset response result return review right role root route sample save scale schema score screen script search
section select send serial series server service session setting share shop short show side sign simple single site size small social song sort sound
source space spring stack staff stage standard start state station status step stock stop store story stream street string student style submit
subject summer support switch system table target team template test text theme thread ticket time title token tool total track train travel tree true
type union unit update upload user value vendor version video view visit wait watch water week west white width window winter word work world write
year yellow your zone the and for that with this are was""".split())


@dataclass(frozen=True)
class Finding:
    before: bytes
    value: bytes
    after: bytes
    path: bytes
    is_secret: bool


def _pairs_of_text() -> np.ndarray:
    """Log probability of each pair of small letters inside dictionary words."""
    count = np.full((26, 26), 0.5)
    for w in DICTIONARY:
        for a, b in zip(w, w[1:]):
            count[a - 97, b - 97] += 1
    return np.log(count / count.sum(1, keepdims=True))


_PAIR = _pairs_of_text()
_KIND = np.full(256, 3, np.uint8)  # small letters, capitals, digits, others
for _kind, (_low, _high) in enumerate(((97, 123), (65, 91), (48, 58))):
    _KIND[_low:_high] = _kind


def _entries() -> re.Pattern:
    """The longest dictionary word at each place, which covers the shorter ones that begin there; branches by first letter."""
    words = sorted((w for w in set(DICTIONARY) if 3 <= len(w) <= 9), key=lambda w: (-len(w), w))
    firsts = sorted({w[:1] for w in words})
    return re.compile(b"(?=(" + b"|".join(c + b"(?:" + b"|".join(w[1:] for w in words if w[:1] == c) + b")" for c in firsts) + b"))")


_ENTRIES = _entries()


def describe(f: Finding) -> list[float]:
    """The numbers that the trees split on."""
    v, low, n = f.value, f.value.lower(), max(1, len(f.value))
    signs = np.frombuffer(v, np.uint8)
    kinds = _KIND[signs]
    count = np.bincount(signs) if v else np.zeros(1)
    share = count[count > 0] / n
    letters = np.frombuffer(low, np.uint8)
    letters = letters[(letters >= 97) & (letters <= 122)].astype(np.int64) - 97
    pairs = _PAIR[letters[:-1], letters[1:]]
    covered = np.zeros(n + 1, np.int64)  # +1 where a word begins, -1 after its end
    for m in _ENTRIES.finditer(low):
        covered[m.start()] += 1
        covered[m.end(1)] -= 1
    of = [int((kinds == k).sum()) for k in range(4)]
    return [
        float(n), float(-(share * np.log2(share)).sum()), int((kinds[1:] != kinds[:-1]).sum()) / n, of[2] / n, of[1] / n,
        of[3] / n, float(np.mean(pairs)) if len(pairs) else -6.0, float((np.cumsum(covered)[:-1] > 0).sum()) / n, max(share) if len(share) else 1.0,
        float(not v.strip(b"0123456789abcdefABCDEF")), float(bool(_UUID.match(v))), float(bool(_FORMAT.match(v))),
        float(bool(_ASSIGNED.search(f.before))), float(bool(_WORDS_FOR.search(f.before))), float(bool(_WORDS_AGAINST.search(f.before))),
        float(bool(_WORDS_AGAINST.search(f.after))), float(bool(_TEST_PATH.search(f.path))), float(f.before[-1:] in (b'"', b"'", b"=", b":")),
        float(len(set(low)) <= 3), float(bool(re.search(rb"(?i)x{4}|\*{3}|your|change|example|0123|1234|abcd|dummy", v)))]


def labelled_findings(seed: int = 23, each: int = 90) -> list[Finding]:
    """Findings of every sort that the rule meets, in the surroundings they come in."""
    rng = np.random.default_rng(seed)
    hexes, low, alnum = b"0123456789abcdef", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda signs, n: bytes(rng.choice(np.frombuffer(signs, np.uint8), n).tolist())
    one = lambda options: options[int(rng.integers(len(options)))]
    word = lambda: one(DICTIONARY)
    prose = lambda: b" ".join(word() for _ in range(3)) + b" "
    paths = lambda: one((b"src" + draw(b"0123456789", 2), b"config/settings.py", b"src/app/main.js", b"notes", b"web", b"tests/fixtures/data.py"))
    for_it = (b'token = "', b"password=", b"api_key: ", b"secret='", b"AWS_SECRET_ACCESS_KEY=", b"auth_token: ", b'"apiKey": "', b"pwd=", b"Bearer token: ")
    against = (b"commit ", b"sha256:", b"md5 = ", b"uuid=", b"version ", b"checksum: ", b"https://host/", b"id=", b"see ", b"digest ")
    out = []
    add = lambda before, value, secret, path=None: out.append(Finding((prose() + before)[-NEAR:], value, b'" ' + prose(), path or paths(), secret))
    for _ in range(each):
        add(one(for_it), draw(hexes, int(one((16, 18, 20, 32, 40, 64)))), True)
        add(one(for_it), draw(alnum, int(rng.integers(12, 44))), True)
        add(one(for_it), draw(alnum + b"+/", int(rng.integers(24, 64))), True)
        add(one((b"", b"key: ", b'token = "')), one((b"AKIA" + draw(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), b"ghp_" + draw(alnum, 36),
                                                       b"xoxb-" + draw(b"0123456789", 11) + b"-" + draw(alnum, 24), b"sk_live_" + draw(alnum, 24),
                                                       b"AIza" + draw(alnum, 35), b"glpat-" + draw(alnum, 20))), True)
        add(one((b"password: ", b"passwd=", b"pwd = '")), word() + draw(b"0123456789!_-"[:10], 3) + draw(low, 4), True)
        add(one(against), draw(hexes, int(one((8, 12, 32, 40, 64)))), False)
        add(one((b"id: ", b"uuid=", b"", b"request ")), b"-".join(draw(hexes, n) for n in (8, 4, 4, 4, 12)), False)
        add(b"", word() + word() + draw(b"0123456789", int(rng.integers(1, 5))), False)
        add(b"", word() + b"-" + draw(b"0123456789", 2) + b"-" + word(), False)
        add(one(for_it), one((b"your-api-key-1", b"xxxxxxxx1234", b"example_token_123", b"changeme123", b"0123456789abcdef", b"dummy-password-1", b"YOUR_TOKEN_HERE1")), False)
        add(b"", draw(low, int(rng.integers(5, 12))) + draw(b"0123456789", 2), False)
        add(one((b"mail ", b"user ", b"")), word() + draw(b"0123456789", 3), False)
        add(one((b"order ", b"card ", b"tel ")), draw(b"0123456789", 4) + b"-" + draw(b"0123456789", 4) + b"-" + draw(b"0123456789", 4) + b"x", False)
        add(b"", b"/".join(word() for _ in range(3)) + b"/" + draw(b"0123456789", 4), False)
        add(one((b"key: ", b"token: ")), word() + b"_" + word(), False)
        add(one(for_it), draw(hexes, 32), False, b"tests/example_data.py")
    for _ in range(each // 3):  # long ones, which are keys and tokens where something says so, and data elsewhere
        long = lambda: int(2 ** rng.uniform(7, 12))
        add(one((b"Authorization: Bearer ", b"bearer ", b"auth: Bearer ", b'"access_token": "', b"token = eyJhbGciOiJIUzI1NiJ9.")), draw(alnum + b"-_", long()), True)
        add(one((b"Authorization: Bearer ", b"jwt ", b'token = "', b"")), b"eyJ" + draw(alnum + b"-_", long()), True)
        add(one((b'private_key = "', b"PRIVATE_KEY=", b"secret_key: ", b"credential='", b"api_key=")), draw(alnum + b"+/", long()), True)
        add(one(for_it), draw(hexes, int(one((128, 256, 512, 1024)))), True)
        add(one((b"data:image/png;base64,", b"url(data:font/woff2;base64,", b"", b"", b"body ", b"see ")), draw(alnum + b"+/", long()), False)
        add(one(against), draw(hexes, int(one((96, 128, 256, 512, 1024)))), False)
        add(one((b"", b"https://host/", b"sequence ")), one((b"/", b"-", b"_")).join(word() + draw(b"0123456789", 1) for _ in range(long() // 8)), False)
        add(one((b"", b"sequence ", b"id: ")), one((draw(b"ACGT", long()) + b"1", draw(b"01", long()) + b"b", b"a1" * (long() // 2))), False)
    return out


@dataclass(frozen=True)
class Forest:
    """Trees as parallel arrays: the feature of a node (-1 at a leaf), its threshold, its children, and the share of secrets at it."""

    trees: tuple[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], ...]

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEEPEST + 1):
                inner = feature[node] >= 0
                goes = x[np.arange(len(x)), np.maximum(feature[node], 0)] <= threshold[node]
                node = np.where(inner, np.where(goes, left[node], right[node]), node)
            total += share[node]
        return total / len(self.trees)


def _tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator):
    feature, threshold, left, right, share = [], [], [], [], []

    def grow(rows: np.ndarray, depth: int) -> int:
        me = len(feature)
        for column, value in ((feature, -1), (threshold, 0.0), (left, me), (right, me), (share, float(y[rows].mean()))):
            column.append(value)
        if depth == DEEPEST or len(rows) < 2 * LEAST or share[me] in (0.0, 1.0):
            return me
        best = (1e-9, -1, 0.0)
        whole_gini = share[me] * (1 - share[me])
        for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1]))) + 1, replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(order))
            cut = (v[1:] > v[:-1]) & (n >= LEAST) & (len(order) - n >= LEAST)
            if cut.any():
                a, b = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(order) - n)
                gain = whole_gini - (n * a * (1 - a) + (len(order) - n) * b * (1 - b)) / len(order)
                i = int(np.argmax(np.where(cut, gain, -1)))
                if gain[i] > best[0]:
                    best = (float(gain[i]), int(f), float((v[i] + v[i + 1]) / 2))
        if best[1] >= 0:
            feature[me], threshold[me] = best[1], best[2]
            goes = x[rows, best[1]] <= best[2]
            left[me], right[me] = grow(rows[goes], depth + 1), grow(rows[~goes], depth + 1)
        return me

    grow(rng.integers(0, len(x), len(x)), 0)
    return tuple(np.array(c) for c in (feature, threshold, left, right, share))


def fit(findings: list[Finding], seed: int = 29) -> Forest:
    rng = np.random.default_rng(seed)
    x = np.array([describe(f) for f in findings])
    y = np.array([f.is_secret for f in findings], float)
    return Forest(tuple(_tree(x, y, rng) for _ in range(TREES)))


@lru_cache(maxsize=1)
def default_forest() -> Forest:
    return fit(labelled_findings())


def propose(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) in bytes of every proposal."""
    none = (np.zeros(0, np.int64),) * 3
    if len(raw) == 0:
        return none
    key = _KEY[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[at[:-1]] = True
    start = np.flatnonzero(key & (np.r_[True, ~key[:-1]] | first[:-1]))
    end = np.flatnonzero(key & (np.r_[~key[1:], True] | first[1:])) + 1
    long = end - start >= SHORTEST
    start, end = start[long], end[long]
    if len(start) == 0:
        return none
    digit = np.r_[0, np.cumsum((raw >= 48) & (raw <= 57))]
    digits = digit[end] - digit[start]
    sign = np.r_[0, np.cumsum((raw == 43) | (raw == 45) | (raw == 47) | (raw == 95))]
    letters = end - start - digits - (sign[end] - sign[start])
    row = np.searchsorted(at, start, side="right") - 1
    mixed = (digits > 0) & (letters > 0)
    before = raw[np.maximum(start - 1, 0)]
    maybe = np.flatnonzero((~mixed) & (start > at[row]) & ((before == 61) | (before == 58) | (before == 34) | (before == 39) | (before == 32)))
    # only those with an equals sign or colon just before are looked at by the expression
    assigns = np.r_[0, np.cumsum((raw == 61) | (raw == 58))]
    maybe = maybe[assigns[start[maybe]] > assigns[np.maximum(start[maybe] - 4, at[row[maybe]])]]
    for i in maybe:
        if _ASSIGNED.search(raw[max(at[row[i]], start[i] - NEAR):start[i]].tobytes()):
            mixed[i] = True
    return row[mixed], start[mixed], end[mixed]


def scan(docs: DataFrame, forest: Forest | None = None, path: str = "source") -> DataFrame:
    """doc_id, start, end, score, is_secret of every proposal."""
    shared = docs.sparkSession.sparkContext.broadcast(forest or default_forest())  # TREES trees of bounded depth
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"), whole(path).alias("path"))

    def run(batches):
        trees = shared.value
        for block in blocks(batches, "text"):
            raw, at = flat(block.column("text"))
            row, start, end = propose(raw, at)
            if len(row) == 0:
                continue
            paths = [p.encode() for p in block.column("path").to_pylist()]
            points = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
            for s in range(0, len(row), 4096):
                r, a, b = row[s:s + 4096], start[s:s + 4096], end[s:s + 4096]
                x = np.array([describe(Finding(raw[max(at[i], f - NEAR):f].tobytes(), raw[f:t].tobytes(), raw[t:min(at[i + 1], t + NEAR)].tobytes(), paths[i], False))
                              for i, f, t in zip(r, a, b)])
                score = np.round(trees.scores(x), 6)
                yield pa.RecordBatch.from_arrays([block.column("doc_id").take(pa.array(r)), pa.array(points[a] - points[at[r]]),
                                                  pa.array(points[b] - points[at[r]]), pa.array(score), pa.array(score >= 0.5)],
                                                 names=["doc_id", "start", "end", "score", "is_secret"])

    return rows.mapInArrow(run, "doc_id long, start long, end long, score double, is_secret boolean")


@query("op5_secret_scan")
def secret_scan(spark, folder: str) -> DataFrame:
    return scan(table(spark, folder, "documents"))
