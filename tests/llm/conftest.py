from __future__ import annotations

import random

import pytest

WORDS = "amber basin cedar delta ember fjord glade heron inlet joker knoll lemon maple nadir ochre piano quilt raven sable tulip umbra viola wheat xenon yucca zebra".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) * (rng.random() < 0.3) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names operators use themselves."""
    rows = [(1, "Short text, one line.", "en", "src1"), (1, "Short text, one line.", "en", "src1"), (None, "No id here at all.", None, None),
            (2, None, "en", "src2"), (3, "", None, "src3"), (4, "  \n\t ", "de", None), (5, prose(1, 40_000), "en", "src1"), (6, "x" * 300_000, "en", "src1"),
            (7, "é ü ñ 日本語 – text", "fr", "src9"), (8, prose(2, 60), "en", "src0"), (9, prose(2, 60), "en", "src0")]
    rows = [(*r, len(r[1] or ""), "c", 1, 2.0, "k", "p") for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, label string, key int, score double, "
                                       "pii string, _key string")


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)
