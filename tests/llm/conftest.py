from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame, SparkSession

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, size string, __text string"


def documents() -> list[tuple]:
    """Texts with copies, near copies, shared passages and awkward values; (doc_id, text, lang, source)."""
    rng = random.Random(5)
    words = ["".join(rng.choice(["an", "ti", "re", "on", "sh", "ed", "wh", "er"]) for _ in range(rng.randint(1, 3))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = text(70), text(200)
    out = []
    for i in range(40):
        t = text(rng.randint(1, 150))
        if i % 5 == 0:
            t = f"{t} {passage}\n{text(20)}"
        if i % 7 == 0:
            t = base
        if i % 7 == 1:
            w = base.split()
            w[100 + i] = "changed"
            t = " ".join(w)
        out.append((i, t, "en" if i % 3 else "fr", ["a", "b", None][i % 3]))
    out += [(50, None, "en", "a"), (51, "", "en", "b"), (52, "  \n\t", None, None), (53, "x" * 5000, "en", "a"), (54, text(6000), "en", "b")]
    out += [(55, "12 34 !!", "en", "a"), (None, text(80), "en", "a"), (None, None, None, None), out[3], out[3], (60, " Café \U0001f600 ▁x", "fr", "b")]
    return out


@pytest.fixture(scope="session")
def docs(spark: SparkSession) -> DataFrame:
    rows = [(i, t, lang, s, len(t or ""), "clash", "clash", "clash") for i, t, lang, s in documents()]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], COLUMNS)
