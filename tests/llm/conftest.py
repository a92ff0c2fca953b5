from __future__ import annotations

import random

import pytest

DATA = "/root/testdata/sf0.001"
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, kind int, bucket int, blob binary, key long, `group` long, sketch binary, n_removed string, kept string, n_tokens int, _range int"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, long, tied and repeated rows, and columns whose names the operators use inside."""
    rng = random.Random(8)
    long_ = " ".join(rng.choice(["alpha", "beta", "gamma.", "delta\n", "été", "日本"]) + str(rng.randint(0, 99)) for _ in range(30_000))
    texts = [(1, "One two three four five six. Seven eight nine ten eleven twelve thirteen."), (1, "One two three four five six. Seven eight nine ten eleven twelve thirteen."), (2, None), (3, ""), (4, " \n\t "), (5, long_), (6, "x"), (None, "A text without an id. It has no place in the order of documents, so it stays."), (None, None), (7, "One two three four five six. Seven eight nine ten eleven twelve thirteen."), (8, long_), (9, "▁ marks <s> and <|endoftext|> stay"), (10, "a" * 5000)]
    more = (None,) * 13
    return spark.createDataFrame([(d, t, *more) for d, t in texts], CLASHING)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], CLASHING)
