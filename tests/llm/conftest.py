from __future__ import annotations

import random

import pytest
from small_docs import STRUCT, row, sentence


@pytest.fixture(scope="session")
def corpus():
    """Rows in three languages with nulls, empty, short and very long texts, ties and repeated rows."""
    r = random.Random(1)
    rows = [row(i, sentence(r, ["en", "fr", "de"][i % 3], r.randint(20, 120)), ["en", "fr", "de"][i % 3], f"s{i % 4}") for i in range(300)]
    rows += [row(300, None, None, None), row(301, ""), row(302, " \t\n "), row(303, "12 34"), row(304, "x"), row(None, "a null id here it is", "en", None)]
    rows += [row(305, sentence(r, "en", 60_000)), row(306, "thing " * 30_000), row(307, "q" * 200_000)]
    rows += [rows[5], rows[5], row(308, rows[6][1]), row(309, rows[6][1]), rows[300], rows[305]]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, STRUCT).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], STRUCT)
