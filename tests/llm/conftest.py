from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame

SF = "/root/testdata/sf0.001"
#: doc_id and text; the other columns have names that the operators use inside.
ODD_SCHEMA = ("doc_id bigint, text string, lang string, digest int, cls string, h bigint, score string, kept int, "
              "component_id string, shard int, row int, n int")


def invented(rng: random.Random, n: int) -> str:
    parts = ["the", "ther", "on", "ing", "éa", "ü", "and", "st", "of", "ñ"]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls, empty, white space, long texts, ties, repeated rows, equal ids."""
    rng = random.Random(5)
    long = invented(rng, 20_000)
    text = invented(rng, 120)
    near = text + " one more"
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, text), (4, text.upper()), (4, text.upper()), (5, near),
            (6, long), (7, long + " end"), (8, "a b"), (9, "A  B"), (10, "x"), (None, text), (None, None),
            (11, "tab\tand  two\n\n\nspaces   x"), (12, invented(rng, 60)), (12, invented(rng, 60)),
            (13, "w" * 50_000), (14, "<|endoftext|> don't 😀 é́"), (15, "1 " * 3000)]
    return [(i, t, None, 1, "c", 5, None, 0, "z", 3, None, 2) for i, t in rows]


@pytest.fixture(scope="session")
def odd(spark) -> DataFrame:
    return spark.createDataFrame(odd_rows(), ODD_SCHEMA)


@pytest.fixture(scope="session")
def empty(spark) -> DataFrame:
    return spark.createDataFrame([], ODD_SCHEMA)


@pytest.fixture(scope="session")
def documents(spark) -> DataFrame:
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark) -> DataFrame:
    return spark.read.parquet(f"{SF}/labels.parquet")


def texts(df: DataFrame) -> list[tuple]:
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def as_rows(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
