from __future__ import annotations

import random

import pytest
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType


@pytest.fixture(scope="session")
def documents(spark):
    """documents rows from (doc_id, text[, source]) with columns that clash with the operations' own names."""
    schema = StructType(
        [
            StructField("doc_id", LongType()),
            StructField("text", StringType()),
            StructField("lang", StringType()),
            StructField("source", StringType()),
            StructField("n_chars", LongType()),
            StructField("score", StringType()),
            StructField("sig", LongType()),
            StructField("component_id", LongType()),
            StructField("_row", IntegerType()),
        ]
    )

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), "x", 1, 2, 3) for r in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def embeddings(spark):
    schema = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType())), StructField("cls", StringType()), StructField("score", LongType())])
    return lambda rows: spark.createDataFrame([(i, v, "x", 0) for i, v in rows], schema)


@pytest.fixture
def prose():
    """Texts of so many words from a small vocabulary, repeatable."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(900)]

    def text(n, seed):
        own = random.Random(seed)
        return " ".join(own.choice(vocabulary) for _ in range(n))

    return text
