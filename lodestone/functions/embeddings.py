"""Deterministic stand-in embeddings and byte-exact hashes of vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Dimension of a vector, and the congruential generator.
DIMENSION, FACTOR, STEP, MODULUS = 384, 9301, 49297, 233280


def string_hash(text: Column) -> Column:
    """|h| of h = 31 h + code, kept to 32 signed bits after each UTF-16 unit of the Basic Multilingual Plane."""
    codes = F.transform(F.split(text, ""), lambda c: F.when(c == "", 0).otherwise(F.ascii(c)).cast("long"))
    wrap = lambda x: F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    return F.abs(F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + c)))


def mock_embedding(text: Column, dimension: int = DIMENSION) -> Column:
    """``dimension`` numbers in [-1, 1) from a linear congruential generator seeded by the hash of the text."""
    start = F.struct(string_hash(text).alias("seed"), F.array().cast("array<double>").alias("out"))
    step = lambda acc, _: F.struct(F.pmod(acc["seed"] * FACTOR + STEP, F.lit(MODULUS)).alias("seed"), F.concat(acc["out"], F.array(F.pmod(acc["seed"] * FACTOR + STEP, F.lit(MODULUS)) / MODULUS * 2 - 1)).alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(dimension)), start, step)["out"]


@pandas_udf(StringType())
def float32_sha256(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """SHA-256 of a vector's little-endian 32-bit floats, in hex; null for null."""
    for batch in vectors:
        yield batch.map(lambda v: None if v is None else hashlib.sha256(np.asarray(v, "<f4").tobytes()).hexdigest())


def cache_valid(vector: Column, model: Column, wanted: str, dimension: int) -> Column:
    """A cached vector of the right size and model, without missing or non-finite parts."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dimension) & (model == wanted) & finite, F.lit(False))
