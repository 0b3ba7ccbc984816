"""Randomness as a pure function of (seed, tag, id), equal in Spark and in SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, tag: str, key: Column) -> Column:
    """In [0, 1): the first 32 bits of md5('seed:tag:key')."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(tag), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(seed: int, tag: str, key: Column) -> Column:
    """Standard normal by Box-Muller on two uniforms, rounded to 9 places so that ranks agree between engines."""
    u = uniform(seed, tag + "/r", key) + F.lit(1 / 4294967296.0)
    v = uniform(seed, tag + "/a", key)
    return F.round(F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2 * math.pi) * v), 9)


def uniform_sql(seed: int, tag: str, key: str) -> str:
    """``uniform`` in DuckDB SQL."""
    return f"(('0x' || substr(md5('{seed}:{tag}:' || ({key})::VARCHAR), 1, 8))::UBIGINT::DOUBLE / 4294967296::DOUBLE)"


def normal_sql(seed: int, tag: str, key: str) -> str:
    """``normal`` in DuckDB SQL."""
    u, v = uniform_sql(seed, tag + "/r", key), uniform_sql(seed, tag + "/a", key)
    return f"round(sqrt(-2::DOUBLE * ln({u} + 1::DOUBLE / 4294967296::DOUBLE)) * cos(2::DOUBLE * pi() * {v}), 9)"
