"""Deterministic randomness: every draw is a function of a seed and the logical key of what is drawn.

The same draws in SQL: see :func:`uniform_sql`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 1 << 28


def _key(seed: int, keys: tuple) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), *[(k if isinstance(k, Column) else F.lit(k)).cast("string") for k in keys])


def draw(seed: int, *keys) -> Column:
    """An integer in [0, 2**28)."""
    return F.conv(F.substring(F.md5(_key(seed, keys)), 1, 7), 16, 10).cast("bigint")


def uniform(seed: int, *keys) -> Column:
    """A double in [0, 1)."""
    return draw(seed, *keys) / F.lit(float(SCALE))


def uniform_sql(seed: int, *keys: str) -> str:
    """The same number in DuckDB's SQL; ``keys`` are SQL expressions."""
    parts = ", ".join(f"cast({k} as varchar)" for k in keys)
    return f"(cast('0x' || substr(md5(concat_ws('|', '{seed}', {parts})), 1, 7) as bigint) / {SCALE}.0::double)"
