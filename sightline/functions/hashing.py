"""Reproducible order tokens and uniforms derived from ids.

md5 text is used instead of a seeded generator so that a sample depends on the
seed and the row only, not on partitioning, retries or executor loss.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def token(seed: object, *parts: Column | str) -> Column:
    """md5 of ``seed:part:part...``; sorting by it is a seeded shuffle."""
    pieces = [F.lit(str(seed))]
    for part in parts:
        column = F.col(part) if isinstance(part, str) else part
        pieces.append(column.cast("string"))
    return F.md5(F.concat_ws(":", *pieces))


def uniform(seed: object, *parts: Column | str) -> Column:
    """Uniform double in [0, 1) from the first 13 hex digits of the token."""
    head = F.substring(token(seed, *parts), 1, 13)
    return F.conv(head, 16, 10).cast("double") / F.lit(float(16**13))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
