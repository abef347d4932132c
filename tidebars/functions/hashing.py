"""Random numbers that depend only on (seed, i): the same under any partitioning, retry or engine."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def uniform(seed, i) -> Column:
    """In [0, 1): the first 32 bits of md5('seed:i')."""
    return F.conv(_bits(seed, i), 16, 10).cast("double") / 4294967296


def uniform_of(seed: str, i: int) -> float:
    """The same number inside a task."""
    return int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:8], 16) / 4294967296


def _bits(seed, i) -> Column:
    return F.substring(F.md5(F.concat(_col(seed).cast("string"), F.lit(":"), _col(i).cast("string"))), 1, 8)


def below(seed, i, p: float) -> Column:
    """Whether ``uniform(seed, i) < p``, without turning the bits into a number: eight hex digits compare like their value."""
    edge = math.ceil(p * 4294967296)
    return F.lit(True) if edge > 0xFFFFFFFF else _bits(seed, i) < F.lit(f"{edge:08x}")


def normal(seed, i) -> Column:
    """Standard normal by Box and Muller from two uniforms of the seed."""
    s = _col(seed).cast("string")
    u, v = uniform(F.concat(s, F.lit("/a")), i), uniform(F.concat(s, F.lit("/b")), i)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)
