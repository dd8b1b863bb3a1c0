"""Seeded hashing: every random choice in the library is a pure function of (seed, keys).

Results therefore do not depend on partitioning, task retries or executor loss, and the
same numbers can be produced in any SQL engine that has ``md5`` and 64-bit integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Mersenne prime; x -> x**5 is a bijection on its residues because gcd(5, P - 1) = 1.
PRIME = 2147483647
_A, _B, _C = 48271, 16807, 11
_SPAN = float(1 << 60)


def hash60(*parts: Column | str | int) -> Column:
    """60-bit non-negative hash of the parts joined by ``|``."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def uniform(*parts: Column | str | int) -> Column:
    """Uniform double in [0, 1)."""
    return hash60(*parts).cast("double") / F.lit(_SPAN)


def hash31(*parts: Column | str | int) -> Column:
    """Hash reduced to a residue of ``PRIME``; the key of :func:`draws`."""
    return hash60(*parts) % F.lit(PRIME)


def key31(*parts: object) -> int:
    """:func:`hash31` inside a Python task."""
    text = "|".join(str(p) for p in parts)
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % PRIME


def _quintic(x):
    square = x * x % PRIME
    return square * square % PRIME * x % PRIME


def mix31(key: int, counter: np.ndarray) -> np.ndarray:
    """Vectorised counter hash: one residue of ``PRIME`` per counter value.

    All products stay below 2**62, so numpy, Spark and SQL 64-bit integers agree exactly.
    """
    x = _quintic((int(key) * _A + counter.astype(np.int64) * _B + _C) % PRIME)
    return _quintic((x + int(key) + 1) % PRIME)


def mix31_sql(key: str, counter: str) -> str:
    """The same hash as a SQL expression over 64-bit integer columns."""

    def quintic(x: str) -> str:
        return f"((({x})*({x}) % {PRIME}) * (({x})*({x}) % {PRIME}) % {PRIME} * ({x}) % {PRIME})"

    first = quintic(f"(({key})*{_A} + ({counter})*{_B} + {_C}) % {PRIME}")
    return quintic(f"({first} + ({key}) + 1) % {PRIME}")
