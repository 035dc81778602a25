"""The three variances: covariant ``+``, contravariant ``-``, invariant (empty), as text and as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CO, CONTRA, INV = "+", "-", ""
_FLIP = {CO: CONTRA, CONTRA: CO, INV: INV}


def flip(v: str) -> str:
    return _FLIP[v]


def times(a: str, b: str) -> str:
    """Invariant absorbs, covariant is neutral, contravariant flips."""
    if INV in (a, b):
        return INV
    return CO if a == b else CONTRA


def flip_col(v: Column) -> Column:
    return F.translate(v, "+-", "-+")


def times_col(a: Column, b: Column) -> Column:
    return F.when((a == INV) | (b == INV), F.lit(INV)).when(a == b, F.lit(CO)).otherwise(F.lit(CONTRA))
