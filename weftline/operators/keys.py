"""Key columns as one value: null equals null in joins on it, and no key's name meets one that an operator uses itself."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY = "_k"


def key_of(names: Iterable[str]) -> Column:
    """The columns as the struct ``_k``; without columns all rows have the same one."""
    names = list(names)
    return (F.struct(*[F.col(f"`{n}`").alias(n) for n in names]) if names else F.struct(F.lit(0).alias("all"))).alias(KEY)


def columns_of(names: Iterable[str]) -> list[Column]:
    """The columns again."""
    return [F.col(KEY).getField(n).alias(n) for n in names]


def refuse(names: Iterable[str], taken: Iterable[str]) -> None:
    """An error for key columns that are named like columns of the result."""
    both = sorted({n.lower() for n in names} & {t.lower() for t in taken})
    if both:
        raise ValueError(f"key columns named like columns of the result: {', '.join(both)}")
