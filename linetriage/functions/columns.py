"""Column expressions shared by the operators; all stay inside JVM code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b as DOUBLE, null where b is 0 (an undefined metric is null, never 0)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(ratio(a, b), F.lit(0.0))


def sigmoid(z: Column) -> Column:
    """Logistic function that does not overflow for either sign of z."""
    return F.when(z >= 0, 1.0 / (1.0 + F.exp(-z))).otherwise(F.exp(z) / (1.0 + F.exp(z)))


def finite(x: Column) -> Column:
    """True when x is neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def hash_text(seed: object, *keys: str | Column) -> Column:
    """Seeded order key: md5 text, the same in any engine that has md5."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_number(text: Column, digits: int = 15, start: int = 1) -> Column:
    """Leading hex digits of a hash text as a non-negative LONG."""
    return F.conv(F.substring(text, start, digits), 16, 10).cast("long")


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def any_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for condition in conditions:
        out = out | condition
    return out


def add_up(columns: Sequence[Column]) -> Column:
    out = columns[0]
    for column in columns[1:]:
        out = out + column
    return out
