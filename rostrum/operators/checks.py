"""Integrity checks that stop instead of guessing. Each returns its input, so checks chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class IntegrityError(ValueError):
    """Data break a rule; the message names up to ten cases."""


def _stop(bad: DataFrame, what: str) -> None:
    cases = bad.limit(10).collect()
    if cases:
        raise IntegrityError(f"{what}: {[tuple(r) for r in cases]}")


def assert_unique(df: DataFrame, key: list[str]) -> DataFrame:
    _stop(df.groupBy(*key).count().filter("count > 1"), f"repeated {key}")
    return df


def assert_no_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first().asDict()
    if any(counts.values()):
        raise IntegrityError(f"nulls: {({c: n for c, n in counts.items() if n})}")
    return df


def assert_domain(df: DataFrame, column: str, allowed: list) -> DataFrame:
    _stop(df.filter(F.col(column).isNotNull() & ~F.col(column).isin(allowed)).groupBy(column).count(), f"{column} outside its domain")
    return df


def missing_in_range(df: DataFrame, column: str) -> DataFrame:
    """Whole numbers between the smallest and the largest value that do not occur."""
    low, high = df.agg(F.min(column), F.max(column)).first()  # two numbers
    kind = dict(df.dtypes)[column]
    every = df.sparkSession.range(0 if low is None else int(low), 0 if high is None else int(high) + 1).select(F.col("id").cast(kind).alias(column))
    return every.join(df.select(column).distinct(), column, "left_anti")


def assert_dense(df: DataFrame, column: str) -> DataFrame:
    _stop(missing_in_range(df, column), f"gaps in {column}")
    return df


def assert_schema(df: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    if df.dtypes != fields:
        raise IntegrityError(f"schema {df.dtypes} is not {fields}")
    return df


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", one_to_one: bool = False, complete: bool = False) -> DataFrame:
    """Join many-to-one (or one-to-one) after checking keys; `complete` also stops on left rows without a match."""
    assert_unique(right, on)
    if one_to_one:
        assert_unique(left, on)
    if complete:
        _stop(left.join(right.select(*on), on, "left_anti").select(*on).distinct(), "no match")
    return left.join(right, on, how)


def tables_differ(old: DataFrame, new: DataFrame, key: list[str], rtol: float = 1e-12, atol: float = 1e-15) -> DataFrame:
    """Keys of rows that are absent on one side or differ: numbers beyond the tolerance, other columns at all."""
    kinds = dict(old.dtypes)
    names = [c for c in old.columns if c not in key]
    both = old.select(*key, F.struct(*names).alias("a")).join(new.select(*key, F.struct(*names).alias("b")), key, "full_outer")
    differs = F.col("a").isNull() | F.col("b").isNull()
    for c in names:
        a, b = F.col("a")[c], F.col("b")[c]
        far = F.abs(a - b) > atol + rtol * F.abs(b) if kinds[c] in ("double", "float") else F.lit(True)
        differs = differs | (~a.eqNullSafe(b) & F.coalesce(far, F.lit(True)))
    return both.filter(differs).select(*key)
