"""Ordered and time-aware operators: as-of and interval lookups, event windows, islands, bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(rows: DataFrame, periods: DataFrame, on: list[str], at: str, start: str, value: str) -> DataFrame:
    """`rows` with `value` of the last period that starts at or before `at`, else of the first period.

    Each key's periods are gathered as one sorted array (a key has few), so rows are neither
    multiplied nor sorted. `periods` must have the columns `on`, `start` and `value`.
    """
    own = periods.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), F.col(value).alias("v")))).alias("__p"))
    past = F.filter("__p", lambda p: p["s"] <= F.col(at))
    found = F.when(F.size(past) > 0, F.element_at(past, -1)).otherwise(F.try_element_at("__p", F.lit(1)))
    return rows.join(own, on, "left").withColumn(value, found["v"]).drop("__p")


def interval_join(rows: DataFrame, spans: DataFrame, on: list[str], at: str, start: str, end: str) -> DataFrame:
    """Rows with each span of the same key that contains `at` (ends included): an equi-join, then a filter."""
    return rows.join(spans, on).filter((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end)))


def last_before(rows: DataFrame, history: DataFrame, on: list[str], at: str, time: str, n: int, values: list[str]) -> DataFrame:
    """Mean of `values` over the last n history rows of the key before `at`, for each distinct (key, at) that has any.

    History rows are numbered once in time, and each question counts those before it; the join is
    on (key, number), so a key's whole history never meets its questions. Ties in `time` are broken by the values.
    """
    asked = rows.select(*on, F.col(at).alias("__t")).distinct().withColumn("__h", F.lit(0))
    told = history.select(*on, F.col(time).alias("__t"), F.lit(1).alias("__h"))
    before = Window.partitionBy(*on).orderBy("__t", "__h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = asked.unionByName(told).withColumn("__c", F.sum("__h").over(before)).filter("__h = 0 and __c > 0")
    wanted = counted.withColumn("__i", F.explode(F.sequence(F.greatest(F.col("__c") - n + 1, F.lit(1).cast("long")), F.col("__c"))))
    place = F.row_number().over(Window.partitionBy(*on).orderBy(time, *values)).cast("long")
    numbered = history.select(*on, *dict.fromkeys([time, *values])).withColumn("__i", place).select(*on, "__i", *[F.col(v).alias(f"__v_{v}") for v in values])
    return wanted.join(numbered, [*on, "__i"]).groupBy(*on, F.col("__t").alias(at)).agg(F.count(F.lit(1)).alias("n_before"), *[F.avg(f"__v_{v}").alias(f"mean_{v}") for v in values])


def event_periods(rows: DataFrame, events: DataFrame, at: str, day: str, half_width: int, name: str) -> DataFrame:
    """Rows in [day - w, day + w) of each event, with `period` (before or after); rows may meet several events.

    Events are bucketed by spans of 2w days, so the join is an equi-join on the bucket.
    """
    width = 2 * half_width
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / width)
    spread = events.withColumn("__b", F.explode(F.array_distinct(F.array(bucket(F.date_sub(day, half_width)), bucket(F.date_add(day, half_width - 1))))))
    tagged = rows.withColumn("__b", bucket(F.col(at)))
    joined = tagged.join(spread.select(name, day, "__b"), "__b").drop("__b")
    inside = (F.col(at) >= F.date_sub(day, half_width)) & (F.col(at) < F.date_add(day, half_width))
    return joined.filter(inside).withColumn("period", F.when(F.col(at) < F.col(day), "before").otherwise("after"))


def last_days_before(days: DataFrame, boundary: DataFrame, by: list[str], day: str, edge: str, n: str) -> DataFrame:
    """The last n (a column of `boundary`) distinct days before `edge`, by group."""
    order = Window.partitionBy(*by).orderBy(F.desc(day))
    earlier = days.select(*by, day).distinct().join(boundary, by).filter(F.col(day) < F.col(edge))
    return earlier.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= F.col(n))


def islands(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal values in order: one row (by, value, run, first, last, length) for each run."""
    w = Window.partitionBy(*by).orderBy(order)
    change = F.coalesce((~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("int"), F.lit(1))
    runs = df.withColumn("__c", F.when(F.row_number().over(w) == 1, 1).otherwise(change))
    runs = runs.withColumn("run", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, value, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("length"))


def adjacent_changes(df: DataFrame, by: list[str], order: str, values: list[str], gap: int = 1) -> DataFrame:
    """Changes of values from the row exactly `gap` before in the order."""
    w = Window.partitionBy(*by).orderBy(order)
    out = df.withColumn("__before", F.lag(order).over(w)).withColumns({f"change_{v}": F.col(v) - F.lag(v).over(w) for v in values})
    return out.filter(F.col(order) - F.col("__before") == gap).drop("__before")


def tercile_by_order(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """ceil(3 * place / size): unlike ntile, the last groups are the larger ones."""
    place, size = F.row_number().over(Window.partitionBy(*by).orderBy(*order)), F.count(F.lit(1)).over(Window.partitionBy(*by))
    return df.withColumn("tercile", F.ceil(3.0 * place / size).cast("int"))


def quantile_bins(df: DataFrame, value: str, by: list[str], bins: int) -> DataFrame:
    """Equal-frequency bins by interpolated quantiles, closed on the right."""
    edges = df.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("__e"))
    joined = df.join(edges, by) if by else df.crossJoin(F.broadcast(edges))
    return joined.withColumn("bin", F.size(F.filter("__e", lambda e: e < F.col(value))) + 1).drop("__e")


def running_place(df: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    """1, 2, 3 ... within a group (tenure)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(order)))


def first_of(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def effective_rows(attempts: DataFrame, key: list[str], ok: str, order: str) -> DataFrame:
    """The first successful attempt of each key, else its last attempt."""
    good = F.coalesce(F.col(ok), F.lit(False))
    return first_of(attempts, key, [F.desc(good), F.when(good, F.col(order)).asc_nulls_last(), F.desc(order)])
