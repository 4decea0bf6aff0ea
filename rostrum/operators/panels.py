"""Panel tables: shares, margins, completed grids, party votes and drop accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shares(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Counts of `column` within groups and their share of the group."""
    counts = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two-way counts with row, column and grand totals; `all` marks a margin, null values are `none`."""
    rows = df.select(F.coalesce(F.col(a).cast("string"), F.lit("none")).alias("a"), F.coalesce(F.col(b).cast("string"), F.lit("none")).alias("b"))
    cube = rows.cube("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return cube.select(F.coalesce("a", F.lit("all")).alias("a"), F.coalesce("b", F.lit("all")).alias("b"), "n")


def complete_cells(df: DataFrame, keys: list[str], minimum: int, unit: str) -> DataFrame:
    """Size and distinct units of every combination of key values, zero where empty, with `below_min`."""
    grid = None
    for k in keys:
        values = df.select(k).filter(F.col(k).isNotNull()).distinct()
        grid = values if grid is None else grid.crossJoin(values)  # key values are few
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(unit).alias("units"))
    out = grid.join(counts, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("units", F.lit(0)).alias("units"))
    return out.withColumn("below_min", F.col("n") < minimum)


def party_votes(votes: DataFrame, roll: str, party: str, yea: Column, nay: Column, sides: tuple[str, str]) -> DataFrame:
    """Per roll call: each side's yeas and nays, whether majorities oppose (unity), agree (bipartisan) or tie."""
    pick = lambda c, s: F.sum(F.when(F.col(party) == s, c.cast("int")).otherwise(0))
    out = votes.groupBy(roll).agg(*[pick(c, s).alias(f"{n}_{i}") for i, s in enumerate(sides) for c, n in ((yea, "yea"), (nay, "nay"))])
    lean = [F.signum(F.col(f"yea_{i}") - F.col(f"nay_{i}")) for i in (0, 1)]
    return out.withColumn("party_unity", lean[0] * lean[1] < 0).withColumn("bipartisan", lean[0] * lean[1] > 0).withColumn("no_majority", lean[0] * lean[1] == 0)


def nearest_side(units: DataFrame, value: str, side: str, sides: tuple[str, str], by: list[str]) -> DataFrame:
    """Units with their own and the opposite side's median, and whether they are closer to the other."""
    medians = units.groupBy(*by).agg(*[F.percentile(F.when(F.col(side) == s, F.col(value)), F.lit(0.5)).alias(f"__{i}") for i, s in enumerate(sides)])
    joined = units.filter(F.col(side).isin(*sides)).join(medians, by)
    own, other = F.when(F.col(side) == sides[0], F.col("__0")).otherwise(F.col("__1")), F.when(F.col(side) == sides[0], F.col("__1")).otherwise(F.col("__0"))
    out = joined.withColumn("own_median", own).withColumn("other_median", other).drop("__0", "__1")
    return out.withColumn("closer_to_other", F.abs(F.col(value) - F.col("other_median")) < F.abs(F.col(value) - F.col("own_median")))


def drop_reasons(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """`drop_reason`: the first rule that a row breaks, null for rows that stay."""
    reason = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        reason = F.when(F.coalesce(broken, F.lit(True)), name).otherwise(reason)
    return df.withColumn("drop_reason", reason)


def unit_table(df: DataFrame, unit: list[str], values: list[str], cell: list[str], minimum: int) -> DataFrame:
    """Means by unit of values and of values less their cell mean, for units with `minimum` rows."""
    from .estimates import demeaned, known

    rows = known(df, [*unit, *cell], values).withColumns({f"{v}_rel": F.col(v).cast("double") for v in values})
    rows = demeaned(rows, [f"{v}_rel" for v in values], cell)
    means = rows.groupBy(*unit).agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(v) for v in values], *[F.avg(f"{v}_rel").alias(f"{v}_rel") for v in values])
    return means.filter(F.col("n") >= minimum)
