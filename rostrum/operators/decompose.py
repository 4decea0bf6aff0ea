"""Exact decompositions of changes. `weight` names a column of row weights (bootstrap draws); without it rows count once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _weight(weight: str | None) -> Column:
    return F.col(weight).cast("double") if weight else F.lit(1.0)


def _listed(value) -> list:
    return list(value) if isinstance(value, (list, tuple, set, range)) else [value]


def share_mean_change(df: DataFrame, value: str, block: str, period: str, base, compare, by: list[str], weight: str | None = None) -> DataFrame:
    """Change of a group's mean between two periods (values or lists of them), by block: agenda (shares) and positions (means).

    Two-factor Shapley values. A block's agenda part is measured from the group's own mean, averaged
    over both periods; a block without rows in a period is taken to lie there. Over all blocks,
    agenda + positions is the whole change.
    """
    sets = _listed(base), _listed(compare)
    rows = df.filter(F.col(value).isNotNull() & F.col(block).isNotNull() & F.col(period).isin(sets[0] + sets[1]))
    w = _weight(weight)
    cells = rows.groupBy(*by, block).agg(
        *[F.coalesce(F.sum(F.when(F.col(period).isin(p), w)), F.lit(0.0)).alias(f"__n{i}") for i, p in enumerate(sets)],
        *[F.coalesce(F.sum(F.when(F.col(period).isin(p), w * F.col(value))), F.lit(0.0)).alias(f"__s{i}") for i, p in enumerate(sets)],
    )
    totals = cells.groupBy(*by).agg(*[F.sum(f"__{c}{i}").alias(f"__t{c}{i}") for c in "ns" for i in (0, 1)])
    joined = cells.join(totals, by) if by else cells.crossJoin(totals)  # one row
    centre = (F.try_divide("__ts0", "__tn0") + F.try_divide("__ts1", "__tn1")) / 2
    share = [F.try_divide(f"__n{i}", f"__tn{i}") for i in (0, 1)]
    mean = [F.coalesce(F.try_divide(f"__s{i}", f"__n{i}"), centre) for i in (0, 1)]
    agenda = ((mean[0] + mean[1]) / 2 - centre) * (share[1] - share[0])
    positions = (share[0] + share[1]) / 2 * (mean[1] - mean[0])
    return joined.select(*by, block, agenda.alias("agenda"), positions.alias("positions"), (agenda + positions).alias("total"))


def gap_change(df: DataFrame, value: str, block: str, period: str, base, compare, side: str, high: str, low: str, by: list[str], weight: str | None = None) -> DataFrame:
    """Change of the gap high - low, long: (by, component, block, value); block `all` has the sums, component `total` the whole change."""
    parts = share_mean_change(df.filter(F.col(side).isin(high, low)), value, block, period, base, compare, [*by, side], weight)
    sign = F.when(F.col(side) == high, 1.0).otherwise(-1.0)
    own = parts.groupBy(*by, F.col(block).cast("string").alias("block")).agg(*[F.sum(sign * F.col(c)).alias(c) for c in ("positions", "agenda")])
    whole = own.groupBy(*by).agg(F.lit("all").alias("block"), *[F.sum(c).alias(c) for c in ("positions", "agenda")])
    total = whole.select(*by, F.lit("total").alias("component"), "block", (F.col("positions") + F.col("agenda")).alias("value"))
    return own.unionByName(whole).unpivot([*by, "block"], ["positions", "agenda"], "component", "value").select(*by, "component", "block", "value").unionByName(total)


def step_changes(df: DataFrame, value: str, block: str, period: str, steps: list[tuple], side: str, high: str, low: str, by: list[str], weight: str | None = None) -> DataFrame:
    """gap_change of each (name, base, compare), stacked with the column `step`."""
    out = None
    for name, base, compare in steps:
        one = gap_change(df, value, block, period, base, compare, side, high, low, by, weight).withColumn("step", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def classify_turnover(df: DataFrame, unit: str, period: str, membership: DataFrame, place: list[str]) -> DataFrame:
    """`as_earlier` (stayer or exit) and `as_later` (stayer or entrant) of each row; rows without a unit are unmatched.

    A unit stays if `membership` (unit, period, place columns) has it in the same place in the next
    (before: in the last) period, whether or not it has rows there.
    """
    served = membership.select(unit, period, *place).filter(F.col(unit).isNotNull()).distinct()
    key = [unit, period, *place]
    after = served.withColumn(period, F.col(period) - 1).withColumn("__after", F.lit(True))
    before = served.withColumn(period, F.col(period) + 1).withColumn("__before", F.lit(True))
    joined = df.join(after, key, "left").join(before, key, "left")
    role = lambda found, name: F.when(F.col(unit).isNull(), "unmatched").when(found, "stayer").otherwise(name)
    return joined.withColumn("as_earlier", role(F.col("__after"), "exit")).withColumn("as_later", role(F.col("__before"), "entrant")).drop("__after", "__before")


def turnover(df: DataFrame, unit: str, period: str, value: str, by: list[str], membership: DataFrame | None = None, place: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Per step to the next period: change of the mean = within (stayers) + entry + exit + unmatched (rows without a unit).

    within: stayers' change; entry: how far entrants move the later mean from the stayers'; exit: how
    far leavers moved the earlier one. `membership` says who is there in which period and `place`
    (some of `by`); without it a unit is where it has rows. A step without stayers on a side has null parts.
    """
    rows = df.filter(F.col(value).isNotNull())
    w = _weight(weight)
    units = rows.groupBy(*by, period, unit).agg(F.sum(w).alias("__n"), F.sum(w * F.col(value)).alias("__s"))
    roles = classify_turnover(units, unit, period, units if membership is None else membership, by if membership is None else place or [])
    pick = lambda role, kind, c: F.sum(F.when(F.col(role) == kind, F.col(c)).otherwise(0.0))
    kinds = {"as_earlier": ("stayer", "exit", "unmatched"), "as_later": ("stayer", "entrant", "unmatched")}
    early, late = (roles.groupBy(*by, period).agg(*[pick(role, k, c).alias(f"{c}_{role[3]}_{k}") for k in kinds[role] for c in ("__n", "__s")], *[F.count_if(F.col(role) == k).alias(f"__c_{role[3]}_{k}") for k in kinds[role]]) for role in kinds)
    both = early.join(late.withColumn(period, F.col(period) - 1), [*by, period])
    n = lambda side, kind: F.col(f"__n_{side}_{kind}")
    s = lambda side, kind: F.col(f"__s_{side}_{kind}")
    total = {"e": n("e", "stayer") + n("e", "exit") + n("e", "unmatched"), "l": n("l", "stayer") + n("l", "entrant") + n("l", "unmatched")}
    mean = {"e": (s("e", "stayer") + s("e", "exit") + s("e", "unmatched")) / total["e"], "l": (s("l", "stayer") + s("l", "entrant") + s("l", "unmatched")) / total["l"]}
    stay = {x: F.try_divide(s(x, "stayer"), n(x, "stayer")) for x in "el"}
    part = lambda x, kind: F.when(n(x, kind) == 0, F.when(stay[x].isNotNull(), 0.0)).otherwise((s(x, kind) - n(x, kind) * stay[x]) / total[x])
    return both.filter((total["e"] > 0) & (total["l"] > 0)).select(
        *by, period, F.col("__c_e_stayer").alias("stayers"), F.col("__c_e_exit").alias("exits"), F.col("__c_l_entrant").alias("entrants"),
        (mean["l"] - mean["e"]).alias("change"), (stay["l"] - stay["e"]).alias("within"), part("l", "entrant").alias("entry"), (-part("e", "exit")).alias("exit"),
        (part("l", "unmatched") - part("e", "unmatched")).alias("unmatched"),
    )


def windowed_turnover(steps: DataFrame, period: str, windows: dict[str, tuple], by: list[str]) -> DataFrame:
    """Sums of the steps' parts over named ranges of periods (ends included), long: (by, window, part, value, n_steps)."""
    spark = steps.sparkSession
    table = spark.createDataFrame([(name, int(a), int(b)) for name, (a, b) in windows.items()], "window string, __a long, __b long")
    parts = ["change", "within", "entry", "exit", "unmatched"]
    joined = steps.join(F.broadcast(table), F.col(period).between(F.col("__a"), F.col("__b")))
    sums = joined.groupBy(*by, "window").agg(F.count(F.lit(1)).alias("n_steps"), *[complete_sum(p).alias(p) for p in parts])
    return sums.unpivot([*by, "window", "n_steps"], parts, "part", "value")


def complete_sum(column: str) -> Column:
    """A sum that is null if any summand is."""
    return F.when(F.count_if(F.col(column).isNull()) == 0, F.sum(column))


def stayers_without_rows(df: DataFrame, unit: str, period: str, membership: DataFrame, place: list[str]) -> DataFrame:
    """Per period and place: units in both it and the next, and how many of them lack rows before or after."""
    served = membership.select(unit, period, *place).filter(F.col(unit).isNotNull()).distinct()
    key = [unit, period, *place]
    stay = served.join(served.withColumn(period, F.col(period) - 1), key, "left_semi")
    have = df.filter(F.col(unit).isNotNull()).select(*key).distinct()
    out = stay.join(have.withColumn("__0", F.lit(True)), key, "left").join(have.withColumn(period, F.col(period) - 1).withColumn("__1", F.lit(True)), key, "left")
    return out.groupBy(period, *place).agg(F.count(F.lit(1)).alias("stayers"), F.count_if(F.col("__0").isNull()).alias("silent_before"), F.count_if(F.col("__1").isNull()).alias("silent_after"), F.count_if(F.col("__0").isNull() & F.col("__1").isNull()).alias("silent_both"))


def overlap(df: DataFrame, value: str, side: str, a: str, b: str, by: list[str], weight: str | None = None) -> DataFrame:
    """Shared mass of two sides' distributions (values rounded to 6), a's share above b's median and b's share below a's.

    Comparisons are strict and keep their direction whichever median is larger; a missing side gives null.
    """
    w = F.col(weight).cast("long") if weight else F.lit(1)
    rows = df.filter(F.col(value).isNotNull() & F.col(side).isin(a, b)).select(*by, F.col(side).alias("__side"), F.col(value).alias("__v"), w.alias("__w"))
    own = {n: F.coalesce(F.sum(F.when(F.col("__side") == s, F.col("__w"))), F.lit(0)) for n, s in (("a", a), ("b", b))}
    counts = rows.groupBy(*by, "__v").agg(own["a"].alias("__na"), own["b"].alias("__nb"))
    totals = counts.groupBy(*by).agg(
        F.sum("__na").alias("__ta"), F.sum("__nb").alias("__tb"),
        F.percentile("__v", F.lit(0.5), F.col("__na")).alias("median_a"), F.percentile("__v", F.lit(0.5), F.col("__nb")).alias("median_b"),
    )
    joined = counts.join(totals, by) if by else counts.crossJoin(totals)  # one row
    grid = joined.groupBy(*by, F.round("__v", 6).alias("__v")).agg(
        *[F.sum(c).alias(c) for c in ("__na", "__nb")], *[F.first(c).alias(c) for c in ("__ta", "__tb", "median_a", "median_b")],
        F.sum(F.when(F.col("__v") > F.col("median_b"), F.col("__na")).otherwise(0)).alias("__xa"), F.sum(F.when(F.col("__v") < F.col("median_a"), F.col("__nb")).otherwise(0)).alias("__xb"),
    )
    both = (F.first("__ta") > 0) & (F.first("__tb") > 0)
    return grid.groupBy(*by).agg(
        F.when(both, F.sum(F.least(F.try_divide("__na", "__ta"), F.try_divide("__nb", "__tb")))).alias("overlap"),
        F.when(both, F.sum("__xa") / F.first("__ta")).alias("beyond_a"), F.when(both, F.sum("__xb") / F.first("__tb")).alias("beyond_b"), F.first("median_a").alias("median_a"), F.first("median_b").alias("median_b"),
    )
