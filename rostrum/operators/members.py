"""Members over sessions: service, background, exits, trajectories, trends and the cells they identify."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .checks import IntegrityError
from .estimates import known


def person_key(bioguide: Column, number: Column) -> Column:
    """One name for a person: the biographical id where there is one, else `icpsr:` and the number."""
    return F.coalesce(bioguide, F.concat(F.lit("icpsr:"), number.cast("string")))


def membership(members: DataFrame, state: str, outside: list[str], codes: dict[int, str], code: str) -> DataFrame:
    """Members of voting seats with `party` from its code; other codes are null."""
    party = F.lit(None).cast("string")
    for value, name in codes.items():
        party = F.when(F.col(code) == value, name).otherwise(party)
    return members.filter(~F.coalesce(F.col(state).isin(outside), F.lit(False))).withColumn("party", party)


def background(members: DataFrame, unit: str, session: str, born: str) -> DataFrame:
    """(unit, session, born, tenure, first_session): the first known birth year, sessions served so far, and the first one.

    A unit that sits twice in a session (two chambers) counts it once.
    """
    once = members.filter(F.col(unit).isNotNull()).groupBy(unit, session).agg(F.min(born).alias("__b"))
    own = Window.partitionBy(unit)
    ordered = own.orderBy(session)
    first = F.first("__b", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return once.select(unit, session, first.alias(born), F.row_number().over(ordered).alias("tenure"), F.min(session).over(own).alias("first_session"))


def leaves_next(units: DataFrame, served: DataFrame, unit: str, session: str, place: list[str], last) -> DataFrame:
    """`left`: the unit does not sit in the same place in the next session; null in the `last` session, which has no next."""
    key = [unit, session, *place]
    after = served.select(*key).distinct().withColumn(session, F.col(session) - 1).withColumn("__after", F.lit(True))
    out = units.join(after, key, "left")
    return out.withColumn("left", F.when((F.col(session) < last) & F.col(unit).isNotNull(), F.col("__after").isNull())).drop("__after")


def last_session_flag(rows: DataFrame, service: DataFrame, person: str, session: str, last) -> DataFrame:
    """`last_session`: nobody of that person serves anywhere in the next session; null where that cannot be known."""
    return leaves_next(rows, service, person, session, [], last).withColumnRenamed("left", "last_session")


def prior_service(members: DataFrame, unit: str, person: str, session: str) -> DataFrame:
    """Units whose person served before the unit's own first session (a new number for an old member)."""
    firsts = members.filter(F.col(person).isNotNull()).groupBy(person, unit).agg(F.min(session).alias("unit_first"))
    people = firsts.groupBy(person).agg(F.min("unit_first").alias("person_first"))
    return firsts.join(people, person).filter("person_first < unit_first").select(unit, person, "unit_first", "person_first")


def toward(value: Column, side: Column, plus: str) -> Column:
    """The value seen from its own side: the sign turns for the other one."""
    return F.when(side == plus, value).otherwise(-value)


def two_by_two(a: Column, yes_a: str, no_a: str, b: Column, yes_b: str, no_b: str) -> Column:
    """Label of a row in a 2 x 2 table; null if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.concat_ws(", ", F.when(a, yes_a).otherwise(no_a), F.when(b, yes_b).otherwise(no_b)))


def add_dimension(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Left join with a small table that must have each key once and know every key of the rows."""
    from .checks import join_checked

    return join_checked(rows, table, on, "left", complete=True)


def trajectories(rows: DataFrame, unit: str, side: str, session: str, value: str, bench: str, names: list[str], minimum: int) -> DataFrame:
    """Per unit and session with `minimum` rows: n, mean, sd, benchmark mean, named attributes, and the side's mean of that session."""
    data = known(rows, [unit, side, session], [value])
    own = data.groupBy(unit, side, session).agg(*[F.min(c).alias(c) for c in names], F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.avg(bench).alias("bench"))
    sides = data.groupBy(side, session).agg(F.avg(value).alias("side_mean"))
    return own.filter(F.col("n") >= minimum).join(sides, [side, session])


def hc1_slope(rows: DataFrame, x: str, y: str, by: list[str], name: str) -> DataFrame:
    """(by, <name>, <name>_se, n): least-squares slope with the heteroscedasticity-consistent error HC1; null below three rows."""
    ok = known(rows, by, [x, y])
    xx, yy = F.col(x).cast("double"), F.col(y).cast("double")
    fit = ok.groupBy(*by).agg(F.avg(xx).alias("__mx"), F.avg(yy).alias("__my"), F.count(F.lit(1)).alias("__n"), F.regr_slope(yy, xx).alias("__b"), F.regr_sxx(yy, xx).alias("__sxx"))
    joined = ok.join(fit, by) if by else ok.crossJoin(fit)  # one row
    dx = xx - F.col("__mx")
    e = yy - F.col("__my") - F.col("__b") * dx
    meat = joined.groupBy(*by).agg(F.first("__b").alias(name), F.first("__n").alias("n"), F.first("__sxx").alias("__sxx"), F.sum(dx * dx * e * e).alias("__meat"))
    se = F.when(F.col("n") > 2, F.sqrt(F.try_divide(F.col("n"), F.col("n") - 2) * F.col("__meat")) / F.col("__sxx"))
    return meat.select(*by, F.when(F.col("n") > 2, F.col(name)).alias(name), se.alias(f"{name}_se"), "n")


def member_trends(rows: DataFrame, unit: str, side: str, session: str, value: str, bench: str, minimum: int, sessions: int) -> DataFrame:
    """Slopes over sessions of a unit's mean, of its distance to its side's mean, and of the benchmark, for units with enough sessions."""
    cells = trajectories(rows, unit, side, session, value, bench, [], minimum).withColumn("__rel", F.col("mean") - F.col("side_mean"))
    enough = cells.groupBy(unit, side).agg(F.count(F.lit(1)).alias("__k")).filter(F.col("__k") >= sessions).select(unit, side)
    cells = cells.join(enough, [unit, side], "left_semi")
    by = [unit, side]
    slope = hc1_slope(cells, session, "mean", by, "slope").withColumnRenamed("n", "n_sessions")
    relative = hc1_slope(cells, session, "__rel", by, "relative_slope").drop("n")
    return slope.join(relative, by).join(hc1_slope(cells, session, "bench", by, "bench_slope").drop("n", "bench_slope_se"), by, "left")


def identifying(rows: DataFrame, unit: str, terms: list[str], by: list[str]) -> DataFrame:
    """Per group and term: units for which the term takes more than one value, and all units."""
    own = rows.groupBy(*by, unit).agg(*[(F.min(t) < F.max(t)).alias(t) for t in terms])
    return own.groupBy(*by).agg(F.count(F.lit(1)).alias("units"), *[F.count_if(F.col(t)).alias(f"varying_{t}") for t in terms])


def in_both(rows: DataFrame, unit: str, period: str, by: list[str]) -> DataFrame:
    """(by, units): units with rows in more than one period."""
    return rows.groupBy(*by, unit).agg((F.min(period) < F.max(period)).alias("__both")).groupBy(*by).agg(F.count_if("__both").alias("units"))


def ladder_cells(rows: DataFrame, by: list[str], unit: str, session: str, least_rows: int, least_units: int) -> DataFrame:
    """Size of each cell: rows, units, the sessions in order as text, and whether it is too small."""
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(unit).alias("units"), F.array_join(F.transform(F.array_sort(F.collect_set(session)), lambda s: s.cast("string")), ", ").alias("sessions"))
    return out.withColumn("small", (F.col("n") < least_rows) | (F.col("units") < least_units))


def spread(units: DataFrame, value: str, flags: list[str], by: list[str]) -> DataFrame:
    """Units, deviation of the value and shares of each flag, by group."""
    return units.groupBy(*by).agg(F.count(F.lit(1)).alias("units"), F.stddev_samp(value).alias("sd"), *[F.avg(F.col(f).cast("int")).alias(f) for f in flags])


def band_shares(units: DataFrame, value: str, bands: list[float], by: list[str]) -> DataFrame:
    """Share of units with |value| below each band, long: (by, band, share, units)."""
    one = units.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("units"), *[F.avg((F.abs(value) < b).cast("int")).alias(str(b)) for b in bands])
    return one.unpivot([*by, "units"], [F.col(f"`{b}`") for b in bands], "band", "share")


def cohort(rows: DataFrame, first: str, session: str) -> DataFrame:
    """Rows of units in their first session."""
    return rows.filter(F.col(first) == F.col(session))


def new_against_continuing(rows: DataFrame, value: str, first: str, session: str, cell: list[str], by: list[str], cluster: str) -> DataFrame:
    """Difference of new and continuing units within cells that hold both, clustered."""
    from .estimates import within_cell_ols

    marked = rows.withColumn("new", (F.col(first) == F.col(session)).cast("double"))
    both = marked.groupBy(*cell).agg(F.min("new").alias("__lo"), F.max("new").alias("__hi")).filter("__lo < __hi").select(*cell)
    return within_cell_ols(marked.join(both, cell, "left_semi"), value, ["new"], cell, by, cluster)


def term_labels(terms: DataFrame, name: str, session: str) -> DataFrame:
    """(session, term): label `name first-last` of each run of consecutive sessions of the same name."""
    from .windows import islands

    runs = islands(terms.withColumn("__one", F.lit(1)), ["__one"], session, name)
    label = F.concat_ws(" ", F.col(name), F.concat_ws("-", F.col("first"), F.col("last")))
    return runs.select(F.explode(F.sequence("first", "last")).alias(session), label.alias("term"))


def pair_labels(terms: DataFrame, name: str, session: str) -> DataFrame:
    """(pair, name): one name for each pair of sessions (odd, even); a pair with two names stops."""
    pairs = terms.groupBy(F.floor((F.col(session) + 1) / 2).alias("pair")).agg(F.min(name).alias(name), F.max(name).alias("__other"))
    bad = pairs.filter(F.col(name) != F.col("__other")).limit(10).collect()
    if bad:
        raise IntegrityError(f"pairs with two names: {[tuple(r) for r in bad]}")
    return pairs.drop("__other")


def dense_id(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """`name`: the place, from 0, of a row's key among all keys in order, and `size`: rows of that key.

    Only the table of keys is ordered: pieces of it by range, then moved by the pieces' sizes.
    """
    from ..session import written

    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = written(sizes.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)), "dense-keys")
    pieces = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    moved = pieces.select("__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__move"))
    table = placed.join(F.broadcast(moved), "__part").select(*keys, "size", (F.col("__at") + F.col("__move")).alias(name))
    same = [rows[k].eqNullSafe(table[k]) for k in keys]
    return rows.join(table, same).select(*[rows[c] for c in rows.columns], "size", name)


def selection(kept: DataFrame, population: DataFrame, by: list[str], unit: str, thresholds: list[int]) -> DataFrame:
    """Per group and threshold: units of the population, those with so many rows, and their share."""
    counts = kept.groupBy(*by, unit).agg(F.count(F.lit(1)).alias("__n"))
    joined = population.select(*by, unit).distinct().join(counts, [*by, unit], "left")
    spread_ = joined.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    out = spread_.groupBy(*by, "threshold").agg(F.count(F.lit(1)).alias("population"), F.count_if(F.coalesce("__n", F.lit(0)) >= F.col("threshold")).alias("kept"))
    return out.withColumn("share", F.col("kept") / F.col("population"))
