"""Elections, majorities and the designs built on them: flips, windows after elections, constellations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .checks import IntegrityError


def outcomes(terms: DataFrame, majorities: DataFrame, elections: DataFrame) -> DataFrame:
    """(year, chamber, loser): per election and chamber the side that lost control, null where none did.

    `terms`: session, president's side; `majorities`: chamber, session, side; `elections`: year, session (the one elected).
    """
    now = majorities.select("chamber", F.col("session"), F.col("side").alias("after"))
    old = majorities.select("chamber", (F.col("session") + 1).alias("session"), F.col("side").alias("before"))
    both = elections.join(now, "session").join(old, ["chamber", "session"]).join(terms.withColumnRenamed("side", "president"), "session", "left")
    return both.select("year", "chamber", "session", "president", F.when(F.col("before") != F.col("after"), F.col("before")).alias("loser"))


def constellations(terms: DataFrame, majorities: DataFrame, house: str, senate: str) -> DataFrame:
    """(session, president, house, senate, constellation): unified, divided, or split Congress; a session without a side stops."""
    wide = majorities.groupBy("session").pivot("chamber", [house, senate]).agg(F.first("side")).withColumnsRenamed({house: "house", senate: "senate"})
    out = terms.withColumnRenamed("side", "president").join(wide, "session", "left")
    bad = out.filter("president is null or house is null or senate is null").select("session").limit(10).collect()
    if bad:
        raise IntegrityError(f"sessions without a side: {[r[0] for r in bad]}")
    kind = F.when(F.col("house") != F.col("senate"), "split").when(F.col("house") == F.col("president"), "unified").otherwise("divided")
    return out.withColumn("constellation", kind)


def power_level(president: str, chamber: str, side: str):
    """How much a member's side holds: both, White House only, chamber only, or neither."""
    white, own = F.col(president) == F.col(side), F.col(chamber) == F.col(side)
    return F.when(white & own, "both").when(white, "white_house").when(own, "chamber").when(white.isNotNull() & own.isNotNull(), "neither")


def flip_cases(table: DataFrame) -> DataFrame:
    """(before, after, chamber, loser, gainer): pairs of sessions in which exactly one chamber changes hands and the presidency does not.

    `table`: session, president, house, senate.
    """
    later = table.select((F.col("session") - 1).alias("session"), *[F.col(c).alias(f"{c}_after") for c in ("president", "house", "senate")])
    both = table.join(later, "session")
    house, senate = F.col("house") != F.col("house_after"), F.col("senate") != F.col("senate_after")
    cases = both.filter((F.col("president") == F.col("president_after")) & (house.cast("int") + senate.cast("int") == 1))
    return cases.select(
        F.col("session").alias("before"), (F.col("session") + 1).alias("after"), F.when(house, "H").otherwise("S").alias("chamber"),
        F.when(house, F.col("house")).otherwise(F.col("senate")).alias("loser"), F.when(house, F.col("house_after")).otherwise(F.col("senate_after")).alias("gainer"),
    )


def flip_rows(rows: DataFrame, cases: DataFrame, served: DataFrame, unit: str, session: str, chamber: str, side: str, same_chamber: bool = True) -> DataFrame:
    """Rows of units that serve before and after a case, once for each case, with `treated` (of the losing side) and `after`.

    Two semi-joins on service; `same_chamber` keeps only the chamber that flips.
    """
    named = cases.select(F.concat_ws("-", F.col("chamber"), F.col("before")).alias("case"), "before", "after", F.col("chamber").alias("__chamber"), "loser")
    pairs = F.explode(F.array(*[F.struct(F.col(c).alias("session"), F.lit(c == "after").alias("after")) for c in ("before", "after")])).alias("__s")
    spread = named.select("case", F.col("before").alias("__b"), F.col("after").alias("__a"), "__chamber", "loser", pairs).select("case", "__b", "__a", "__chamber", "loser", F.col("__s.session").alias(session), F.col("__s.after").alias("after"))
    joined = rows.join(F.broadcast(spread), session)
    if same_chamber:
        joined = joined.filter(F.col(chamber) == F.col("__chamber"))
    for column in ("__b", "__a"):
        own = served.select(F.col(unit), F.col(chamber), F.col(session).alias(column)).distinct()
        joined = joined.join(own, [unit, chamber, column], "left_semi")
    return joined.withColumn("treated", F.col(side) == F.col("loser")).drop("__b", "__a", "__chamber")


def election_windows(days: DataFrame, elections: DataFrame, by: list[str], day: str, edge: str, n: int) -> DataFrame:
    """(by, year, day, period): the n days with rows nearest before each election (by, year, edge) and the first n from it on."""
    joined = days.select(*by, day).distinct().join(F.broadcast(elections), by)
    period = F.when(F.col(day) < F.col(edge), "before").otherwise("after")
    order = Window.partitionBy(*by, "year", "period").orderBy(F.abs(F.datediff(F.col(day), F.col(edge))), day)
    near = joined.withColumn("period", period).withColumn("__p", F.row_number().over(order)).filter(F.col("__p") <= n)
    return near.select(*by, "year", day, "period")


def window_rows(rows: DataFrame, windows: DataFrame, by: list[str], day: str) -> DataFrame:
    """Rows on the windows' days, tagged with year and period: an equi-join on (by, day)."""
    return rows.join(windows, [*by, day])


def escalation(cells: DataFrame, value: str, period: str, role: str, by: list[str]) -> DataFrame:
    """Unweighted means of cell means per period, a column for each role; a period that lacks a role stops."""
    roles = [r[0] for r in cells.select(role).distinct().orderBy(role).collect()]  # roles are few
    wide = cells.groupBy(*by, period).pivot(role, roles).agg(F.avg(value))
    lacking = F.lit(False)
    for r in roles:
        lacking = lacking | F.col(f"`{r}`").isNull()
    bad = wide.filter(lacking).select(*by, period).limit(10).collect()
    if bad:
        raise IntegrityError(f"cells without all roles: {[tuple(r) for r in bad]}")
    return wide


def state_share(counties: DataFrame, year: str, state: str, county: str, party: str, mode: str, votes_: str, sides: tuple[str, str]) -> DataFrame:
    """(year, state, share): the second side's share of the two-party vote; a county's TOTAL row replaces its rows by mode."""
    total = F.upper(F.coalesce(F.col(mode), F.lit("TOTAL"))) == "TOTAL"
    has = counties.groupBy(year, state, county, party).agg(F.bool_or(total).alias("__has"))
    rows = counties.join(has, [c for c in (year, state, county, party)]).filter(~F.col("__has") | total)
    pick = [F.sum(F.when(F.col(party) == s, F.col(votes_)).otherwise(0)) for s in sides]
    return rows.filter(F.col(party).isin(*sides)).groupBy(year, state).agg(F.try_divide(pick[1], pick[0] + pick[1]).alias("share"))


def small_cells_note(effects: DataFrame, sizes: DataFrame, on: list[str], cell: str, minimum: int) -> DataFrame:
    """Effects with `small` and `note`: the cells below the minimum that an effect rests on, in order."""
    low = sizes.filter(F.col("n") < minimum).groupBy(*on).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(cell, "n"))), lambda s: F.concat(s[cell].cast("string"), F.lit(" (n="), s["n"].cast("string"), F.lit(")"))), "; ").alias("note"))
    return effects.join(low, on, "left").withColumn("small", F.col("note").isNotNull())
