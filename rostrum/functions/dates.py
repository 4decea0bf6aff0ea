"""Dates and sessions: a session lasts two years from 3 January of odd years, counted from 1789."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_compact(value: Column) -> Column:
    """YYYYMMDD, as text or number, as a date."""
    return F.to_date(F.trim(value.cast("string")), "yyyyMMdd")


def session_of(day: Column) -> Column:
    early = ((F.year(day) % 2 == 1) & (F.month(day) == 1) & (F.dayofmonth(day) < 3)).cast("int")
    return (F.floor((F.year(day) - early - 1789) / 2) + 1).cast("int")


def session_start(session: Column) -> Column:
    return F.make_date(F.lit(1789) + 2 * (session - 1), F.lit(1), F.lit(3))


def election_day(year: Column) -> Column:
    """The Tuesday after the first Monday in November."""
    return F.date_add(F.next_day(F.make_date(year, F.lit(10), F.lit(31)), "MON"), 1)


def quarter_bin(day: Column, origin: Column, width: int) -> Column:
    return F.floor(F.datediff(day, origin) / width).cast("int")


def cut(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the left-closed bin; null outside."""
    out = F.lit(None).cast("string")
    for low, high, label in zip(edges[:-1], edges[1:], labels, strict=True):
        out = F.when((value >= low) & (value < high), label).otherwise(out)
    return out


def party_on(day: Column, affiliations: Column, default: Column) -> Column:
    """Party of the first dated affiliation (array of start, end, party) that holds on a day, else `default`."""
    found = F.try_element_at(F.filter(affiliations, lambda a: (day >= a["start"]) & (day <= a["end"])), F.lit(1))
    return F.coalesce(found["party"], default)


def last_complete_session(last_day: Column) -> Column:
    """The last session whose rows reach 1 December of its second year."""
    session = session_of(last_day)
    end = F.make_date(F.year(session_start(session)) + 1, F.lit(12), F.lit(1))
    return F.when(last_day >= end, session).otherwise(session - 1).cast("int")


def incomplete_year(last_day: Column) -> Column:
    """The year of the last day if it lies before 1 December, else null."""
    return F.when(last_day < F.make_date(F.year(last_day), F.lit(12), F.lit(1)), F.year(last_day))


def bin_labels(edges: list[int]) -> list[str]:
    """`a-b` for whole-number bins [a, b + 1), and `a+` for one without an end."""
    return [f"{a}-{b - 1}" if b is not None else f"{a}+" for a, b in zip(edges, [*edges[1:], None], strict=True)]
