"""Roll calls: reading, text flags, party votes and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rollcalls(raw: DataFrame, first: int, last_day, chambers: dict[str, str]) -> DataFrame:
    """Roll calls from session `first` on, up to a day, in the named chambers (name to letter)."""
    letter = F.lit(None).cast("string")
    for name, short in chambers.items():
        letter = F.when(F.col("chamber") == name, short).otherwise(letter)
    rows = raw.withColumn("chamber", letter).withColumn("date", F.to_date("date"))
    return rows.filter(F.col("chamber").isNotNull() & (F.col("congress") >= first) & (F.col("date") <= F.lit(last_day).cast("date"))).withColumnRenamed("congress", "congress_number")


def votes(raw: DataFrame, calls: DataFrame, parties: DataFrame, key: list[str], member: str, outside: DataFrame, cast: str, yeas: list[int], nays: list[int]) -> tuple[DataFrame, DataFrame]:
    """(votes with party, yea and nay; one row of counts): votes of known calls, without the members in `outside`.

    Counts: all, of no known call, of members outside, without a party, kept. Votes without a party stay, with null.
    """
    marked = raw.join(calls.select(*key).distinct().withColumn("__call", F.lit(True)), key, "left").join(outside.select(member).distinct().withColumn("__out", F.lit(True)), member, "left")
    session = [k for k in key if k in parties.columns]
    marked = marked.join(parties, [*session, member], "left")
    known, out = F.col("__call").isNotNull(), F.col("__out").isNotNull()
    counts = marked.agg(F.count(F.lit(1)).alias("votes"), F.count_if(~known).alias("no_call"), F.count_if(known & out).alias("outside"), F.count_if(known & ~out & F.col("party").isNull()).alias("no_party"), F.count_if(known & ~out).alias("kept"))
    kept = marked.filter(known & ~out).drop("__call", "__out")
    return kept.withColumn("yea", F.col(cast).isin(yeas)).withColumn("nay", F.col(cast).isin(nays)), counts


def rollcall_text(columns: list[str]) -> Column:
    """The texts of a roll call that are not null, with ` | ` between them."""
    return F.concat_ws(" | ", *columns)


def flag_text(calls: DataFrame, text: Column, flags: dict[str, str], exclude: list[str] | None = None) -> DataFrame:
    """A boolean for each named pattern (any case), after excluded phrases are blanked."""
    from ..functions.text import blank

    own = blank(text, exclude)
    return calls.withColumns({name: F.coalesce(own.rlike(f"(?i){pattern}"), F.lit(False)) for name, pattern in flags.items()})


def final_passage(question: Column, measure: Column, passage: str, measures: str, procedural: str) -> Column:
    """A vote on passing a measure, not on a procedure (patterns, any case); null texts are no passage."""
    one = lambda c, p: F.coalesce(c.rlike(f"(?i){p}"), F.lit(False))
    return one(question, passage) & one(measure, measures) & ~one(question, procedural)


def summary(party_votes: DataFrame, by: list[str]) -> DataFrame:
    """Roll calls, and counts and shares of unity, bipartisan and tied ones, by group."""
    kinds = ["party_unity", "bipartisan", "no_majority"]
    return party_votes.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(k)).alias(f"n_{k}") for k in kinds], *[F.avg(F.col(k).cast("int")).alias(f"share_{k}") for k in kinds])


def flag_summary(calls: DataFrame, by: list[str], flags: list[str], subset: Column) -> DataFrame:
    """Counts and shares of each flag over all calls and over a subset, long: (by, flag, n, hits, share, n_subset, hits_subset), in one pass."""
    one = F.coalesce(subset, F.lit(False))
    sums = calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(one).alias("n_subset"),
        F.array(*[F.struct(F.lit(f).alias("flag"), F.count_if(F.col(f)).alias("hits"), F.count_if(F.col(f) & one).alias("hits_subset")) for f in flags]).alias("__f"),
    )
    return sums.select(*by, "n", "n_subset", F.inline("__f")).select(*by, "flag", "n", "hits", (F.col("hits") / F.col("n")).alias("share"), "n_subset", "hits_subset")


def bills(calls: DataFrame, bill: str, by: list[str], flag: str, passed: Column) -> DataFrame:
    """Distinct flagged bills, and those of them that passed, for every group (zero where there are none)."""
    own = F.col(flag)
    return calls.groupBy(*by).agg(F.count_distinct(F.when(own, F.col(bill))).alias("bills"), F.count_distinct(F.when(own & F.coalesce(passed, F.lit(False)), F.col(bill))).alias("bills_passed"))


def question_counts(calls: DataFrame, question: str) -> DataFrame:
    """Calls by question, most frequent first, then by name."""
    return calls.groupBy(F.coalesce(question, F.lit("none")).alias("question")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "question")
