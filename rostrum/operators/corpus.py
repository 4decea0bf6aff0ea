"""Building a corpus: kept members, resolved parties, projection, duplicates, and accounts that close."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import IntegrityError
from .panels import drop_reasons


def as_int(value: Column, kind: str = "int") -> Column:
    """Trimmed text as a whole number; anything else stops the query."""
    return F.trim(value.cast("string")).cast(kind)


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The value of a small literal map, or null."""
    if not table:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def delegate(state: Column, delegates: list[str]) -> Column:
    return F.upper(F.trim(F.coalesce(state, F.lit("")))).isin(delegates)


def resolve_party(df: DataFrame, party: str, member: str, corrections: dict[str, str], caucus: dict[str, str], independent: str = "I") -> DataFrame:
    """`party` of independents from a correction of the source, else from the caucus roster; `party_rule` says which, `party_original` keeps the old value.

    Other parties pass unchanged. An independent that no rule covers keeps its label: see unhandled().
    """
    mine, key = F.col(party) == independent, F.coalesce(F.col(member).cast("string"), F.lit(""))
    fixed, own = F.when(mine, lookup(key, corrections)), F.when(mine, lookup(key, caucus))
    rule = F.when(fixed.isNotNull(), "correction").when(own.isNotNull(), "caucus")
    return df.withColumns({"party_original": F.col(party), "party_rule": rule, party: F.coalesce(fixed, own, F.col(party))})


def unhandled(df: DataFrame, party: str, member: str, names: list[str], session: str, expected: list[str]) -> DataFrame:
    """Members whose resolved party is not an expected one: (member, party, names, sessions, n), a row each."""
    bad = df.filter(~F.coalesce(F.col(party).isin(expected), F.lit(False)))
    label = F.concat_ws(" ", *names)
    return bad.groupBy(F.col(member).alias("member"), F.col(party).alias("party")).agg(
        F.array_sort(F.collect_set(label)).alias("names"), F.array_sort(F.collect_set(session)).alias("sessions"), F.count(F.lit(1)).alias("n")
    )


def assert_handled(df: DataFrame, party: str, member: str, names: list[str], session: str, expected: list[str]) -> DataFrame:
    """`df`, or an error that names every member for whom a rule is missing (up to 50)."""
    cases = unhandled(df, party, member, names, session, expected).orderBy("member").limit(50).collect()
    if cases:
        raise IntegrityError("no rule for " + "; ".join(f"{r['member']} ({', '.join(r['names'])}), party {r['party']}, sessions {r['sessions']}, {r['n']} rows" for r in cases))
    return df


def first_ids(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """`duplicate`: true for all rows of a key but the first in `order`.

    Only keys that occur twice are ranked, so the texts of single rows are not sorted.
    """
    from pyspark.sql.window import Window

    twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(F.col(key).alias("__key"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    marked = df.join(twice, F.col(key).eqNullSafe(F.col("__key")), "left_semi").withColumn("duplicate", place > 1)
    return df.join(twice, F.col(key).eqNullSafe(F.col("__key")), "left_anti").withColumn("duplicate", F.lit(False)).unionByName(marked)


@dataclass
class Rules:
    """What a corpus build needs to know; fixed values of a source belong here, not in code."""

    delegates: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    corrections: dict[str, str] = field(default_factory=dict)
    caucus: dict[str, str] = field(default_factory=dict)
    expected: list[str] = field(default_factory=lambda: ["D", "R"])
    least_words: int = 50
    source: str = "a"


def build_corpus(raw: DataFrame, rules: Rules) -> DataFrame:
    """All rows of a raw table in the corpus columns, with `drop_reason` (null: kept) and `party_rule`.

    `raw`: speech_id, date, speakerid, party, chamber, state, last_name, congress, word_count, text.
    Reasons in order: delegate, excluded, duplicate, short, empty. Rows of members without a party rule stop the build.
    """
    kept = ~delegate(F.col("state"), rules.delegates) & ~F.coalesce(F.col("speakerid").cast("string"), F.lit("")).isin(rules.excluded)
    resolved = resolve_party(raw, "party", "speakerid", rules.corrections, rules.caucus)
    assert_handled(resolved.filter(kept), "party", "speakerid", ["last_name", "state"], "congress", rules.expected)
    # of repeated ids the first that no member rule drops stays
    marked = first_ids(resolved.filter(kept), "speech_id", [F.col("date").cast("string"), F.xxhash64("speakerid", "text")])
    marked = marked.unionByName(resolved.filter(~kept).withColumn("duplicate", F.lit(False)))
    text = F.trim(F.regexp_replace("text", r"[ \t\n\x0B\f\r]+", " "))
    rows = marked.withColumn("text", text).withColumn("word_count", as_int(F.col("word_count")))
    reasons = [
        ("delegate", delegate(F.col("state"), rules.delegates)),
        ("excluded", F.coalesce(F.col("speakerid").cast("string"), F.lit("")).isin(rules.excluded)),
        ("duplicate", F.col("duplicate")),
        ("short", F.col("word_count") < rules.least_words),
        ("empty", F.coalesce(F.col("text"), F.lit("")) == ""),
    ]
    out = drop_reasons(rows, reasons)
    return out.select(
        F.col("speech_id").cast("string").alias("speech_id"), F.to_date(F.trim(F.col("date").cast("string")), "yyyyMMdd").alias("date"), F.col("speakerid").cast("string").alias("member_id"),
        "party", "chamber", as_int(F.col("congress"), "smallint").alias("congress_number"), "text", F.lit(rules.source).alias("source"), "last_name", "state", "word_count", "party_original", "party_rule", "drop_reason",
    )


def build_stats(built: DataFrame) -> DataFrame:
    """One row: rows read, written, dropped by reason, resolved by rule, first and last day. Read = written + dropped."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    kept = F.col("drop_reason").isNull()
    drops = [count(F.col("drop_reason") == r).alias(f"dropped_{r}") for r in ("delegate", "excluded", "duplicate", "short", "empty")]
    rules = [count(kept & (F.col("party_rule") == r)).alias(f"party_{r}") for r in ("correction", "caucus")]
    return built.agg(F.count(F.lit(1)).alias("rows_read"), count(kept).alias("rows_written"), *drops, *rules, F.min(F.when(kept, F.col("date"))).alias("first_day"), F.max(F.when(kept, F.col("date"))).alias("last_day"))


def check_full_build(table: DataFrame, stats: dict) -> DataFrame:
    """`table`, or an error if its build was limited or its row count is not the recorded one."""
    if stats.get("limit") is not None:
        raise IntegrityError(f"the build read {stats['limit']} rows only")
    n = table.count()
    if n != stats["rows_written"]:
        raise IntegrityError(f"{n} rows, but {stats['rows_written']} were written")
    return table


def nested_counts(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """(outer, counts): counts by inner value as a sorted map; null is UNKNOWN. Values are few."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN"))
    flat = df.groupBy(name(outer).alias(outer), name(inner).alias("__i")).agg(F.count(F.lit(1)).alias("__n"))
    return flat.groupBy(outer).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__i", "__n")))).alias("counts"))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls) of each column, in one pass."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).unpivot([], columns, "column", "nulls")


def fingerprint(path: str, block: int = 8 << 20) -> str:
    """SHA-256 of a file, read in blocks (local path or URI)."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    digest = hashlib.sha256()
    with system.open_input_stream(name) as f:
        while data := f.read(block):
            digest.update(data)
    return digest.hexdigest()
