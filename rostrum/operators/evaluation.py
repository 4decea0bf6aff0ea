"""Evaluating labels and runs: raters, check sheets, precision, odd cases, and comparisons of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .agreement import agreement, confusion
from .checks import IntegrityError
from .sampling import draw_key, quota_sample


def compare_raters(labels: DataFrame, key: str, pairs: list[tuple[str, str]], levels: list[str], rater: str = "rater") -> DataFrame:
    """Agreement of each pair of raters at each level: (a, b, level, n, accuracy, kappa, macro_f1). Pairs are few."""
    out = None
    for a, b in pairs:
        left, right = (labels.filter(F.col(rater) == r).select(key, *[F.col(c).alias(f"{c}_{s}") for c in levels]) for r, s in ((a, "a"), (b, "b")))
        both = left.join(right, key)
        for level in levels:
            one = agreement(both, f"{level}_a", f"{level}_b").select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(level).alias("level"), "n", "accuracy", "kappa", "macro_f1")
            out = one if out is None else out.unionByName(one)
    return out


def confusions(labels: DataFrame, key: str, pairs: list[tuple[str, str]], level: str, rater: str = "rater") -> DataFrame:
    """Long confusion tables of each pair: (a, b, label_a, label_b, n)."""
    out = None
    for a, b in pairs:
        left, right = (labels.filter(F.col(rater) == r).select(key, F.col(level).alias(s)) for r, s in ((a, "x"), (b, "y")))
        one = confusion(left.join(right, key), "x", "y").select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("a").alias("label_a"), F.col("b").alias("label_b"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def set_overlap(rows: DataFrame, first: Column, second: Column, by: list[str]) -> DataFrame:
    """Rows under both conditions, either alone, and neither; null counts as no."""
    a, b = F.coalesce(first, F.lit(False)), F.coalesce(second, F.lit(False))
    return rows.groupBy(*by).agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("first_only"), F.count_if(~a & b).alias("second_only"), F.count_if(~a & ~b).alias("neither"))


def tagged_samples(rows: DataFrame, samples: dict[str, Column]) -> DataFrame:
    """Rows once for each named sample whose condition holds (`sample`)."""
    names = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in samples.items()])
    return rows.withColumn("sample", F.explode(F.filter(names, lambda n: n.isNotNull())))


def filled_shares(rows: DataFrame, by: list[str], column: str, values: list[str]) -> DataFrame:
    """Share of each value in each group, zero where it does not occur."""
    groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    counts = rows.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    grid = groups.withColumn(column, F.explode(F.array(*map(F.lit, values))))
    return grid.join(counts, [*by, column], "left").select(*by, column, F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def odd_cases(rows: DataFrame, size: str, factor: float, reasons: dict[str, Column]) -> DataFrame:
    """Rows that are `large` (over `factor` times the mean size) or meet a named condition; `reasons` lists why."""
    mean = rows.agg(F.avg(size).alias("__mean"))  # one row
    joined = rows.crossJoin(F.broadcast(mean))
    named = {"large": F.col(size) > factor * F.col("__mean"), **reasons}
    out = joined.withColumn("reasons", F.concat_ws(", ", *[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in named.items()]))
    return out.filter("reasons <> ''").drop("__mean")


def flag_table(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """One row: counts of the 2 x 2 table of two conditions, and their agreement."""
    one = set_overlap(rows.withColumn("__all", F.lit(1)), a, b, ["__all"]).drop("__all")
    total = F.col("both") + F.col("first_only") + F.col("second_only") + F.col("neither")
    return one.withColumn("agreement", F.try_divide(F.col("both") + F.col("neither"), total))


def precision(sheet: DataFrame, list_: str, code: str) -> DataFrame:
    """Hand-coded precision of each keyword list; a code other than 0 or 1 stops."""
    bad = sheet.filter(~F.coalesce(F.col(code).isin(0, 1), F.lit(False))).select(list_, code).limit(10).collect()
    if bad:
        raise IntegrityError(f"codes must be 0 or 1: {[tuple(r) for r in bad]}")
    return sheet.groupBy(list_).agg(F.count(F.lit(1)).alias("n"), F.avg(code).alias("precision"))


def check_sheet(rows: DataFrame, strata: list[str], key: str, size: int, overlap: int, seed: int, columns: list[str]) -> DataFrame:
    """A nested stratified sample for coders: `size` rows, `overlap` of them for both; overlap first, then in seeded order; blind columns only."""
    drawn = quota_sample(rows, strata, key, size, seed)
    both = quota_sample(drawn, strata, key, overlap, seed).select(key).withColumn("__both", F.lit(1))
    out = drawn.join(both, key, "left").withColumn("overlap", F.coalesce("__both", F.lit(0)))
    return out.select(key, "overlap", *columns).orderBy(F.desc("overlap"), draw_key(seed + 1, key), key)


def coder_labels(sheet: DataFrame, key: str, kind: str, detail: str, kinds: dict[str, str], details: dict[str, str], needs_detail: str) -> DataFrame:
    """(key, kind, detail) in full names; every row with an unknown or missing code is named in one error."""
    name = lambda c, table: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.lower(F.trim(F.col(c))))
    own, more = name(kind, kinds), name(detail, details)
    error = F.when(own.isNull(), F.lit(kind)).when((own == needs_detail) & more.isNull(), F.lit(detail)).when((own != needs_detail) & F.col(detail).isNotNull(), F.lit(detail))
    marked = sheet.select(key, own.alias(kind), F.when(own == needs_detail, more).alias(detail), error.alias("__error"))
    bad = marked.filter("__error is not null").select(key, "__error").orderBy(key).limit(100).collect()
    if bad:
        raise IntegrityError(f"bad codes: {[tuple(r) for r in bad]}")
    return marked.drop("__error")


def disagreements(rows: DataFrame, a: str, b: str, key: str, top: int) -> DataFrame:
    """The `top` rows whose values differ most; ties by key."""
    return rows.withColumn("difference", F.abs(F.col(a) - F.col(b))).filter("difference is not null").orderBy(F.desc("difference"), key).limit(top)


def most_common(rows: DataFrame, column: str, top: int) -> DataFrame:
    """The `top` values by count; ties in order of the value."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(top)


def common_value(column: str) -> Column:
    """The mode of a group; of several the smallest."""
    return F.mode(column, True)


def run_shift(first: DataFrame, second: DataFrame, key: str, value: str, by: list[str]) -> DataFrame:
    """Two runs on their shared ids: n, correlation, mean shift and its spread, by group."""
    both = first.select(key, *by, F.col(value).alias("__a")).join(second.select(key, F.col(value).alias("__b")), key).filter("__a is not null and __b is not null")
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_pop("__a", "__b"), F.stddev_pop("__a") * F.stddev_pop("__b")).alias("r"), F.avg(F.col("__b") - F.col("__a")).alias("shift"), F.stddev_samp(F.col("__b") - F.col("__a")).alias("sd"))


def extremity_by_type(rows: DataFrame, kind: str, scores: list[str]) -> DataFrame:
    """Rows and mean absolute scores of each type; unlabelled rows are `none`."""
    return rows.groupBy(F.coalesce(kind, F.lit("none")).alias(kind)).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.abs(F.col(s))).alias(f"abs_{s}") for s in scores], *[F.avg((F.col(s) == 0).cast("int")).alias(f"zero_{s}") for s in scores])


def group_medians(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Size, means and exact medians of several columns, from counts by value (a group with few distinct values costs little)."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[f(v).alias(f"{name}_{v}") for v in values for f, name in ((F.avg, "mean"), (F.median, "median"))])


def distinct_in_group(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Rows of groups in which the column takes more than one value: min < max by aggregation, no window over the group."""
    varied = rows.groupBy(*by).agg(F.min(column).alias("__lo"), F.max(column).alias("__hi")).filter("__lo < __hi").select(*by)
    return rows.join(varied, by, "left_semi")


def shuffled(rows: DataFrame, key: str, seed: int, first: list[Column]) -> DataFrame:
    """Rows ordered by `first`, then in a seeded order that does not depend on partitions."""
    return rows.orderBy(*first, draw_key(seed, key), key)


def lagged_share(rows: DataFrame, by: list[str], condition: Column) -> DataFrame:
    """Rows, those that meet the condition, and the share of those that do not."""
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(condition, F.lit(False))).alias("met"))
    return out.withColumn("share_not", 1 - F.col("met") / F.col("n"))
