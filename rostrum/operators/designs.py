"""Designs composed from the estimates: joint tests, event studies, named models and validation statistics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .agreement import average_rank, pearson
from .estimates import demeaned, known, within_cell_ols


def chi2_tail(x: float, df: int) -> float:
    """P(chi-squared with whole `df` > x), by the finite sums for even and odd df."""
    if x <= 0:
        return 1.0
    half = x / 2
    if df % 2 == 0:
        term, total = math.exp(-half), math.exp(-half)
        for i in range(1, df // 2):
            term *= half / i
            total += term
        return total
    total = math.erfc(math.sqrt(half))
    term = math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
    for i in range(1, (df + 1) // 2):
        total += term
        term *= half / (i + 0.5)
    return total


def wald(scores: DataFrame, estimates: list[float], terms: list[str], scale: float = 1.0) -> dict:
    """Joint test that all estimates are zero.

    `scores` has a row for each cluster and a column for each term: its share of the estimate's
    error. The driver gets the k x k sums of products only.
    """
    k = len(terms)
    sums = scores.agg(*[F.sum(F.col(terms[i]) * F.col(terms[j])).alias(f"w_{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    w = np.array([[sums[f"w_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)]) * scale
    b = np.array(estimates)
    rank = int(np.linalg.matrix_rank(w))
    statistic = float(b @ np.linalg.pinv(w) @ b)
    return {"chi2": statistic, "df": rank, "p": chi2_tail(statistic, rank) if rank else float("nan")}


def block_change_test(df: DataFrame, value: str, block: str, period: str, base, compare, cluster: str) -> dict:
    """Are all blocks' changes between two periods the same? Wald test of differences from the first block, clustered."""
    rows = known(df.filter(F.col(period).isin(base, compare)), [block, period, cluster], [value])
    cells = rows.groupBy(block, period).agg(F.count(F.lit(1)).alias("__n"), F.avg(value).alias("__mean"))
    table = {(r[block], r[period]): (r["__n"], r["__mean"]) for r in cells.collect()}  # a row for each cell
    blocks = sorted(b for b in {k[0] for k in table} if (b, base) in table and (b, compare) in table)
    change = {b: table[b, compare][1] - table[b, base][1] for b in blocks}
    joined = rows.join(F.broadcast(cells), [block, period])
    sign = F.when(F.col(period) == compare, 1.0).otherwise(-1.0)
    own = [F.sum(F.when(F.col(block) == b, sign * (F.col(value) - F.col("__mean")) / F.col("__n")).otherwise(0.0)).alias(f"u{i}") for i, b in enumerate(blocks)]
    scores = joined.groupBy(cluster).agg(*own).select(*[(F.col(f"u{i}") - F.col("u0")).alias(f"d{i}") for i in range(1, len(blocks))])
    if len(blocks) < 2:
        return {"chi2": float("nan"), "df": 0, "p": float("nan"), "changes": change}
    g, n = (int(x) for x in rows.agg(F.count_distinct(cluster), F.count(F.lit(1))).first())
    scale = g / (g - 1) * (n - 1) / (n - len(table)) if g > 1 and n > len(table) else float("nan")
    return wald(scores, [change[b] - change[blocks[0]] for b in blocks[1:]], [f"d{i}" for i in range(1, len(blocks))], scale) | {"changes": change}


def event_study(df: DataFrame, value: str, k: str, treated: str, unit: str, event: str, cluster: str, window: list[int], reference: int) -> DataFrame:
    """Treated x k effects against `reference`, with unit x event and event x k effects; stacked events, clustered errors.

    A row counts once for each event whose window holds it; `treated` is 0 or 1.
    """
    rows = df.filter(F.col(k).isin(window))
    others = [w for w in window if w != reference]
    columns = {f"treated_k{w}".replace("-", "m"): (F.col(treated) * (F.col(k) == w).cast("int")).cast("double") for w in others}
    times = {f"__time_{i}": (F.col(k) == w).cast("double") for i, w in enumerate(others)}
    events = [r[0] for r in rows.select(event).distinct().orderBy(event).collect()]  # named events are few
    extra = {f"__e{j}{name}": expression * (F.col(event) == e).cast("double") for j, e in enumerate(events) for name, expression in times.items()}
    design = rows.withColumns(columns | extra)
    out = within_cell_ols(design, value, [*columns, *extra], [unit, event], [], cluster)
    label = {name: w for name, w in zip(columns, others, strict=True)}
    pairs = F.create_map(*[F.lit(x) for kv in label.items() for x in kv])
    return out.filter(F.col("term").isin(list(columns))).withColumn("k", pairs[F.col("term")]).select("k", "coef", "se", "n", "n_clusters")


def model_table(df: DataFrame, value: str, models: dict[str, list[str]], cell: list[str], by: list[str], cluster: str) -> DataFrame:
    """within_cell_ols for named lists of terms, stacked with the column `model`."""
    out = None
    for name, terms in models.items():
        one = within_cell_ols(df, value, terms, cell, by, cluster).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def validation_statistics(units: DataFrame, score: str, bench: str, group: str, cell: list[str]) -> DataFrame:
    """Correlations of a score with a benchmark: within groups, within cells of two or more units, by group only, overall.

    Rows (statistic, r, n); r is null without variation.
    """
    rows = known(units, [group, *cell], [score, bench]).select(group, *[c for c in cell if c != group], F.col(score).cast("double").alias("__x"), F.col(bench).cast("double").alias("__y"))
    groups = rows.groupBy(F.concat(F.lit("pearson_"), F.col(group).cast("string")).alias("statistic")).agg(pearson(F.col("__x"), F.col("__y")).alias("r"), F.count(F.lit(1)).alias("n"))
    ranks = rows.withColumn("__rx", average_rank(F.col("__x"), [group])).withColumn("__ry", average_rank(F.col("__y"), [group]))
    spearman = ranks.groupBy(F.concat(F.lit("spearman_"), F.col(group).cast("string")).alias("statistic")).agg(pearson(F.col("__rx"), F.col("__ry")).alias("r"), F.count(F.lit(1)).alias("n"))
    overall = rows.agg(F.lit("overall").alias("statistic"), pearson(F.col("__x"), F.col("__y")).alias("r"), F.count(F.lit(1)).alias("n"))
    means = rows.groupBy(group).agg(F.avg("__x").alias("__m"))
    only = rows.join(means, group).agg(F.lit("group_only").alias("statistic"), pearson(F.col("__m"), F.col("__y")).alias("r"), F.count(F.lit(1)).alias("n"))
    sizes = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("__size")).filter("__size > 1")
    inner = demeaned(rows.join(sizes, cell), ["__x", "__y"], cell)
    within = inner.agg(F.lit("within_cell").alias("statistic"), pearson(F.col("__x"), F.col("__y")).alias("r"), F.count(F.lit(1)).alias("n"))
    return groups.unionByName(spearman).unionByName(overall).unionByName(only).unionByName(within)


def detrended_correlation(df: DataFrame, x: str, y: str, t: str, by: list[str]) -> DataFrame:
    """Correlation of x and y, raw and after taking a linear trend on t out of both."""
    fits = df.groupBy(*by).agg(*[f(c, t).alias(f"__{n}_{c}") for c in (x, y) for f, n in ((F.regr_slope, "b"), (F.regr_intercept, "a"))])
    joined = df.join(fits, by) if by else df.crossJoin(fits)
    left = {f"__r_{c}": F.col(c) - F.col(f"__a_{c}") - F.col(f"__b_{c}") * F.col(t) for c in (x, y)}
    return joined.withColumns(left).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), pearson(F.col(x), F.col(y)).alias("raw"), pearson(F.col(f"__r_{x}"), F.col(f"__r_{y}")).alias("detrended"))


def paired_test(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Mean difference of pairs, its error, and the t statistic."""
    d = F.col(a) - F.col(b)
    out = df.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("difference"), (F.stddev_samp(d) / F.sqrt(F.count(d))).alias("se"))
    return out.withColumn("t", F.try_divide("difference", "se"))
