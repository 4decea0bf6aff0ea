"""Clustered estimates: cell means, gaps, trends, fixed-effects regressions and contrasts.

All come from sums by (group, cluster), which Spark aggregates map-side; a second, small
aggregate over clusters gives the sandwich. No window runs over rows of a group, so a group that
holds most rows is no slower than others.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z = 1.959964


def known(df: DataFrame, columns: list[str], values: list[str]) -> DataFrame:
    """Rows whose keys and values are all present; NaN counts as absent."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    for c in values:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return df.filter(ok)


def interval(df: DataFrame, estimate: str, se: str = "se") -> DataFrame:
    return df.withColumn("ci_low", F.col(estimate) - Z * F.col(se)).withColumn("ci_high", F.col(estimate) + Z * F.col(se))


def p_value(z: Column) -> Column:
    """Two-sided normal p, from a rational approximation of erfc with relative error below 1.2e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    # Coefficients of a published Chebyshev fit to erfc.
    terms = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(terms[-1])
    for c in reversed(terms[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x + poly)


def cell_means(df: DataFrame, value: str, by: list[str], cluster: str) -> DataFrame:
    """Mean of each cell with a cluster-robust error: sqrt(G/(G-1) * sum of squared cluster sums of residuals) / N.

    Rows without value or keys are left out; the error is null for one cluster.
    """
    v = F.col(value).cast("double")
    sums = known(df, [*by, cluster], [value]).groupBy(*by, cluster).agg(F.count(v).alias("__m"), F.sum(v).alias("__s"))
    cells = sums.groupBy(*by).agg(F.sum("__m").alias("n"), F.count(F.lit(1)).alias("n_clusters"), (F.sum("__s") / F.sum("__m")).alias("mean"))
    # residuals are taken before they are squared: sums of squares far from zero would cancel
    joined = sums.join(cells, by) if by else sums.crossJoin(cells)
    residual = F.col("__s") - F.col("__m") * F.col("mean")
    spread = joined.groupBy(*by).agg(*[F.first(c).alias(c) for c in ("mean", "n", "n_clusters")], F.sum(residual * residual).alias("__ee"))
    se = F.when(F.col("n_clusters") > 1, F.sqrt(F.col("__ee") * F.try_divide(F.col("n_clusters"), F.col("n_clusters") - 1)) / F.col("n"))
    return interval(spread.select(*by, "mean", se.alias("se"), "n", "n_clusters"), "mean")


def gap(cells: DataFrame, side: str, high: str, low: str, by: list[str]) -> DataFrame:
    """Difference of two sides' means; errors add in quadrature. A missing side gives null."""
    pick = lambda c, s: F.max(F.when(F.col(side) == s, F.col(c)))
    both = cells.groupBy(*by).agg(pick("mean", high).alias("mean_high"), pick("mean", low).alias("mean_low"), pick("se", high).alias("__a"), pick("se", low).alias("__b"))
    out = both.select(*by, "mean_high", "mean_low", (F.col("mean_high") - F.col("mean_low")).alias("gap"), F.sqrt(F.col("__a") * F.col("__a") + F.col("__b") * F.col("__b")).alias("se"))
    return interval(out, "gap")


def slope_parts(df: DataFrame, value: str, x: str, by: list[str], cluster: str) -> DataFrame:
    """Per group and cluster: score of the slope (u), with the group's slope, squares (sxx), rows (n)."""
    xx, yy = F.col(x).cast("double"), F.col(value).cast("double")
    own = known(df, [*by, cluster], [value, x]).groupBy(*by, cluster).agg(
        F.count(F.lit(1)).alias("__m"), F.sum(xx).alias("__x"), F.sum(yy).alias("__y"), F.sum(xx * xx).alias("__xx"), F.sum(xx * yy).alias("__xy")
    )
    group = own.groupBy(*by).agg(*[F.sum(f"__{c}").alias(f"__t_{c}") for c in ("m", "x", "y", "xx", "xy")], F.count(F.lit(1)).alias("n_clusters"))
    centre = F.col("__t_x") / F.col("__t_m")
    sxx = F.col("__t_xx") - F.col("__t_x") * centre
    group = group.withColumn("__centre", centre).withColumn("__sxx", sxx).withColumn("slope", F.try_divide(F.col("__t_xy") - F.col("__t_y") * centre, sxx))
    group = group.withColumn("__level", (F.col("__t_y") - F.col("slope") * F.col("__t_x")) / F.col("__t_m"))
    x0, y0, b, c = F.col("__x"), F.col("__y"), F.col("slope"), F.col("__centre")
    u = F.col("__xy") - c * y0 - F.col("__level") * (x0 - c * F.col("__m")) - b * (F.col("__xx") - c * x0)
    return own.join(group, by).select(*by, cluster, u.alias("__u"), "slope", "__level", "__sxx", F.col("__t_m").alias("n"), "n_clusters")


def trend(df: DataFrame, value: str, x: str, by: list[str], cluster: str) -> DataFrame:
    """Slope of value on x in each group, with intercept and clustered error (two coefficients)."""
    parts = slope_parts(df, value, x, by, cluster)
    group = parts.groupBy(*by).agg(*[F.first(c).alias(c) for c in ("slope", "__level", "__sxx", "n", "n_clusters")], F.sum(F.col("__u") * F.col("__u")).alias("__uu"))
    g, n = F.col("n_clusters"), F.col("n")
    se = F.when((g > 1) & (n > 2), F.sqrt(F.try_divide(g, g - 1) * F.try_divide(n - 1, n - 2) * F.col("__uu")) / F.col("__sxx"))
    return interval(group.select(*by, "slope", F.col("__level").alias("intercept"), se.alias("se"), "n", "n_clusters"), "slope")


def gap_trend(df: DataFrame, value: str, x: str, side: str, high: str, low: str, by: list[str], cluster: str) -> DataFrame:
    """Difference of two sides' slopes; a cluster may span both sides. Groups with one side are left out."""
    parts = slope_parts(df.filter(F.col(side).isin(high, low)), value, x, [*by, side], cluster)
    own = F.when(F.col(side) == high, F.col("__u") / F.col("__sxx")).otherwise(-F.col("__u") / F.col("__sxx"))
    scores = parts.groupBy(*by, cluster).agg(F.sum(own).alias("__u"))
    scores = scores.groupBy(*by).agg(F.sum(F.col("__u") * F.col("__u")).alias("__uu"), F.count(F.lit(1)).alias("n_clusters"))
    pick = lambda c, s: F.max(F.when(F.col(side) == s, F.col(c)))
    sides = parts.groupBy(*by).agg(pick("slope", high).alias("__a"), pick("slope", low).alias("__b"), (pick("n", high) + pick("n", low)).alias("n"))
    g, n = F.col("n_clusters"), F.col("n")
    se = F.when((g > 1) & (n > 4), F.sqrt(F.try_divide(g, g - 1) * F.try_divide(n - 1, n - 4) * F.col("__uu")))
    out = sides.join(scores, by).filter(F.col("__a").isNotNull() & F.col("__b").isNotNull())
    return interval(out.select(*by, (F.col("__a") - F.col("__b")).alias("gap_slope"), se.alias("se"), "n", "n_clusters"), "gap_slope")


def demeaned(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """`columns` less their mean in each cell (aggregate and join back: hot cells stay spread)."""
    means = df.groupBy(*by).agg(*[F.avg(c).alias(f"__m_{c}") for c in columns])
    return df.join(means, by).withColumns({c: F.col(c) - F.col(f"__m_{c}") for c in columns}).drop(*[f"__m_{c}" for c in columns])


def within_cell_ols(df: DataFrame, value: str, terms: list[str], cell: list[str], by: list[str], cluster: str) -> DataFrame:
    """value on terms after demeaning within (by, cell); rows (by, term, coef, se, p, n, n_clusters).

    The driver gets a k x k matrix for each group and solves it (pseudo-inverse, so collinear terms
    get the shortest solution); scores are summed by cluster on the executors.
    """
    k = len(terms)
    rows = known(df, [*by, *cell, cluster], [value, *terms]).select(*by, *[c for c in cell if c not in by], cluster, *[F.col(c).cast("double").alias(c) for c in (value, *terms)])
    rows = demeaned(rows, [value, *terms], list(dict.fromkeys([*by, *cell])))
    cross = [F.sum(F.col(a) * F.col(b)).alias(f"c_{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms) if i <= j]
    moments = [F.sum(F.col(a) * F.col(value)).alias(f"m_{i}") for i, a in enumerate(terms)]
    found = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *cross, *moments).collect()
    solved = []
    for r in found:
        xx = np.array([[r[f"c_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        inverse = np.linalg.pinv(xx)
        solved.append((*[r[c] for c in by], r["n"], (inverse @ [r[f"m_{i}"] for i in range(k)]).tolist(), inverse.tolist()))
    kinds = dict(df.dtypes)
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    spark = df.sparkSession
    betas = spark.createDataFrame(solved, (fields + ", " if by else "") + "__n long, __beta array<double>, __inverse array<array<double>>")
    joined = rows.join(F.broadcast(betas), by) if by else rows.crossJoin(F.broadcast(betas))
    residual = F.col(value)
    for i, t in enumerate(terms):
        residual = residual - F.col("__beta")[i] * F.col(t)
    scores = joined.withColumn("__e", residual).groupBy(*by, cluster).agg(*[F.sum(F.col(t) * F.col("__e")).alias(f"s_{i}") for i, t in enumerate(terms)])
    meat = [F.sum(F.col(f"s_{i}") * F.col(f"s_{j}")).alias(f"w_{i}_{j}") for i in range(k) for j in range(i, k)]
    pieces = {tuple(r[c] for c in by): r for r in scores.groupBy(*by).agg(F.count(F.lit(1)).alias("g"), *meat).collect()}
    out = []
    for s in solved:
        key, n, beta, inverse = s[: len(by)], s[-3], s[-2], np.array(s[-1])
        r = pieces[tuple(key)]
        w = np.array([[r[f"w_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        g = r["g"]
        scale = g / (g - 1) * (n - 1) / (n - k) if g > 1 and n > k else float("nan")
        variance = np.diag(inverse @ w @ inverse) * scale
        for i, t in enumerate(terms):
            se = math.sqrt(variance[i]) if variance[i] >= 0 else None
            p = math.erfc(abs(beta[i] / se) / math.sqrt(2)) if se else None
            out.append((*key, t, float(beta[i]), se, p, n, g))
    return interval(spark.createDataFrame(out, (fields + ", " if by else "") + "term string, coef double, se double, p double, n long, n_clusters long"), "coef")


def cell_contrasts(df: DataFrame, value: str, cells: list[str], cluster: str, weights: DataFrame) -> DataFrame:
    """Linear contrasts of saturated cell means.

    `weights`: contrast, the cell keys, weight. Rows (contrast, estimate, se, p, n_cells_missing);
    a contrast that names an empty cell is null. The error uses K = number of cells.
    """
    v = F.col(value).cast("double")
    own = known(df, [*cells, cluster], [value]).groupBy(*cells, cluster).agg(F.count(v).alias("__m"), F.sum(v).alias("__s"))
    cell = own.groupBy(*cells).agg(F.sum("__m").alias("__cell_n"), (F.sum("__s") / F.sum("__m")).alias("__cell_mean"))
    size = own.agg(F.sum("__m").alias("__n"), F.count_distinct(F.col(cluster)).alias("__g"))
    size = size.crossJoin(cell.agg(F.count(F.lit(1)).alias("__k")))  # one row each
    named = weights.join(cell, cells, "left")
    point = named.groupBy("contrast").agg(F.sum(F.col("weight") * F.col("__cell_mean")).alias("estimate"), F.sum(F.col("__cell_mean").isNull().cast("int")).alias("n_cells_missing"))
    score = named.join(own, cells).groupBy("contrast", cluster).agg(F.sum(F.col("weight") * (F.col("__s") - F.col("__m") * F.col("__cell_mean")) / F.col("__cell_n")).alias("__u"))
    spread = score.groupBy("contrast").agg(F.sum(F.col("__u") * F.col("__u")).alias("__uu"))
    out = point.join(spread, "contrast", "left").crossJoin(size)
    g, n, k = F.col("__g"), F.col("__n"), F.col("__k")
    se = F.sqrt(F.try_divide(g, g - 1) * F.try_divide(n - 1, n - k) * F.col("__uu"))
    ok = F.col("n_cells_missing") == 0
    out = out.select("contrast", F.when(ok, F.col("estimate")).alias("estimate"), F.when(ok & (g > 1), se).alias("se"), F.col("n_cells_missing").cast("long").alias("n_cells_missing"))
    return interval(out.withColumn("p", p_value(F.try_divide("estimate", "se"))), "estimate")
