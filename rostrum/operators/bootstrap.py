"""Cluster bootstrap of any statistic that is a table, joint tests over the draws, and validation designs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .designs import chi2_tail
from .sampling import cluster_weights

POINT = -1


def drawn(rows: DataFrame, strata: list[str], cluster: str, draws: int, seed: int) -> DataFrame:
    """`rows` once for each draw that picks their cluster, with `draw` and `weight`; draw POINT has all rows with weight 1.

    `rows` should be sums by cluster already: the table grows with the number of draws.
    """
    clusters = rows.select(*strata, cluster).distinct()
    picked = cluster_weights(clusters, strata, cluster, draws, seed)
    return rows.join(picked, [*strata, cluster]).unionByName(rows.withColumns({"draw": F.lit(POINT), "weight": F.lit(1).cast("long")}))


def bootstrap_table(rows: DataFrame, statistic: Callable[[DataFrame, str, str], DataFrame], strata: list[str], cluster: str, key: list[str], column: str, draws: int, seed: int) -> DataFrame:
    """(draw, key, value) of a table-valued statistic under resampled clusters; POINT is the estimate itself.

    `statistic(rows, draw, weight)` must give its table for each value of the column `draw`, and
    weigh rows by the column `weight`. One plan computes all draws; nothing is collected.
    """
    table = statistic(drawn(rows, strata, cluster, draws, seed), "draw", "weight")
    return table.select("draw", *key, F.col(column).cast("double").alias("value"))


def intervals(table: DataFrame, key: list[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(key, value, low, high, n_draws) from bootstrap_table: the estimate with percentile ends. Draws without a value are left out."""
    point = table.filter(F.col("draw") == POINT).select(*key, "value")
    ends = table.filter((F.col("draw") != POINT) & F.col("value").isNotNull()).groupBy(*key).agg(F.percentile("value", F.array(F.lit(low), F.lit(high))).alias("__e"), F.count(F.lit(1)).alias("n_draws"))
    return point.join(ends, key, "left").select(*key, "value", F.col("__e")[0].alias("low"), F.col("__e")[1].alias("high"), "n_draws")


def bootstrap_wald(table: DataFrame, term: str) -> dict:
    """Joint test that all terms of a bootstrap table are zero, with the draws' covariance. The driver gets k values and k x k sums."""
    point = {r[term]: r["value"] for r in table.filter(F.col("draw") == POINT).select(term, "value").collect()}
    terms = sorted(point)
    wide = table.filter(F.col("draw") != POINT).groupBy("draw").pivot(term, terms).agg(F.first("value"))
    names = [f"__t{i}" for i in range(len(terms))]
    wide = wide.toDF("draw", *names).dropna()
    pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    sums = wide.agg(*[F.covar_samp(names[i], names[j]).alias(f"c_{i}_{j}") for i, j in pairs]).first()
    covariance = np.array([[sums[f"c_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(terms))] for i in range(len(terms))])
    b = np.array([point[t] for t in terms], dtype=float)
    rank = int(np.linalg.matrix_rank(covariance))
    statistic = float(b @ np.linalg.pinv(covariance) @ b)
    return {"chi2": statistic, "df": rank, "p": chi2_tail(statistic, rank) if rank else float("nan")}


def weighted_spread(rows: DataFrame, value: str, flags: list[str], by: list[str], weight: str) -> DataFrame:
    """Long (by, statistic, value): weighted sample deviation of the value and weighted shares of flags."""
    w, v = F.col(weight).cast("double"), F.col(value).cast("double")
    sums = rows.filter(v.isNotNull()).groupBy(*by).agg(F.sum(w).alias("__w"), F.sum(w * v).alias("__s"), F.sum(w * v * v).alias("__q"), *[F.sum(w * F.col(f).cast("int")).alias(f"__f_{f}") for f in flags])
    variance = F.try_divide(F.col("__q") - F.col("__s") * F.col("__s") / F.col("__w"), F.col("__w") - 1)
    wide = sums.select(*by, F.sqrt(F.greatest(variance, F.lit(0.0))).alias("sd"), *[(F.col(f"__f_{f}") / F.col("__w")).alias(f) for f in flags])
    return wide.unpivot(by, ["sd", *flags], "statistic", "value")


def validation_grid(rows: DataFrame, score: str, benches: list[str], samples: dict, units: dict[str, list[str]], thresholds: list[int], group: str, cell: list[str]) -> DataFrame:
    """Validation statistics of each design (sample x benchmark x unit x threshold), stacked.

    `samples`: name to condition; `units`: name to the columns that make a unit; a unit needs
    `threshold` rows. Designs are few; each is one plan over sums by unit.
    """
    from .designs import validation_statistics

    out = None
    for sample, condition in samples.items():
        kept = rows.filter(condition & F.col(score).isNotNull())
        for unit, columns in units.items():
            for bench in benches:
                keys = list(dict.fromkeys([*columns, group, *cell]))
                means = kept.filter(F.col(bench).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"), F.avg(score).alias("__score"), F.avg(bench).alias("__bench"))
                for threshold in thresholds:
                    found = validation_statistics(means.filter(F.col("__rows") >= threshold), "__score", "__bench", group, cell)
                    one = found.select(F.lit(sample).alias("sample"), F.lit(unit).alias("unit"), F.lit(bench).alias("bench"), F.lit(threshold).alias("threshold"), "statistic", "r", "n")
                    out = one if out is None else out.unionByName(one)
    return out


def benchmark_regression(units: DataFrame, bench: str, score: str, side: str, cluster: str) -> DataFrame:
    """benchmark on score with an effect of the side, clustered."""
    from .estimates import within_cell_ols

    return within_cell_ols(units, bench, [score], [side], [], cluster)
