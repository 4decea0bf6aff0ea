"""Registered queries over the standard tables, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import agreement, decompose, designs, estimates, panels, payloads, resolve, runs, sampling, windows

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes])


KEYWORDS = {"order": ["the", "that", "with"], "motion": ["of the", "for", "from"]}

CELL_SQL = """
WITH s AS (SELECT l_returnflag, l_linestatus, l_suppkey, count(*) AS m, sum(l_extendedprice) AS s FROM lineitem GROUP BY ALL),
t AS (SELECT l_returnflag, l_linestatus, sum(m) AS n, count(*) AS g, sum(s) / sum(m) AS mean FROM s GROUP BY ALL),
e AS (SELECT s.l_returnflag, s.l_linestatus, any_value(mean) AS mean, any_value(n) AS n, any_value(g) AS g, sum((s - m * mean) * (s - m * mean)) AS ee
      FROM s JOIN t USING (l_returnflag, l_linestatus) GROUP BY s.l_returnflag, s.l_linestatus),
c AS (SELECT *, CASE WHEN g > 1 THEN sqrt(ee * g / (g - 1)) / n END AS se FROM e)
"""


@query(CELL_SQL + """SELECT l_returnflag, l_linestatus, round(mean, 4) AS mean, round(se, 4) AS se, n::BIGINT AS n, g::BIGINT AS n_clusters,
 round(mean - 1.959964 * se, 4) AS ci_low, round(mean + 1.959964 * se, 4) AS ci_high FROM c""")
def clustered_cell_means(spark, sf_dir):
    """Mean price by flag and status, clustered by supplier."""
    rows = read(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_suppkey", "l_extendedprice")
    return rounded(estimates.cell_means(rows, "l_extendedprice", ["l_returnflag", "l_linestatus"], "l_suppkey"))


@query(CELL_SQL + """, p AS (SELECT l_returnflag, max(CASE WHEN l_linestatus = 'O' THEN mean END) AS mean_high, max(CASE WHEN l_linestatus = 'F' THEN mean END) AS mean_low,
 max(CASE WHEN l_linestatus = 'O' THEN se END) AS a, max(CASE WHEN l_linestatus = 'F' THEN se END) AS b FROM c GROUP BY 1)
SELECT l_returnflag, round(mean_high, 4) AS mean_high, round(mean_low, 4) AS mean_low, round(mean_high - mean_low, 4) AS gap, round(sqrt(a * a + b * b), 4) AS se,
 round(mean_high - mean_low - 1.959964 * sqrt(a * a + b * b), 4) AS ci_low, round(mean_high - mean_low + 1.959964 * sqrt(a * a + b * b), 4) AS ci_high FROM p""")
def party_style_gap(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_suppkey", "l_extendedprice")
    cells = estimates.cell_means(rows, "l_extendedprice", ["l_returnflag", "l_linestatus"], "l_suppkey")
    return rounded(estimates.gap(cells, "l_linestatus", "O", "F", ["l_returnflag"]))


MONTHS = "SELECT c_mktsegment, c_custkey, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS t, o_totalprice AS y, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey"


def monthly(spark, sf_dir):
    orders = read(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    customer = read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_acctbal")
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).withColumn("t", (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate"))


@query(f"""WITH r AS ({MONTHS}), g AS (SELECT c_mktsegment, count(*) AS n, count(DISTINCT c_custkey) AS g, regr_slope(y, t) AS b, regr_intercept(y, t) AS a, avg(t) AS mt, regr_sxx(y, t) AS sxx FROM r GROUP BY 1),
u AS (SELECT r.c_mktsegment, c_custkey, sum((t - mt) * (y - a - b * t)) AS u FROM r JOIN g USING (c_mktsegment) GROUP BY 1, 2),
v AS (SELECT c_mktsegment, sum(u * u) AS uu FROM u GROUP BY 1),
o AS (SELECT *, sqrt(g / (g - 1.0) * (n - 1.0) / (n - 2.0) * uu) / sxx AS se FROM g JOIN v USING (c_mktsegment))
SELECT c_mktsegment, round(b, 3) AS slope, round(a, 3) AS intercept, round(se, 3) AS se, n::BIGINT AS n, g::BIGINT AS n_clusters, round(b - 1.959964 * se, 3) AS ci_low, round(b + 1.959964 * se, 3) AS ci_high FROM o""")
def trend_clustered(spark, sf_dir):
    return rounded(estimates.trend(monthly(spark, sf_dir), "o_totalprice", "t", ["c_mktsegment"], "c_custkey"), 3)


@query(f"""WITH r AS (SELECT * FROM ({MONTHS}) WHERE o_orderstatus IN ('O', 'F')),
g AS (SELECT c_mktsegment, o_orderstatus, count(*) AS n, regr_slope(y, t) AS b, regr_intercept(y, t) AS a, avg(t) AS mt, regr_sxx(y, t) AS sxx FROM r GROUP BY 1, 2),
u AS (SELECT r.c_mktsegment, c_custkey, sum((CASE WHEN r.o_orderstatus = 'O' THEN 1 ELSE -1 END) * (t - mt) * (y - a - b * t) / sxx) AS u FROM r JOIN g USING (c_mktsegment, o_orderstatus) GROUP BY 1, 2),
v AS (SELECT c_mktsegment, sum(u * u) AS uu, count(*) AS g FROM u GROUP BY 1),
p AS (SELECT c_mktsegment, max(CASE WHEN o_orderstatus = 'O' THEN b END) - max(CASE WHEN o_orderstatus = 'F' THEN b END) AS d, sum(n) AS n FROM g GROUP BY 1),
o AS (SELECT *, sqrt(g / (g - 1.0) * (n - 1.0) / (n - 4.0) * uu) AS se FROM p JOIN v USING (c_mktsegment) WHERE d IS NOT NULL)
SELECT c_mktsegment, round(d, 3) AS gap_slope, round(se, 3) AS se, n::BIGINT AS n, g::BIGINT AS n_clusters, round(d - 1.959964 * se, 3) AS ci_low, round(d + 1.959964 * se, 3) AS ci_high FROM o""")
def gap_trend_clustered(spark, sf_dir):
    return rounded(estimates.gap_trend(monthly(spark, sf_dir), "o_totalprice", "t", "o_orderstatus", "O", "F", ["c_mktsegment"], "c_custkey"), 3)


@query("""WITH r AS (SELECT l_linestatus, l_suppkey, l_extendedprice - avg(l_extendedprice) OVER w AS y, l_quantity - avg(l_quantity) OVER w AS x, l_discount - avg(l_discount) OVER w AS z FROM lineitem WINDOW w AS (PARTITION BY l_linestatus, l_returnflag)),
g AS (SELECT l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS g, sum(x * x) AS xx, sum(x * z) AS xz, sum(z * z) AS zz, sum(x * y) AS xy, sum(z * y) AS zy FROM r GROUP BY 1),
b AS (SELECT *, xx * zz - xz * xz AS d, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS b1, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS b2 FROM g),
s AS (SELECT r.l_linestatus, l_suppkey, sum(x * (y - b1 * x - b2 * z)) AS s1, sum(z * (y - b1 * x - b2 * z)) AS s2 FROM r JOIN b USING (l_linestatus) GROUP BY 1, 2),
w AS (SELECT l_linestatus, sum(s1 * s1) AS w11, sum(s1 * s2) AS w12, sum(s2 * s2) AS w22 FROM s GROUP BY 1),
o AS (SELECT *, g / (g - 1.0) * (n - 1.0) / (n - 2.0) AS c FROM b JOIN w USING (l_linestatus)),
l AS (SELECT l_linestatus, 'l_quantity' AS term, b1 AS coef, sqrt(c * (zz * zz * w11 - 2 * zz * xz * w12 + xz * xz * w22)) / d AS se, n, g FROM o
UNION ALL SELECT l_linestatus, 'l_discount', b2, sqrt(c * (xz * xz * w11 - 2 * xx * xz * w12 + xx * xx * w22)) / d, n, g FROM o)
SELECT l_linestatus, term, round(coef, 3) AS coef, round(se, 3) AS se, n::BIGINT AS n, g::BIGINT AS n_clusters, round(coef - 1.959964 * se, 3) AS ci_low, round(coef + 1.959964 * se, 3) AS ci_high FROM l""")
def within_cell_ols_2(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem", "l_linestatus", "l_returnflag", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount")
    return rounded(estimates.within_cell_ols(rows, "l_extendedprice", ["l_quantity", "l_discount"], ["l_returnflag"], ["l_linestatus"], "l_suppkey").drop("p"), 3)


@query("""WITH r AS (SELECT CASE WHEN event_type IN ('click', 'purchase') THEN 'treated' ELSE 'control' END AS side, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'before' ELSE 'after' END AS period, user_id, value AS y FROM events),
c AS (SELECT side, period, count(*) AS n, avg(y) AS m FROM r GROUP BY 1, 2),
w AS (SELECT 'did' AS contrast, 'treated' AS side, 'after' AS period, 1.0 AS w UNION ALL SELECT 'did', 'treated', 'before', -1 UNION ALL SELECT 'did', 'control', 'after', -1 UNION ALL SELECT 'did', 'control', 'before', 1
 UNION ALL SELECT 'own', 'treated', 'after', 1 UNION ALL SELECT 'own', 'treated', 'before', -1),
p AS (SELECT contrast, sum(w * m) AS est FROM w JOIN c USING (side, period) GROUP BY 1),
u AS (SELECT contrast, user_id, sum(w * (y - m) / n) AS u FROM r JOIN c USING (side, period) JOIN w USING (side, period) GROUP BY 1, 2),
v AS (SELECT contrast, sum(u * u) AS uu FROM u GROUP BY 1),
t AS (SELECT count(*) AS n, count(DISTINCT user_id) AS g, (SELECT count(*) FROM c) AS k FROM r)
SELECT contrast, round(est, 4) AS estimate, round(sqrt(g / (g - 1.0) * (n - 1.0) / (n - k) * uu), 4) AS se, 0::BIGINT AS n_cells_missing FROM p JOIN v USING (contrast), t""")
def did_contrast(spark, sf_dir):
    """Difference in differences from saturated cell means, clustered by user."""
    side = F.when(F.col("event_type").isin("click", "purchase"), "treated").otherwise("control")
    rows = read(spark, sf_dir, "events", "user_id", "event_type", "ts", "value")
    rows = rows.withColumn("side", side).withColumn("period", F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp"), "before").otherwise("after"))
    weights = [("did", "treated", "after", 1.0), ("did", "treated", "before", -1.0), ("did", "control", "after", -1.0), ("did", "control", "before", 1.0), ("own", "treated", "after", 1.0), ("own", "treated", "before", -1.0)]
    table = spark.createDataFrame(weights, "contrast string, side string, period string, weight double")
    return rounded(estimates.cell_contrasts(rows, "value", ["side", "period"], "user_id", table).select("contrast", "estimate", "se", "n_cells_missing"))


@query("""WITH p(kind, start, v) AS (VALUES ('click', DATE '2024-01-05', 'a'), ('click', DATE '2024-01-20', 'b'), ('view', DATE '2024-01-10', 'c'), ('purchase', DATE '2023-12-01', 'd')),
r AS (SELECT event_id, coalesce((SELECT v FROM p WHERE kind = event_type AND start <= ts::DATE ORDER BY start DESC LIMIT 1), (SELECT v FROM p WHERE kind = event_type ORDER BY start LIMIT 1)) AS v FROM events)
SELECT coalesce(v, 'none') AS v, count(*)::BIGINT AS n, sum(event_id)::BIGINT AS ids FROM r GROUP BY 1""")
def asof_period_lookup(spark, sf_dir):
    periods = spark.createDataFrame([("click", "2024-01-05", "a"), ("click", "2024-01-20", "b"), ("view", "2024-01-10", "c"), ("purchase", "2023-12-01", "d")], "event_type string, start string, v string")
    rows = read(spark, sf_dir, "events", "event_id", "event_type", "ts").withColumn("day", F.to_date("ts"))
    found = windows.as_of(rows, periods.withColumn("start", F.to_date("start")), ["event_type"], "day", "start", "v")
    return found.groupBy(F.coalesce("v", F.lit("none")).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("""WITH a AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS y FROM orders),
r AS (SELECT a.o_custkey, a.y, o_totalprice AS v, row_number() OVER (PARTITION BY a.o_custkey, a.y ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) AS k FROM a JOIN orders o ON o.o_custkey = a.o_custkey AND o.o_orderdate < make_timestamp(a.y::BIGINT, 1, 1, 0, 0, 0.0))
SELECT o_custkey, y::INT AS y, count(*)::BIGINT AS n_before, round(avg(v), 4) AS mean_v FROM r WHERE k <= 2 GROUP BY 1, 2""")
def last_two_before(spark, sf_dir):
    orders = read(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    asked = orders.select("o_custkey", F.year("o_orderdate").alias("y")).distinct().withColumn("at", F.struct(F.make_date("y", F.lit(1), F.lit(1)).cast("timestamp_ntz").alias("d"), F.lit(-1).cast("long").alias("k")))
    history = orders.select("o_custkey", F.struct(F.col("o_orderdate").cast("timestamp_ntz").alias("d"), F.col("o_orderkey").alias("k")).alias("time"), F.col("o_totalprice").alias("v"))
    found = windows.last_before(asked, history, ["o_custkey"], "at", "time", 2, ["v"])
    return rounded(found.select("o_custkey", F.year("at.d").alias("y"), "n_before", "mean_v"))


@query("""WITH e(name, day) AS (VALUES ('first', DATE '2024-01-08'), ('second', DATE '2024-01-12'), ('third', DATE '2024-01-25'))
SELECT name, event_type, CASE WHEN ts::DATE < day THEN 'before' ELSE 'after' END AS period, count(*)::BIGINT AS n, round(avg(value), 4) AS mean
FROM events JOIN e ON ts::DATE >= day - 5 AND ts::DATE < day + 5 GROUP BY ALL""")
def event_windows(spark, sf_dir):
    """Rows near each event by range join on day buckets; windows overlap."""
    events = spark.createDataFrame([("first", "2024-01-08"), ("second", "2024-01-12"), ("third", "2024-01-25")], "name string, day string").withColumn("day", F.to_date("day"))
    rows = read(spark, sf_dir, "events", "event_type", "ts", "value").withColumn("at", F.to_date("ts"))
    found = windows.event_periods(rows, events, "at", "day", 5, "name")
    return rounded(found.groupBy("name", "event_type", "period").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")))


@query("""WITH d AS (SELECT DISTINCT event_type, ts::DATE AS day FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS place FROM d WHERE day < DATE '2024-01-20')
SELECT event_type, day, place::INT AS place FROM r WHERE place <= 4""")
def sitting_day_windows(spark, sf_dir):
    days = read(spark, sf_dir, "events", "event_type", "ts").select("event_type", F.to_date("ts").alias("day"))
    edge = days.select("event_type").distinct().withColumn("edge", F.to_date(F.lit("2024-01-20"))).withColumn("many", F.lit(4))
    return windows.last_days_before(days, edge, ["event_type"], "day", "edge", "many").select("event_type", "day", "place")


@query("""WITH m AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT *, CASE WHEN n > (SELECT avg(n) FROM m) THEN 'high' ELSE 'low' END AS level FROM m),
c AS (SELECT *, CASE WHEN lag(level) OVER w IS DISTINCT FROM level THEN 1 ELSE 0 END AS ch FROM s WINDOW w AS (PARTITION BY event_type ORDER BY day)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY event_type ORDER BY day) AS run FROM c)
SELECT event_type, level, run::BIGINT AS run, min(day) AS first, max(day) AS last, count(*)::BIGINT AS length FROM r GROUP BY 1, 2, 3""")
def level_islands(spark, sf_dir):
    daily = read(spark, sf_dir, "events", "event_type", "ts").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    level = daily.crossJoin(daily.agg(F.avg("n").alias("mean"))).withColumn("level", F.when(F.col("n") > F.col("mean"), "high").otherwise("low"))
    return windows.islands(level, ["event_type"], "day", "level")


@query("""WITH u AS (SELECT o_custkey, year(o_orderdate) AS y, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2), c AS (SELECT *, y - lag(y) OVER w AS gap, v - lag(v) OVER w AS change_v FROM u WINDOW w AS (PARTITION BY o_custkey ORDER BY y))
SELECT y::INT AS y, count(*)::BIGINT AS n, round(avg(change_v), 4) AS change FROM c WHERE gap = 1 GROUP BY 1""")
def adjacent_changes(spark, sf_dir):
    units = read(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_totalprice").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("v"))
    return rounded(windows.adjacent_changes(units, ["o_custkey"], "y", ["v"]).groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.avg("change_v").alias("change")))


@query("SELECT c_custkey, ceil(3.0 * row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) / count(*) OVER (PARTITION BY c_mktsegment))::INT AS tercile FROM customer")
def terciles_ceil(spark, sf_dir):
    rows = read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_acctbal")
    return windows.tercile_by_order(rows, ["c_mktsegment"], [F.col("c_acctbal"), F.col("c_custkey")]).select("c_custkey", "tercile")


@query("""WITH e AS (SELECT c_mktsegment, quantile_cont(c_acctbal, [1/3, 2/3]) AS e FROM customer GROUP BY 1)
SELECT c_custkey, (1 + (c_acctbal > e[1])::INT + (c_acctbal > e[2])::INT)::INT AS bin FROM customer JOIN e USING (c_mktsegment)""")
def quantile_bins(spark, sf_dir):
    rows = read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_acctbal")
    return windows.quantile_bins(rows, "c_acctbal", ["c_mktsegment"], 3).select("c_custkey", "bin")


@query("""WITH u AS (SELECT c_mktsegment, c_custkey, c_acctbal AS x, avg(o_totalprice) AS y FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3),
k AS (SELECT *, rank() OVER (PARTITION BY c_mktsegment ORDER BY x) + (count(*) OVER (PARTITION BY c_mktsegment, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY c_mktsegment ORDER BY y) + (count(*) OVER (PARTITION BY c_mktsegment, y) - 1) / 2.0 AS ry FROM u),
s AS (SELECT c_mktsegment, count(*) AS n, corr(x, y) AS r, corr(rx, ry) AS rho FROM k GROUP BY 1)
SELECT c_mktsegment, n::BIGINT AS n, round(r, 6) AS pearson, round(rho, 6) AS spearman, round(tanh(atanh(r) - 1.959964 / sqrt(n - 3)), 6) AS ci_low, round(tanh(atanh(r) + 1.959964 / sqrt(n - 3)), 6) AS ci_high FROM s""")
def rank_correlations(spark, sf_dir):
    means = read(spark, sf_dir, "orders", "o_custkey", "o_totalprice").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("y"))
    rows = read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_acctbal").join(means, F.col("c_custkey") == F.col("o_custkey"))
    return rounded(agreement.correlations(rows, "c_acctbal", "y", ["c_mktsegment"]), 6)


@query("""WITH p AS (SELECT quality AS a, 1 - toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), n AS (SELECT count(*) AS n, avg((a = b)::INT) AS po FROM p),
l AS (SELECT DISTINCT x FROM (SELECT a AS x FROM p UNION ALL SELECT b FROM p)),
f AS (SELECT x, (SELECT count(*) FROM p WHERE a = x) AS r, (SELECT count(*) FROM p WHERE b = x) AS c, (SELECT count(*) FROM p WHERE a = x AND b = x) AS h FROM l),
t AS (SELECT sum(r * c) AS ch, avg(2.0 * h / (r + c)) AS macro_f1 FROM f)
SELECT n::BIGINT AS n, round(po, 6) AS accuracy, round((po - ch / (n * n)) / (1 - ch / (n * n)), 6) AS kappa, round(macro_f1, 6) AS macro_f1 FROM n, t""")
def kappa_f1(spark, sf_dir):
    rows = read(spark, sf_dir, "labels", "quality", "toxic").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
    return rounded(agreement.agreement(rows, "a", "b"), 6)


@query("""WITH p AS (SELECT quality AS a, 1 - toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), l AS (SELECT DISTINCT x FROM (SELECT a AS x FROM p UNION ALL SELECT b FROM p))
SELECT i.x AS a, j.x AS b, (SELECT count(*) FROM p WHERE p.a = i.x AND p.b = j.x)::BIGINT AS n FROM l i, l j""")
def confusion_long(spark, sf_dir):
    rows = read(spark, sf_dir, "labels", "quality", "toxic").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
    return agreement.confusion(rows, "a", "b")


@query("""WITH g AS (SELECT l_returnflag, l_suppkey, count(*) AS m, avg(l_quantity) AS mean, sum(l_quantity * l_quantity) AS sq FROM lineitem GROUP BY 1, 2),
t AS (SELECT l_returnflag, count(*) AS k, sum(m) AS n, sum(m * m) AS mm, sum(m * mean) AS s, sum(m * mean * mean) AS b, sum(sq) AS sq FROM g GROUP BY 1),
c AS (SELECT *, (b - s * s / n) / (k - 1) AS msb, (sq - b) / (n - k) AS msw, (n - mm / n) / (k - 1) AS m0 FROM t)
SELECT l_returnflag, n::BIGINT AS n, k::BIGINT AS n_groups, round((msb - msw) / (msb + (m0 - 1) * msw), 6) AS icc FROM c""")
def intraclass(spark, sf_dir):
    return rounded(agreement.intraclass(read(spark, sf_dir, "lineitem", "l_returnflag", "l_suppkey", "l_quantity"), "l_quantity", "l_suppkey", ["l_returnflag"]), 6)


@query("""WITH p AS (SELECT c_mktsegment AS f, c_nationkey AS k, 1.0 / (2 + count(*)) AS p FROM customer GROUP BY 1, 2),
s AS (SELECT *, (count(*) OVER (PARTITION BY f) - row_number() OVER (PARTITION BY f ORDER BY p, k) + 1) * p AS step FROM p)
SELECT f, k, round(least(1.0, max(step) OVER (PARTITION BY f ORDER BY p, k ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM s""")
def holm_adjust(spark, sf_dir):
    rows = read(spark, sf_dir, "customer", "c_mktsegment", "c_nationkey").groupBy(F.col("c_mktsegment").alias("f"), F.col("c_nationkey").alias("k")).agg((1.0 / (2 + F.count(F.lit(1)))).alias("p"))
    return rounded(agreement.holm(rows.withColumn("o", F.struct("p", "k")).withColumn("p", F.col("p")), "p", ["f"]).select("f", "k", "p_holm"), 6)


CHANGE_SQL = """WITH c AS (SELECT l_linestatus AS g, l_returnflag AS k, count(*) FILTER (year(l_shipdate) = 1995) AS n0, count(*) FILTER (year(l_shipdate) IN (1996, 1997)) AS n1,
 avg(l_extendedprice) FILTER (year(l_shipdate) = 1995) AS m0, avg(l_extendedprice) FILTER (year(l_shipdate) IN (1996, 1997)) AS m1 FROM lineitem WHERE year(l_shipdate) IN (1995, 1996, 1997) GROUP BY 1, 2),
t AS (SELECT g, sum(n0) AS t0, sum(n1) AS t1, (sum(n0 * coalesce(m0, 0)) / sum(n0) + sum(n1 * coalesce(m1, 0)) / sum(n1)) / 2 AS centre FROM c GROUP BY 1),
s AS (SELECT g, k, n0 / t0 AS s0, n1 / t1 AS s1, coalesce(m0, centre) AS m0, coalesce(m1, centre) AS m1, centre FROM c JOIN t USING (g)),
p AS (SELECT g, k, ((m0 + m1) / 2 - centre) * (s1 - s0) AS agenda, (s0 + s1) / 2 * (m1 - m0) AS positions FROM s)
"""


def shipped(spark, sf_dir):
    return read(spark, sf_dir, "lineitem", "l_linestatus", "l_returnflag", "l_suppkey", "l_shipdate", "l_extendedprice").withColumn("y", F.year("l_shipdate"))


@query(CHANGE_SQL + "SELECT g AS l_linestatus, k AS l_returnflag, round(agenda, 4) AS agenda, round(positions, 4) AS positions, round(agenda + positions, 4) AS total FROM p WHERE agenda IS NOT NULL")
def gap_decomposition(spark, sf_dir):
    out = decompose.share_mean_change(shipped(spark, sf_dir), "l_extendedprice", "l_returnflag", "y", 1995, [1996, 1997], ["l_linestatus"])
    return rounded(out.filter("agenda is not null"))


@query("""WITH u AS (SELECT o_custkey AS u, year(o_orderdate) AS y, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1, 2),
b AS (SELECT coalesce(a.y, c.y - 1) AS y, a.n AS n0, a.s AS s0, c.n AS n1, c.s AS s1 FROM u a FULL JOIN u c ON a.u = c.u AND a.y = c.y - 1),
t AS (SELECT y, sum(n0) AS n0, sum(s0) AS s0, sum(n1) AS n1, sum(s1) AS s1, sum(n0) FILTER (n1 IS NOT NULL) AS p0, sum(s0) FILTER (n1 IS NOT NULL) AS q0, sum(n1) FILTER (n0 IS NOT NULL) AS p1, sum(s1) FILTER (n0 IS NOT NULL) AS q1,
 count(*) FILTER (n0 IS NOT NULL AND n1 IS NOT NULL) AS st, count(*) FILTER (n1 IS NULL) AS ex, count(*) FILTER (n0 IS NULL) AS en FROM b GROUP BY 1)
SELECT y::INT AS y, st::BIGINT AS stayers, ex::BIGINT AS exits, en::BIGINT AS entrants, round(s1 / n1 - s0 / n0, 3) AS change, round(q1 / p1 - q0 / p0, 3) AS within, round(s1 / n1 - q1 / p1, 3) AS entry, round(q0 / p0 - s0 / n0, 3) AS exit FROM t WHERE n0 IS NOT NULL AND n1 IS NOT NULL""")
def turnover_steps(spark, sf_dir):
    rows = read(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_totalprice").withColumn("y", F.year("o_orderdate"))
    return rounded(decompose.turnover(rows, "o_custkey", "y", "o_totalprice", []).drop("unmatched"), 3)


@query("""WITH r AS (SELECT l_returnflag AS g, l_linestatus AS s, round(l_quantity, 6) AS v FROM lineitem), t AS (SELECT g, count(*) FILTER (s = 'O') AS ta, count(*) FILTER (s = 'F') AS tb, quantile_cont(v, 0.5) FILTER (s = 'O') AS ma, quantile_cont(v, 0.5) FILTER (s = 'F') AS mb FROM r GROUP BY 1),
c AS (SELECT g, v, count(*) FILTER (s = 'O') AS na, count(*) FILTER (s = 'F') AS nb FROM r GROUP BY 1, 2)
SELECT g, round(sum(least(na / ta, nb / tb)), 6) AS overlap, round(sum(CASE WHEN v > mb THEN na ELSE 0 END) / any_value(ta), 6) AS beyond_a,
 round(sum(CASE WHEN v < ma THEN nb ELSE 0 END) / any_value(tb), 6) AS beyond_b, any_value(ma) AS median_a, any_value(mb) AS median_b FROM c JOIN t USING (g) WHERE ta > 0 AND tb > 0 GROUP BY 1""")
def common_ground_overlap(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_quantity").withColumnRenamed("l_returnflag", "g")
    return rounded(decompose.overlap(rows, "l_quantity", "l_linestatus", "O", "F", ["g"]).filter("median_a is not null and median_b is not null"), 6)


@query("""WITH a AS (SELECT event_id, user_id AS k, event_type, event_type <> 'error' AND value IS NOT NULL AND value > 20 AS ok FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY k, event_type ORDER BY ok DESC, CASE WHEN ok THEN event_id END, event_id DESC) AS n FROM a)
SELECT k AS user_id, event_type, event_id, ok FROM r WHERE n = 1""")
def effective_attempts(spark, sf_dir):
    rows = read(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    rows = rows.withColumn("ok", (F.col("event_type") != "error") & F.col("value").isNotNull() & (F.col("value") > 20)).drop("value")
    return windows.effective_rows(rows, ["user_id", "event_type"], "ok", "event_id").select("user_id", "event_type", "event_id", "ok")


ATTEMPTS_SQL = "SELECT event_id AS attempt, user_id AS speech_id, event_type AS model, value AS score, CASE WHEN value < 30 THEN 'low: value' END AS error FROM events"


def attempts(spark, sf_dir):
    rows = read(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    return rows.select(F.col("event_id").alias("attempt"), F.col("user_id").alias("speech_id"), F.col("event_type").alias("model"), F.col("value").alias("score"), F.when(F.col("value") < 30, "low: value").alias("error"))


@query(f"""WITH a AS ({ATTEMPTS_SQL}), i AS (SELECT DISTINCT speech_id FROM a), m AS (SELECT unnest(['click', 'view', 'purchase']) AS model)
SELECT speech_id, string_agg(model, ',' ORDER BY model) AS owed FROM i, m WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.speech_id = i.speech_id AND a.model = m.model AND error IS NULL) GROUP BY 1""")
def pending_models(spark, sf_dir):
    rows = attempts(spark, sf_dir)
    return runs.pending(rows, rows, ["click", "view", "purchase"])


@query(f"""WITH a AS ({ATTEMPTS_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY speech_id, model ORDER BY attempt) AS n FROM a WHERE error IS NULL)
SELECT speech_id, round(avg(score), 6) AS score_mean, round(stddev_samp(score), 6) AS score_std, count(*)::BIGINT AS n_models FROM r WHERE n = 1 GROUP BY 1""")
def ensemble_scores(spark, sf_dir):
    return rounded(runs.ensemble(attempts(spark, sf_dir), ["score"]), 6)


@query(f"""WITH a AS ({ATTEMPTS_SQL}) SELECT model, count(*)::BIGINT AS attempts, count(error)::BIGINT AS failures, count(DISTINCT speech_id)::BIGINT AS ids, count(DISTINCT split_part(error, ':', 1))::BIGINT AS error_classes FROM a GROUP BY 1""")
def run_summary(spark, sf_dir):
    return runs.run_summary(attempts(spark, sf_dir))


@query("""WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('17|' || doc_id), doc_id) AS n FROM documents) SELECT doc_id, lang, source FROM r WHERE n <= 3""")
def stratified_md5_sample(spark, sf_dir):
    return sampling.stratified_sample(read(spark, sf_dir, "documents", "doc_id", "lang", "source"), ["lang", "source"], "doc_id", 3, 17)


@query("""WITH s AS (SELECT c_mktsegment, count(*) AS size FROM customer GROUP BY 1)
SELECT c_mktsegment, size::BIGINT AS size, (23 // (SELECT count(*) FROM s) + (row_number() OVER (ORDER BY c_mktsegment) <= 23 % (SELECT count(*) FROM s))::INT)::BIGINT AS quota FROM s""")
def even_quotas(spark, sf_dir):
    """Every segment is larger than its share here; unequal cases are in the tests."""
    return sampling.even_quotas(read(spark, sf_dir, "customer", "c_mktsegment"), ["c_mktsegment"], 23)


@query("""WITH s AS (SELECT l_returnflag AS g, l_suppkey AS c, count(*) AS m, sum(l_quantity) AS s FROM lineitem GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY c) - 1 AS i, count(*) OVER (PARTITION BY g) AS z FROM s),
d AS (SELECT draw, g, ('0x' || substr(md5('5|' || draw || '|' || g || '|' || i), 1, 8))::BIGINT % z AS p FROM k, range(50) t(draw)), w AS (SELECT draw, g, p, count(*) AS w FROM d GROUP BY 1, 2, 3),
e AS (SELECT draw, k.g, sum(w * s) / sum(w * m) AS v FROM w JOIN k ON k.g = w.g AND k.i = w.p GROUP BY 1, 2)
SELECT g, (SELECT sum(m) FROM k WHERE k.g = e.g)::BIGINT AS n, round((SELECT sum(s) / sum(m) FROM k WHERE k.g = e.g), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM e GROUP BY 1""")
def bootstrap_percentile(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem", "l_returnflag", "l_suppkey", "l_quantity").withColumnRenamed("l_returnflag", "g")
    return rounded(sampling.bootstrap_mean(rows, "l_quantity", ["g"], ["g"], "l_suppkey", 50, 5), 6)


@query("""WITH r AS (SELECT split, user_id AS u, value AS v, (row_number() OVER (PARTITION BY split, user_id ORDER BY md5('3|' || split || '|' || event_id), event_id)) % 2 AS h FROM events, range(20) t(split)),
m AS (SELECT split, u, avg(v) FILTER (h = 0) AS a, avg(v) FILTER (h = 1) AS b FROM r GROUP BY 1, 2), c AS (SELECT split, corr(a, b) AS r FROM m WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1)
SELECT count(r)::BIGINT AS n_splits, round(avg(r), 6) AS r, round(2 * avg(r) / (1 + avg(r)), 6) AS reliability FROM c""")
def split_half(spark, sf_dir):
    rows = read(spark, sf_dir, "events", "event_id", "user_id", "value")
    return rounded(sampling.split_half(rows, "value", "user_id", "event_id", 20, 3), 6)


@query("""SELECT lang, source, sum(len(regexp_extract_all(text, '(?i)\\b(?:that|with|the)\\b')))::BIGINT AS order_hits, sum(len(regexp_extract_all(text, '(?i)\\b(?:of\\s+the|from|for)\\b')))::BIGINT AS motion_hits, sum((regexp_matches(text, '(?i)\\b(?:that|with|the)\\b'))::INT)::BIGINT AS "order" FROM documents GROUP BY 1, 2""")
def keyword_hits(spark, sf_dir):
    rows = text.keyword_hits(read(spark, sf_dir, "documents", "lang", "source", "text"), KEYWORDS)
    return rows.groupBy("lang", "source").agg(F.sum("order_hits").cast("long").alias("order_hits"), F.sum("motion_hits").cast("long").alias("motion_hits"), F.sum("order").alias("order"))


@query("""SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')) AS normal, len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+'))::INT AS words FROM documents""")
def normalise_text(spark, sf_dir):
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.md5(text.normalise(F.col("text"))).alias("normal"), text.count_words(F.col("text")).alias("words"))


@query("""WITH h AS (SELECT conv_id, turn, regexp_extract_all(text, '(?i)\\b(?:with|that)\\b') AS h FROM conversations) SELECT conv_id, turn, sum(len(h))::BIGINT AS hits FROM h WHERE len(h) > 0 GROUP BY 1, 2""")
def keyword_context(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("k", F.struct("conv_id", "turn"))
    found = text.keyword_context(rows, "k", ["that", "with"], context=20)
    # each snippet must hold its hit where it says
    right = F.substring(F.col("snippet"), F.least(F.col("start"), F.lit(20)) + 1, F.length("hit")) == F.col("hit")
    return found.filter(right).groupBy(F.col("k.conv_id").alias("conv_id"), F.col("k.turn").alias("turn")).agg(F.count(F.lit(1)).alias("hits"))


@query("""SELECT lang, source, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS share FROM documents GROUP BY 1, 2""")
def share_of_total(spark, sf_dir):
    return rounded(panels.shares(read(spark, sf_dir, "documents", "lang", "source"), ["lang"], "source"), 6)


@query("SELECT coalesce(lang, 'all') AS a, coalesce(source, 'all') AS b, count(*)::BIGINT AS n FROM documents GROUP BY CUBE (lang, source)")
def crosstab_margins(spark, sf_dir):
    return panels.crosstab(read(spark, sf_dir, "documents", "lang", "source"), "lang", "source")


@query("""WITH f AS (SELECT DISTINCT l_returnflag FROM lineitem), s AS (SELECT DISTINCT l_linestatus FROM lineitem), c AS (SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS u FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, coalesce(n, 0)::BIGINT AS n, coalesce(u, 0)::BIGINT AS units, coalesce(n, 0) < 10050 AS below_min FROM f CROSS JOIN s LEFT JOIN c USING (l_returnflag, l_linestatus)""")
def complete_grid(spark, sf_dir):
    return panels.complete_cells(read(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_suppkey"), ["l_returnflag", "l_linestatus"], 10050, "l_suppkey")


@query("""WITH v AS (SELECT o_custkey % 400 AS roll, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'D' ELSE 'R' END AS party, o_totalprice > 150000 AS yea FROM orders),
c AS (SELECT roll, count(*) FILTER (party = 'D' AND yea) AS yea_0, count(*) FILTER (party = 'D' AND NOT yea) AS nay_0, count(*) FILTER (party = 'R' AND yea) AS yea_1, count(*) FILTER (party = 'R' AND NOT yea) AS nay_1 FROM v GROUP BY 1)
SELECT *, sign(yea_0 - nay_0) * sign(yea_1 - nay_1) < 0 AS party_unity, sign(yea_0 - nay_0) * sign(yea_1 - nay_1) > 0 AS bipartisan, sign(yea_0 - nay_0) * sign(yea_1 - nay_1) = 0 AS no_majority FROM c""")
def rollcall_party_votes(spark, sf_dir):
    rows = read(spark, sf_dir, "orders", "o_custkey", "o_orderpriority", "o_totalprice")
    rows = rows.select((F.col("o_custkey") % 400).alias("roll"), F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "D").otherwise("R").alias("party"), (F.col("o_totalprice") > 150000).alias("yea"))
    return panels.party_votes(rows, "roll", "party", F.col("yea"), ~F.col("yea"), ("D", "R"))


@query("""WITH u AS (SELECT c_nationkey AS g, c_custkey, c_acctbal AS v, CASE WHEN c_mktsegment < 'F' THEN 'a' ELSE 'b' END AS s FROM customer), m AS (SELECT g, quantile_cont(v, 0.5) FILTER (s = 'a') AS ma, quantile_cont(v, 0.5) FILTER (s = 'b') AS mb FROM u GROUP BY 1)
SELECT c_custkey, abs(v - CASE WHEN s = 'a' THEN mb ELSE ma END) < abs(v - CASE WHEN s = 'a' THEN ma ELSE mb END) AS closer_to_other FROM u JOIN m USING (g)""")
def moderates(spark, sf_dir):
    rows = read(spark, sf_dir, "customer", "c_nationkey", "c_custkey", "c_acctbal", "c_mktsegment").withColumn("s", F.when(F.col("c_mktsegment") < "F", "a").otherwise("b"))
    return panels.nearest_side(rows, "c_acctbal", "s", ("a", "b"), ["c_nationkey"]).select("c_custkey", "closer_to_other")


@query("""WITH d AS (SELECT CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'too_early' WHEN o_orderdate > TIMESTAMP '2000-12-31' THEN 'too_late' WHEN o_totalprice < 50000 THEN 'small' ELSE 'kept' END AS reason FROM orders) SELECT reason, count(*)::BIGINT AS n FROM d GROUP BY 1""")
def drop_accounting(spark, sf_dir):
    when = F.col("o_orderdate").cast("timestamp_ntz")
    rules = [("too_early", when < F.lit("1996-01-01").cast("timestamp_ntz")), ("too_late", when > F.lit("2000-12-31").cast("timestamp_ntz")), ("small", F.col("o_totalprice") < 50000)]
    return panels.drop_reasons(read(spark, sf_dir, "orders", "o_orderdate", "o_totalprice"), rules).groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT p_partkey AS k, unnest(regexp_split_to_array(upper(p_name), '[^A-Z]+')) AS t FROM part), a AS (SELECT DISTINCT k, t FROM t WHERE t <> ''), c AS (SELECT t, count(*) AS n FROM a GROUP BY 1)
SELECT t AS token, n::BIGINT AS n FROM c""")
def name_token_counts(spark, sf_dir):
    rows = read(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", F.explode(F.array_distinct(resolve.name_tokens(F.translate("p_name", "#0123456789_", " "*12)))).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT s_nationkey AS b, s_suppkey AS s, c_custkey AS c, abs(s_acctbal - c_acctbal) < 500 AS near FROM supplier JOIN customer ON c_nationkey = s_nationkey),
g AS (SELECT s, count(DISTINCT c) AS n, min(c) AS any_c, count(DISTINCT CASE WHEN near THEN c END) AS m, min(CASE WHEN near THEN c END) AS near_c FROM p GROUP BY 1)
SELECT s, CASE WHEN n = 1 THEN any_c WHEN m = 1 THEN near_c END AS c, CASE WHEN n = 1 THEN 'unique' WHEN m = 1 THEN 'tie_break' ELSE 'ambiguous' END AS resolved_by, n::BIGINT AS n_candidates FROM g""")
def tie_break_match(spark, sf_dir):
    s, c = read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_acctbal"), read(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal")
    s, c = s.withColumnsRenamed({"s_suppkey": "s", "s_nationkey": "nation"}), c.withColumnsRenamed({"c_custkey": "c", "c_nationkey": "nation"})
    return resolve.resolved_near(s, c, "nation", "s", "c", "s_acctbal", "c_acctbal", 500)


@query("""SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.ref') AS ref FROM events""")
def json_properties(spark, sf_dir):
    return read(spark, sf_dir, "events", "event_id", "props").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.ref").alias("ref"))


@query("""WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders) SELECT r.y::INT AS y FROM range((SELECT min(y) FROM y), (SELECT max(y) FROM y) + 1) r(y) WHERE r.y NOT IN (SELECT y FROM y)""")
def dense_gap_check(spark, sf_dir):
    from ..operators.checks import missing_in_range

    return missing_in_range(read(spark, sf_dir, "orders", "o_orderdate").select(F.year("o_orderdate").alias("y")), "y")


@query("""WITH a AS (SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)), b AS (SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey))
SELECT 'semi' AS kind, count(*)::BIGINT AS n, sum(c_custkey)::BIGINT AS ids FROM a UNION ALL SELECT 'anti', count(*), coalesce(sum(c_custkey), 0)::BIGINT FROM b""")
def semi_anti_suite(spark, sf_dir):
    customer, orders = read(spark, sf_dir, "customer", "c_custkey"), read(spark, sf_dir, "orders", "o_custkey")
    on = F.col("c_custkey") == F.col("o_custkey")
    kinds = [customer.join(orders, on, f"left_{k}").agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("c_custkey"), F.lit(0)).alias("ids")) for k in ("semi", "anti")]
    return kinds[0].unionByName(kinds[1])


@query("""WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders) SELECT day, (floor((year(day) - (year(day) % 2 = 1 AND month(day) = 1 AND day(day) < 3)::INT - 1789) / 2) + 1)::INT AS session,
 make_date(1789 + 2 * floor((year(day) - (year(day) % 2 = 1 AND month(day) = 1 AND day(day) < 3)::INT - 1789) / 2)::BIGINT, 1, 3) AS start,
 (make_date(year(day)::BIGINT, 11, 1) + ((8 - isodow(make_date(year(day)::BIGINT, 11, 1))) % 7)::INT + 1) AS election FROM d""")
def session_calendar(spark, sf_dir):
    days = read(spark, sf_dir, "orders", "o_orderdate").select(F.to_date("o_orderdate").alias("day")).distinct()
    out = days.withColumn("session", dates.session_of(F.col("day")))
    return out.select("day", "session", dates.session_start(F.col("session")).alias("start"), dates.election_day(F.year("day")).alias("election"))


@query("""WITH u AS (SELECT l_suppkey, l_extendedprice AS y, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_returnflag, l_linestatus) AS r FROM lineitem)
SELECT l_suppkey, count(*)::BIGINT AS n, round(avg(y), 4) AS y, round(avg(r), 4) AS y_rel FROM u GROUP BY 1 HAVING count(*) >= 5""")
def unit_means(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem", "l_suppkey", "l_returnflag", "l_linestatus", "l_extendedprice").withColumnRenamed("l_extendedprice", "y")
    return rounded(panels.unit_table(rows, ["l_suppkey"], ["y"], ["l_returnflag", "l_linestatus"], 5))


@query("""SELECT 'gov-' || substr(sha1(doc_id || chr(31) || lang || chr(31) || coalesce(source, 'None')), 1, 16) AS id, doc_id FROM documents""")
def stable_ids(spark, sf_dir):
    return read(spark, sf_dir, "documents", "doc_id", "lang", "source").select(text.stable_id("gov-", "doc_id", "lang", "source").alias("id"), "doc_id")


@query("""SELECT lang, source, count(*)::BIGINT AS n, round(avg(n_chars), 4) AS chars, grouping(lang)::INT AS no_lang, grouping(source)::INT AS no_source FROM documents GROUP BY GROUPING SETS ((lang), (source), ())""")
def grouping_sets(spark, sf_dir):
    """One measure by several groupings and overall, in one pass."""
    rows = read(spark, sf_dir, "documents", "lang", "source", "n_chars")
    sets = rows.groupingSets([["lang"], ["source"], []], "lang", "source")
    out = sets.agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("chars"), F.grouping("lang").cast("int").alias("no_lang"), F.grouping("source").cast("int").alias("no_source"))
    return rounded(out)


@query("""SELECT l_returnflag, count(*)::BIGINT AS n, round(avg(l_discount - l_tax), 6) AS difference, round(stddev_samp(l_discount - l_tax) / sqrt(count(*)), 6) AS se, round(avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*))), 4) AS t FROM lineitem GROUP BY 1""")
def paired_differences(spark, sf_dir):
    out = designs.paired_test(read(spark, sf_dir, "lineitem", "l_returnflag", "l_discount", "l_tax"), "l_discount", "l_tax", ["l_returnflag"])
    return out.select("l_returnflag", "n", F.round("difference", 6).alias("difference"), F.round("se", 6).alias("se"), F.round("t", 4).alias("t"))


@query(f"""WITH m AS (SELECT c_mktsegment, t, avg(y) AS y, count(*)::DOUBLE AS x FROM ({MONTHS}) GROUP BY 1, 2), f AS (SELECT c_mktsegment, regr_slope(x, t) AS bx, regr_intercept(x, t) AS ax, regr_slope(y, t) AS b, regr_intercept(y, t) AS a FROM m GROUP BY 1)
SELECT c_mktsegment, count(*)::BIGINT AS n, round(corr(x, y), 6) AS raw, round(corr(x - ax - bx * t, y - a - b * t), 6) AS detrended FROM m JOIN f USING (c_mktsegment) GROUP BY 1""")
def detrended_correlation(spark, sf_dir):
    rows = monthly(spark, sf_dir).groupBy("c_mktsegment", "t").agg(F.avg("o_totalprice").alias("y"), F.count(F.lit(1)).cast("double").alias("x"))
    return rounded(designs.detrended_correlation(rows, "x", "y", "t", ["c_mktsegment"]), 6)


@query("""WITH u AS (SELECT c_mktsegment AS g, c_nationkey AS k, c_acctbal AS x, avg(o_totalprice) AS y FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, 1, 2, 3),
r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0 AS ry, avg(x) OVER (PARTITION BY g) AS m,
 count(*) OVER (PARTITION BY g, k) AS size, x - avg(x) OVER (PARTITION BY g, k) AS dx, y - avg(y) OVER (PARTITION BY g, k) AS dy FROM u)
SELECT 'pearson_' || g AS statistic, round(corr(x, y), 6) AS r, count(*)::BIGINT AS n FROM r GROUP BY g UNION ALL SELECT 'spearman_' || g, round(corr(rx, ry), 6), count(*) FROM r GROUP BY g
UNION ALL SELECT 'overall', round(corr(x, y), 6), count(*) FROM r UNION ALL SELECT 'group_only', round(corr(m, y), 6), count(*) FROM r UNION ALL SELECT 'within_cell', round(corr(dx, dy), 6), count(*) FROM r WHERE size > 1""")
def validation_statistics(spark, sf_dir):
    means = read(spark, sf_dir, "orders", "o_custkey", "o_totalprice").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("y"))
    units = read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal").join(means, F.col("c_custkey") == F.col("o_custkey"))
    return rounded(designs.validation_statistics(units, "c_acctbal", "y", "c_mktsegment", ["c_mktsegment", "c_nationkey"]), 6)


@query("""WITH p AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"a": ' || (event_id % 13 - 6) || ', "b": 0.5}' WHEN 1 THEN '{"a": "3", "b": 0.5}' WHEN 2 THEN '{"a": true, "b": 1}' WHEN 3 THEN '{"a": 1}' ELSE NULL END AS j FROM events),
v AS (SELECT event_id, j, CASE WHEN json_type(j, '$.a') IN ('DOUBLE', 'BIGINT', 'UBIGINT') AND (j ->> '$.a')::DOUBLE BETWEEN -5 AND 5 THEN (j ->> '$.a')::DOUBLE END AS a, CASE WHEN json_type(j, '$.b') IN ('DOUBLE', 'BIGINT', 'UBIGINT') AND (j ->> '$.b')::DOUBLE BETWEEN 0 AND 1 THEN (j ->> '$.b')::DOUBLE END AS b FROM p)
SELECT event_id, a, b, CASE WHEN j IS NULL THEN 'payload: absent' WHEN a IS NULL THEN 'a: absent or out of range' WHEN b IS NULL THEN 'b: absent or out of range' END AS error FROM v""")
def json_scores_validate(spark, sf_dir):
    kind = F.col("event_id") % 5
    text_of = F.when(kind == 0, F.concat(F.lit('{"a": '), (F.col("event_id") % 13 - 6).cast("string"), F.lit(', "b": 0.5}'))).when(kind == 1, F.lit('{"a": "3", "b": 0.5}')).when(kind == 2, F.lit('{"a": true, "b": 1}')).when(kind == 3, F.lit('{"a": 1}'))
    rows = read(spark, sf_dir, "events", "event_id").withColumn("j", text_of)
    return payloads.validate_scores(rows, "j", {"a": (-5, 5), "b": (0, 1)}).drop("j")


@query("""WITH r AS (SELECT event_id, event_type AS run, user_id % 3 AS build FROM events), f AS (SELECT run, arg_min(build, event_id) AS first FROM r GROUP BY 1)
SELECT run, count(*)::BIGINT AS n, count(*) FILTER (build <> first)::BIGINT AS rejected FROM r JOIN f USING (run) GROUP BY 1""")
def fingerprint_guard(spark, sf_dir):
    rows = read(spark, sf_dir, "events", "event_id", "event_type", "user_id").select("event_id", F.col("event_type").alias("run"), (F.col("user_id") % 3).alias("build"))
    return payloads.guard_first(rows, ["run"], "build", "event_id").groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.count_if("rejected").alias("rejected"))


@query("""WITH t AS (SELECT event_type, sum(user_id)::BIGINT AS p, sum(event_id % 100)::BIGINT AS a FROM events GROUP BY 1) SELECT event_type, p AS prompt_tokens, a AS answer_tokens, round((p * CASE event_type WHEN 'click' THEN 0.5 ELSE 1.0 END + a * CASE event_type WHEN 'click' THEN 1.5 ELSE 2.0 END) / 1e6, 6) AS cost FROM t""")
def token_costs(spark, sf_dir):
    rows = read(spark, sf_dir, "events", "event_type", "user_id", "event_id").withColumn("a", F.col("event_id") % 100)
    prices = spark.createDataFrame([("click", 0.5, 1.5), *[(kind, 1.0, 2.0) for kind in ("view", "signup", "purchase", "error")]], "event_type string, prompt_price double, answer_price double")
    return rounded(payloads.costs(rows, prices, "event_type", "user_id", "a"), 6)
