"""Registered queries of corpus building, member studies, bootstraps, roll calls, elections and evaluation, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import bootstrap, checks, corpus, decompose, elections, evaluation, lifecycle, members, panels, rollcalls
from .catalog import attempts, query, read, rounded

RAW_SQL = """raw AS (SELECT md5(coalesce(text, '')) AS id, lang AS member, source AS state, n_chars AS words, CASE lang WHEN 'en' THEN 'D' WHEN 'de' THEN 'R' ELSE 'I' END AS party, coalesce(text, '') AS text FROM documents),
kept AS (SELECT * FROM raw WHERE coalesce(upper(trim(state)), '') NOT IN ('SRC0', 'WEB0') AND coalesce(member, '') <> 'xx'),
one AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY member) AS n FROM kept)"""


@query(f"""WITH {RAW_SQL}, t AS (SELECT *, CASE WHEN n > 1 THEN 'duplicate' WHEN words < 50 THEN 'short' WHEN trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') = '' THEN 'empty' END AS reason FROM one)
SELECT (SELECT count(*) FROM raw)::BIGINT AS rows_read, count(*) FILTER (reason IS NULL)::BIGINT AS rows_written, ((SELECT count(*) FROM raw) - count(*))::BIGINT AS dropped_delegate, 0::BIGINT AS dropped_excluded,
 count(*) FILTER (reason = 'duplicate')::BIGINT AS dropped_duplicate, count(*) FILTER (reason = 'short')::BIGINT AS dropped_short, count(*) FILTER (reason = 'empty')::BIGINT AS dropped_empty,
 count(*) FILTER (reason IS NULL AND party = 'I' AND member = 'es')::BIGINT AS party_correction, count(*) FILTER (reason IS NULL AND party = 'I' AND member <> 'es')::BIGINT AS party_caucus, DATE '2001-01-03' AS first_day, DATE '2001-01-03' AS last_day FROM t""")
def corpus_build(spark, sf_dir):
    """A whole build over the documents as speeches: equal texts share an id, languages stand for members."""
    docs = read(spark, sf_dir, "documents", "text", "lang", "source", "n_chars")
    text = F.coalesce("text", F.lit(""))
    raw = docs.select(
        F.md5(text).alias("speech_id"), F.lit("20010103").alias("date"), F.col("lang").alias("speakerid"), F.when(F.col("lang") == "en", "D").when(F.col("lang") == "de", "R").otherwise("I").alias("party"),
        F.lit("H").alias("chamber"), F.col("source").alias("state"), F.lit("name").alias("last_name"), F.lit("107").alias("congress"), F.col("n_chars").cast("string").alias("word_count"), text.alias("text"),
    )
    rules = corpus.Rules(delegates=["SRC0", "WEB0"], excluded=["xx"], corrections={"es": "R"}, caucus={"fr": "D", "": "D"})
    return corpus.build_stats(corpus.build_corpus(raw, rules))


@query("SELECT 'text' AS \"column\", count(*) FILTER (text IS NULL)::BIGINT AS nulls FROM documents UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL) FROM documents UNION ALL SELECT 'source', count(*) FILTER (source IS NULL) FROM documents")
def null_counts(spark, sf_dir):
    return corpus.null_counts(read(spark, sf_dir, "documents"), ["text", "lang", "source"])


@query("""WITH s AS (SELECT o_custkey, year(o_orderdate)::INT AS y, min(o_orderkey) AS b FROM orders GROUP BY 1, 2)
SELECT o_custkey, y, first(b) OVER (PARTITION BY o_custkey ORDER BY y) AS born, row_number() OVER (PARTITION BY o_custkey ORDER BY y)::INT AS tenure, min(y) OVER (PARTITION BY o_custkey) AS first_session FROM s""")
def member_background(spark, sf_dir):
    rows = read(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", F.year("o_orderdate").alias("y"), F.col("o_orderkey").alias("born"))
    return members.background(rows, "o_custkey", "y", "born")


@query("""WITH s AS (SELECT DISTINCT o_custkey, year(o_orderdate)::INT AS y FROM orders WHERE o_orderstatus = 'F')
SELECT o_custkey, y, CASE WHEN y < 1998 THEN NOT EXISTS (SELECT 1 FROM s n WHERE n.o_custkey = s.o_custkey AND n.y = s.y + 1) END AS last_session FROM s""")
def last_session_flags(spark, sf_dir):
    served = read(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_orderstatus").filter("o_orderstatus = 'F'").select("o_custkey", F.year("o_orderdate").alias("y")).distinct()
    return members.last_session_flag(served, served, "o_custkey", "y", 1998)


UNITS_SQL = """c AS (SELECT l_suppkey, l_linestatus, year(l_shipdate)::INT AS y, min(l_returnflag) AS l_returnflag, count(*) AS n, avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS sd, avg(l_quantity) AS bench FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) >= 5),
s AS (SELECT l_linestatus, year(l_shipdate)::INT AS y, avg(l_extendedprice) AS side_mean FROM lineitem GROUP BY 1, 2)"""


def shipments(spark, sf_dir):
    return read(spark, sf_dir, "lineitem", "l_suppkey", "l_linestatus", "l_returnflag", "l_shipdate", "l_extendedprice", "l_quantity").withColumn("y", F.year("l_shipdate"))


@query(f"WITH {UNITS_SQL} SELECT l_suppkey, l_linestatus, y, l_returnflag, n::BIGINT AS n, round(mean, 3) AS mean, round(sd, 3) AS sd, round(bench, 3) AS bench, round(side_mean, 3) AS side_mean FROM c JOIN s USING (l_linestatus, y)")
def member_trajectories(spark, sf_dir):
    return rounded(members.trajectories(shipments(spark, sf_dir), "l_suppkey", "l_linestatus", "y", "l_extendedprice", "l_quantity", ["l_returnflag"], 5), 3)


@query(f"""WITH {UNITS_SQL}, r AS (SELECT l_suppkey AS u, l_linestatus AS s, y, mean AS a, mean - side_mean AS b, bench AS c, count(*) OVER (PARTITION BY l_suppkey, l_linestatus) AS k FROM c JOIN s USING (l_linestatus, y)),
k AS (SELECT * FROM r WHERE k >= 4), f AS (SELECT u, s, count(*) AS n, avg(y) AS my, regr_sxx(a, y) AS sxx, avg(a) AS ma, regr_slope(a, y) AS sa, avg(b) AS mb, regr_slope(b, y) AS sb, regr_slope(c, y) AS sc FROM k GROUP BY 1, 2)
SELECT u AS l_suppkey, s AS l_linestatus, round(any_value(sa), 3) AS slope, round(sqrt(any_value(n) / (any_value(n) - 2.0) * sum(((y - my) * (a - ma - sa * (y - my))) ** 2)) / any_value(sxx), 3) AS slope_se, any_value(n)::BIGINT AS n_sessions,
 round(any_value(sb), 3) AS relative_slope, round(sqrt(any_value(n) / (any_value(n) - 2.0) * sum(((y - my) * (b - mb - sb * (y - my))) ** 2)) / any_value(sxx), 3) AS relative_slope_se, round(any_value(sc), 3) AS bench_slope FROM k JOIN f USING (u, s) GROUP BY 1, 2""")
def member_trends(spark, sf_dir):
    """Slopes by supplier with HC1 errors."""
    return rounded(members.member_trends(shipments(spark, sf_dir), "l_suppkey", "l_linestatus", "y", "l_extendedprice", "l_quantity", 5, 4), 3)


@query("""WITH u AS (SELECT year(o_orderdate)::INT AS y, o_custkey, count(DISTINCT o_orderstatus) > 1 AS a, count(DISTINCT o_orderpriority) > 1 AS b FROM orders GROUP BY 1, 2)
SELECT y, count(*)::BIGINT AS units, count(*) FILTER (a)::BIGINT AS varying_o_orderstatus, count(*) FILTER (b)::BIGINT AS varying_o_orderpriority FROM u GROUP BY 1""")
def identifying_members(spark, sf_dir):
    rows = read(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority").withColumn("y", F.year("o_orderdate"))
    return members.identifying(rows, "o_custkey", ["o_orderstatus", "o_orderpriority"], ["y"])


@query("""SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, count(DISTINCT l_suppkey)::BIGINT AS units, string_agg(DISTINCT year(l_shipdate)::VARCHAR, ', ' ORDER BY year(l_shipdate)::VARCHAR) AS sessions, (count(*) < 10050 OR count(DISTINCT l_suppkey) < 20) AS small FROM lineitem GROUP BY 1, 2""")
def power_ladder_cells(spark, sf_dir):
    return members.ladder_cells(shipments(spark, sf_dir), ["l_returnflag", "l_linestatus"], "l_suppkey", "y", 10050, 20)


@query("""WITH b(band) AS (VALUES (1000.0::DOUBLE), (5000.0::DOUBLE)) SELECT c_mktsegment, printf('%.1f', band) AS band, round(avg((abs(c_acctbal) < band)::INT), 6) AS share, count(*)::BIGINT AS units FROM customer, b GROUP BY 1, 2""")
def centrist_bands(spark, sf_dir):
    return rounded(members.band_shares(read(spark, sf_dir, "customer", "c_mktsegment", "c_acctbal"), "c_acctbal", [1000.0, 5000.0], ["c_mktsegment"]), 6)


@query("""WITH o AS (SELECT o_custkey, year(o_orderdate) AS y, o_orderpriority AS p, o_totalprice AS v, min(year(o_orderdate)) OVER (PARTITION BY o_custkey) AS f FROM orders), m AS (SELECT *, (f = y)::INT::DOUBLE AS new FROM o),
b AS (SELECT y, p FROM m GROUP BY 1, 2 HAVING min(new) < max(new)), d AS (SELECT o_custkey, v - avg(v) OVER w AS v, new - avg(new) OVER w AS x FROM m JOIN b USING (y, p) WINDOW w AS (PARTITION BY y, p)),
f AS (SELECT count(*) AS n, count(DISTINCT o_custkey) AS g, sum(x * v) / sum(x * x) AS b, sum(x * x) AS xx FROM d), u AS (SELECT o_custkey, sum(x * (v - b * x)) AS u FROM d, f GROUP BY 1)
SELECT 'new' AS term, round(b, 3) AS coef, round(sqrt(g / (g - 1.0) * (SELECT sum(u * u) FROM u)) / xx, 3) AS se, n::BIGINT AS n, g::BIGINT AS n_clusters FROM f WHERE n > 0""")
def cohort_against_continuing(spark, sf_dir):
    """Customers in their first year against others, within year and priority."""
    rows = read(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice").withColumn("y", F.year("o_orderdate"))
    first = rows.groupBy("o_custkey").agg(F.min("y").alias("first"))
    found = members.new_against_continuing(rows.join(first, "o_custkey"), "o_totalprice", "first", "y", ["y", "o_orderpriority"], [], "o_custkey")
    return rounded(found.select("term", "coef", "se", "n", "n_clusters"), 3)


@query("SELECT c_custkey, count(*) OVER (PARTITION BY c_mktsegment, c_nationkey)::BIGINT AS size, (dense_rank() OVER (ORDER BY c_mktsegment, c_nationkey) - 1)::BIGINT AS cell FROM customer")
def dense_cell_ids(spark, sf_dir):
    return members.dense_id(read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_nationkey"), ["c_mktsegment", "c_nationkey"], "cell").select("c_custkey", "size", "cell")


@query("""WITH k AS (SELECT c_mktsegment, c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2), t(threshold) AS (VALUES (1), (10), (15))
SELECT c_mktsegment, threshold::INT AS threshold, count(*)::BIGINT AS population, count(*) FILTER (n >= threshold)::BIGINT AS kept, round(count(*) FILTER (n >= threshold) / count(*), 6) AS share FROM k, t GROUP BY 1, 2""")
def selection_by_threshold(spark, sf_dir):
    customer = read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    kept = read(spark, sf_dir, "orders", "o_custkey").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return rounded(members.selection(kept, customer, ["c_mktsegment"], "c_custkey", [1, 10, 15]), 6)


GAP_SQL = """WITH s AS (SELECT l_linestatus AS g, l_suppkey AS c, l_returnflag AS k, CASE WHEN year(l_shipdate) = 1995 THEN 0 ELSE 1 END AS p, count(*) AS n, sum(l_quantity) AS v FROM lineitem WHERE year(l_shipdate) IN (1995, 1996, 1997) GROUP BY 1, 2, 3, 4),
i AS (SELECT g, c, row_number() OVER (PARTITION BY g ORDER BY c) - 1 AS i, count(*) OVER (PARTITION BY g) AS z FROM (SELECT DISTINCT g, c FROM s)),
d AS (SELECT draw, g, ('0x' || substr(md5('9|' || draw || '|' || g || '|' || i), 1, 8))::BIGINT % z AS i FROM i, range(40) t(draw)), w AS (SELECT draw, i.g, c, count(*) AS w FROM d JOIN i ON i.g = d.g AND i.i = d.i GROUP BY 1, 2, 3 UNION ALL SELECT -1, g, c, 1 FROM i),
q AS (SELECT draw, s.g, k, coalesce(sum(w * n) FILTER (p = 0), 0) AS n0, coalesce(sum(w * n) FILTER (p = 1), 0) AS n1, coalesce(sum(w * v) FILTER (p = 0), 0) AS v0, coalesce(sum(w * v) FILTER (p = 1), 0) AS v1 FROM s JOIN w ON w.g = s.g AND w.c = s.c GROUP BY 1, 2, 3),
t AS (SELECT draw, g, sum(n0) AS t0, sum(n1) AS t1, (sum(v0) / sum(n0) + sum(v1) / sum(n1)) / 2 AS m FROM q GROUP BY 1, 2),
h AS (SELECT draw, g, k, n0 / t0 AS s0, n1 / t1 AS s1, CASE WHEN n0 > 0 THEN v0 / n0 ELSE m END AS m0, CASE WHEN n1 > 0 THEN v1 / n1 ELSE m END AS m1, m FROM q JOIN t USING (draw, g)),
e AS (SELECT draw, k AS block, sum(CASE WHEN g = 'O' THEN 1 ELSE -1 END * (s0 + s1) / 2 * (m1 - m0)) AS positions, sum(CASE WHEN g = 'O' THEN 1 ELSE -1 END * ((m0 + m1) / 2 - m) * (s1 - s0)) AS agenda FROM h GROUP BY 1, 2),
x AS (SELECT * FROM e UNION ALL SELECT draw, 'all', sum(positions), sum(agenda) FROM e GROUP BY 1), l AS (SELECT draw, 'positions' AS component, block, positions AS value FROM x UNION ALL SELECT draw, 'agenda', block, agenda FROM x UNION ALL SELECT draw, 'total', block, positions + agenda FROM x WHERE block = 'all')
"""


@query(GAP_SQL + """SELECT component, block, round(any_value(value) FILTER (draw = -1), 5) AS value, round(quantile_cont(value, 0.025) FILTER (draw >= 0), 5) AS low, round(quantile_cont(value, 0.975) FILTER (draw >= 0), 5) AS high, count(value) FILTER (draw >= 0)::BIGINT AS n_draws FROM l GROUP BY 1, 2""")
def bootstrap_gap_change(spark, sf_dir):
    """Change of the gap between two sides, by block, with intervals over resampled suppliers."""
    rows = read(spark, sf_dir, "lineitem", "l_linestatus", "l_returnflag", "l_suppkey", "l_shipdate", "l_quantity").withColumn("y", F.year("l_shipdate")).filter("y between 1995 and 1997")
    sums = rows.groupBy("l_linestatus", "l_returnflag", "l_suppkey", "y").agg(F.count(F.lit(1)).alias("rows"), F.avg("l_quantity").alias("mean"))

    def statistic(table, draw, weight):
        return decompose.gap_change(table.withColumn("w", F.col(weight) * F.col("rows")), "mean", "l_returnflag", "y", 1995, [1996, 1997], "l_linestatus", "O", "F", [draw], "w")

    table = bootstrap.bootstrap_table(sums, statistic, ["l_linestatus"], "l_suppkey", ["component", "block"], "value", 40, 9)
    return rounded(bootstrap.intervals(table, ["component", "block"]), 5)


STEP_SQL = """WITH u AS (SELECT o_custkey AS u, year(o_orderdate) AS y, count(*) AS n, sum(o_totalprice) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
e AS (SELECT a.y, sum(a.n) AS n0, sum(a.s) AS s0, sum(a.n) FILTER (b.u IS NOT NULL) AS p0, sum(a.s) FILTER (b.u IS NOT NULL) AS q0 FROM u a LEFT JOIN u b ON b.u = a.u AND b.y = a.y + 1 GROUP BY 1),
l AS (SELECT a.y - 1 AS y, sum(a.n) AS n1, sum(a.s) AS s1, sum(a.n) FILTER (b.u IS NOT NULL) AS p1, sum(a.s) FILTER (b.u IS NOT NULL) AS q1 FROM u a LEFT JOIN u b ON b.u = a.u AND b.y = a.y - 1 GROUP BY 1),
t AS (SELECT y, s1 / n1 - s0 / n0 AS change, q1 / p1 - q0 / p0 AS within, s1 / n1 - q1 / p1 AS entry, q0 / p0 - s0 / n0 AS exit, 0.0 AS unmatched FROM e JOIN l USING (y)),
w(w, a, b) AS (VALUES ('early', 1992, 1995), ('late', 1996, 2000))"""


@query(STEP_SQL + """, g AS (SELECT w AS "window", count(*) AS n_steps, sum(change) AS change, sum(within) AS within, sum(entry) AS entry, sum(exit) AS exit, sum(unmatched) AS unmatched FROM t JOIN w ON y BETWEEN a AND b GROUP BY 1)
SELECT "window", n_steps::BIGINT AS n_steps, part, round(value, 3)::DOUBLE AS value FROM (UNPIVOT (SELECT "window", n_steps, change::DOUBLE AS change, within::DOUBLE AS within, entry::DOUBLE AS entry, exit::DOUBLE AS exit, unmatched::DOUBLE AS unmatched FROM g) ON change, within, entry, exit, unmatched INTO NAME part VALUE value)""")
def windowed_turnover(spark, sf_dir):
    rows = read(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus").filter("o_orderstatus = 'F'").withColumn("y", F.year("o_orderdate"))
    steps = decompose.turnover(rows, "o_custkey", "y", "o_totalprice", [])
    return rounded(decompose.windowed_turnover(steps, "y", {"early": (1992, 1995), "late": (1996, 2000)}, []), 3)


@query("""WITH m AS (SELECT DISTINCT o_custkey AS u, year(o_orderdate) AS y FROM orders), h AS (SELECT DISTINCT o_custkey AS u, year(o_orderdate) AS y FROM orders WHERE o_totalprice > 300000),
s AS (SELECT m.u, m.y FROM m JOIN m n ON n.u = m.u AND n.y = m.y + 1), f AS (SELECT s.y, a.u IS NULL AS b, c.u IS NULL AS a FROM s LEFT JOIN h a ON a.u = s.u AND a.y = s.y LEFT JOIN h c ON c.u = s.u AND c.y = s.y + 1)
SELECT y::INT AS y, count(*)::BIGINT AS stayers, count(*) FILTER (b)::BIGINT AS silent_before, count(*) FILTER (a)::BIGINT AS silent_after, count(*) FILTER (a AND b)::BIGINT AS silent_both FROM f GROUP BY 1""")
def silent_stayers(spark, sf_dir):
    rows = read(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_totalprice").withColumn("y", F.year("o_orderdate"))
    return decompose.stayers_without_rows(rows.filter("o_totalprice > 300000"), "o_custkey", "y", rows.select("o_custkey", "y"), [])


@query("""WITH v AS (SELECT o_custkey AS roll, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'D' ELSE 'R' END AS party, o_totalprice > 150000 AS yea FROM orders),
c AS (SELECT roll, sign(count(*) FILTER (party = 'D' AND yea) - count(*) FILTER (party = 'D' AND NOT yea)) * sign(count(*) FILTER (party = 'R' AND yea) - count(*) FILTER (party = 'R' AND NOT yea)) AS x FROM v GROUP BY 1)
SELECT c_mktsegment, count(*)::BIGINT AS n, count(*) FILTER (x < 0)::BIGINT AS n_party_unity, count(*) FILTER (x > 0)::BIGINT AS n_bipartisan, count(*) FILTER (x = 0)::BIGINT AS n_no_majority,
 round(avg((x < 0)::INT), 6) AS share_party_unity, round(avg((x > 0)::INT), 6) AS share_bipartisan, round(avg((x = 0)::INT), 6) AS share_no_majority FROM c JOIN customer ON c_custkey = roll GROUP BY 1""")
def rollcall_summary(spark, sf_dir):
    rows = read(spark, sf_dir, "orders", "o_custkey", "o_orderpriority", "o_totalprice")
    rows = rows.select(F.col("o_custkey").alias("roll"), F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "D").otherwise("R").alias("party"), (F.col("o_totalprice") > 150000).alias("yea"))
    found = panels.party_votes(rows, "roll", "party", F.col("yea"), ~F.col("yea"), ("D", "R"))
    return rounded(rollcalls.summary(found.join(read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"), F.col("roll") == F.col("c_custkey")), ["c_mktsegment"]), 6)


@query("""WITH c AS (SELECT l_orderkey, l_suppkey, l_linenumber, o_orderkey IS NOT NULL AS known, s.s_suppkey IS NOT NULL AS out, p.s_suppkey IS NOT NULL AS party FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') ON o_orderkey = l_orderkey
 LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) s ON s.s_suppkey = l_suppkey LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20) p ON p.s_suppkey = l_suppkey)
SELECT count(*)::BIGINT AS votes, count(*) FILTER (NOT known)::BIGINT AS no_call, count(*) FILTER (known AND out)::BIGINT AS outside, count(*) FILTER (known AND NOT out AND NOT party)::BIGINT AS no_party, count(*) FILTER (known AND NOT out)::BIGINT AS kept FROM c""")
def vote_accounts(spark, sf_dir):
    """Votes of known calls by members inside, with counts that close."""
    supplier = read(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal", "s_nationkey").withColumnRenamed("s_suppkey", "l_suppkey")
    calls = read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").filter("o_orderstatus = 'O'").withColumnRenamed("o_orderkey", "l_orderkey")
    parties = supplier.filter("s_nationkey < 20").select("l_suppkey", F.lit("D").alias("party"))
    return rollcalls.votes(read(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_linenumber"), calls, parties, ["l_orderkey"], "l_suppkey", supplier.filter("s_acctbal < 0"), "l_linenumber", [1, 2], [3])[1]


@query("""WITH f AS (SELECT role, turn = 0 AS one, regexp_matches(text, '(?i)\\bthat\\b') AS a, regexp_matches(text, '(?i)\\bwith\\b') AS b FROM conversations),
l AS (SELECT role, one, 'that' AS flag, a AS hit FROM f UNION ALL SELECT role, one, 'with', b FROM f)
SELECT role, flag, count(*)::BIGINT AS n, count(*) FILTER (hit)::BIGINT AS hits, round(count(*) FILTER (hit) / count(*), 6) AS share, count(*) FILTER (one)::BIGINT AS n_subset, count(*) FILTER (one AND hit)::BIGINT AS hits_subset FROM l GROUP BY 1, 2""")
def text_flag_summary(spark, sf_dir):
    rows = rollcalls.flag_text(read(spark, sf_dir, "conversations", "role", "turn", "text"), F.col("text"), {"that": r"\bthat\b", "with": r"\bwith\b"})
    return rounded(rollcalls.flag_summary(rows, ["role"], ["that", "with"], F.col("turn") == 0), 6)


@query("SELECT l_returnflag, count(DISTINCT l_partkey) FILTER (l_discount > 0.05)::BIGINT AS bills, count(DISTINCT l_partkey) FILTER (l_discount > 0.05 AND l_linestatus = 'O')::BIGINT AS bills_passed FROM lineitem GROUP BY 1")
def flagged_bills(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem", "l_returnflag", "l_partkey", "l_discount", "l_linestatus").withColumn("flag", F.col("l_discount") > 0.05)
    return rollcalls.bills(rows, "l_partkey", ["l_returnflag"], "flag", F.col("l_linestatus") == "O")


@query("SELECT coalesce(o_orderpriority, 'none') AS question, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def question_counts(spark, sf_dir):
    return rollcalls.question_counts(read(spark, sf_dir, "orders", "o_orderpriority"), "o_orderpriority")


POWER = [(101, "R", "D", "D"), (102, "R", "D", "R"), (103, "D", "R", "R"), (104, "D", "R", "D"), (105, "D", "R", "R")]


@query("""WITH t(session, president, house, senate) AS (VALUES (101, 'R', 'D', 'D'), (102, 'R', 'D', 'R'), (103, 'D', 'R', 'R'), (104, 'D', 'R', 'D'), (105, 'D', 'R', 'R'))
SELECT a.session::INT AS before, (a.session + 1)::INT AS after, CASE WHEN a.house <> b.house THEN 'H' ELSE 'S' END AS chamber, CASE WHEN a.house <> b.house THEN a.house ELSE a.senate END AS loser, CASE WHEN a.house <> b.house THEN b.house ELSE b.senate END AS gainer
FROM t a JOIN t b ON b.session = a.session + 1 AND a.president = b.president WHERE (a.house <> b.house) <> (a.senate <> b.senate)""")
def chamber_flips(spark, sf_dir):
    """Cases from a fixed table of majorities."""
    return elections.flip_cases(spark.createDataFrame(POWER, "session int, president string, house string, senate string"))


@query("""WITH e(event_type, year, edge) AS (SELECT event_type, y, d FROM (SELECT DISTINCT event_type FROM events), (VALUES (1, DATE '2024-01-08'), (2, DATE '2024-01-20')) v(y, d)),
d AS (SELECT DISTINCT event_type, ts::DATE AS day FROM events), j AS (SELECT event_type, year, day, CASE WHEN day < edge THEN 'before' ELSE 'after' END AS period, abs(day - edge) AS far FROM d JOIN e USING (event_type)),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type, year, period ORDER BY far, day) AS n FROM j) SELECT event_type, year::INT AS year, day, period FROM r WHERE n <= 3""")
def election_windows(spark, sf_dir):
    days = read(spark, sf_dir, "events", "event_type", "ts").select("event_type", F.to_date("ts").alias("day"))
    dates_ = spark.createDataFrame([(1, "2024-01-08"), (2, "2024-01-20")], "year int, edge string").withColumn("edge", F.to_date("edge"))
    return elections.election_windows(days, days.select("event_type").distinct().crossJoin(F.broadcast(dates_)), ["event_type"], "day", "edge", 3)


@query("""SELECT lang, count(*) FILTER (a AND b)::BIGINT AS both, count(*) FILTER (a AND NOT b)::BIGINT AS first_only, count(*) FILTER (NOT a AND b)::BIGINT AS second_only, count(*) FILTER (NOT a AND NOT b)::BIGINT AS neither
FROM (SELECT lang, coalesce(n_chars > 1000, false) AS a, coalesce(contains(text, 'the'), false) AS b FROM documents) GROUP BY 1""")
def condition_overlap(spark, sf_dir):
    return evaluation.set_overlap(read(spark, sf_dir, "documents", "lang", "n_chars", "text"), F.col("n_chars") > 1000, F.col("text").contains("the"), ["lang"])


@query("""WITH g AS (SELECT source, count(*) AS t FROM documents GROUP BY 1), v(lang) AS (VALUES ('en'), ('de'), ('fr'), ('es'), ('xx')), c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT source, lang, coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0) / t, 6) AS share FROM g CROSS JOIN v LEFT JOIN c USING (source, lang) WHERE source IS NOT NULL""")
def filled_shares(spark, sf_dir):
    rows = read(spark, sf_dir, "documents", "source", "lang").filter("source is not null")
    return rounded(evaluation.filled_shares(rows, ["source"], "lang", ["en", "de", "fr", "es", "xx"]), 6)


@query("""SELECT doc_id, concat_ws(', ', CASE WHEN n_chars > 2.0 * (SELECT avg(n_chars) FROM documents) THEN 'large' END, CASE WHEN n_chars < 40 THEN 'short' END, CASE WHEN contains(text, 'http') THEN 'link' END) AS reasons FROM documents
WHERE n_chars > 2.0 * (SELECT avg(n_chars) FROM documents) OR n_chars < 40 OR contains(text, 'http')""")
def odd_documents(spark, sf_dir):
    rows = read(spark, sf_dir, "documents", "doc_id", "n_chars", "text")
    return evaluation.odd_cases(rows, "n_chars", 2.0, {"short": F.col("n_chars") < 40, "link": F.col("text").contains("http")}).select("doc_id", "reasons")


@query("SELECT c_custkey, abs(c_acctbal - c_custkey) AS difference FROM customer ORDER BY 2 DESC, 1 LIMIT 20")
def largest_differences(spark, sf_dir):
    """A report of the top rows."""
    return evaluation.disagreements(read(spark, sf_dir, "customer", "c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", "c_custkey", 20).select("c_custkey", "difference")


@query("SELECT l_partkey, count(*)::BIGINT AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40")
def most_common_values(spark, sf_dir):
    """A report of the top values."""
    return evaluation.most_common(read(spark, sf_dir, "lineitem", "l_partkey"), "l_partkey", 40)


@query("""WITH a AS (SELECT user_id, avg(value) AS a FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, avg(value) AS b FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT count(*)::BIGINT AS n, round(corr(a, b), 6) AS r, round(avg(b - a), 6) AS shift, round(stddev_samp(b - a), 6) AS sd FROM a JOIN b USING (user_id)""")
def run_against_run(spark, sf_dir):
    means = read(spark, sf_dir, "events", "user_id", "event_type", "value")
    one = lambda kind: means.filter(F.col("event_type") == kind).groupBy("user_id").agg(F.avg("value").alias("v"))
    return rounded(evaluation.run_shift(one("click"), one("view"), "user_id", "v", []), 6)


@query("SELECT l_returnflag, count(*)::BIGINT AS n, round(avg(l_quantity), 6) AS mean_l_quantity, median(l_quantity) AS median_l_quantity, round(avg(l_discount), 6) AS mean_l_discount, median(l_discount) AS median_l_discount FROM lineitem GROUP BY 1")
def group_medians(spark, sf_dir):
    return rounded(evaluation.group_medians(read(spark, sf_dir, "lineitem", "l_returnflag", "l_quantity", "l_discount"), ["l_returnflag"], ["l_quantity", "l_discount"]), 6)


@query("""WITH u AS (SELECT o_custkey, year(o_orderdate) AS y FROM orders GROUP BY 1, 2 HAVING min(o_orderstatus) < max(o_orderstatus)) SELECT year(o_orderdate)::INT AS y, count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS ids FROM orders JOIN u ON u.o_custkey = orders.o_custkey AND u.y = year(o_orderdate) GROUP BY 1""")
def varied_groups(spark, sf_dir):
    rows = read(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus").withColumn("y", F.year("o_orderdate"))
    return evaluation.distinct_in_group(rows, "o_orderstatus", ["o_custkey", "y"]).groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("ids"))


@query("""WITH p AS (SELECT doc_id, quality AS x, 1 - toxic AS y FROM labels), b AS (SELECT x, y FROM p WHERE x IS NOT NULL AND y IS NOT NULL), n AS (SELECT count(*) AS n, avg((x = y)::INT) AS po FROM b), l AS (SELECT DISTINCT v FROM (SELECT x AS v FROM b UNION ALL SELECT y FROM b)),
f AS (SELECT v, (SELECT count(*) FROM b WHERE x = v) AS r, (SELECT count(*) FROM b WHERE y = v) AS c, (SELECT count(*) FROM b WHERE x = v AND y = v) AS h FROM l), t AS (SELECT sum(r * c) AS ch, avg(2.0 * h / (r + c)) AS macro_f1 FROM f)
SELECT 'q' AS a, 't' AS b, 'label' AS level, n::BIGINT AS n, round(po, 6) AS accuracy, round((po - ch / (n * n)) / (1 - ch / (n * n)), 6) AS kappa, round(macro_f1, 6) AS macro_f1 FROM n, t""")
def rater_pairs(spark, sf_dir):
    rows = read(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    both = rows.select("doc_id", F.lit("q").alias("rater"), F.col("quality").alias("label")).unionByName(rows.select("doc_id", F.lit("t").alias("rater"), (1 - F.col("toxic")).alias("label")))
    return rounded(evaluation.compare_raters(both, "doc_id", [("q", "t")], ["label"]), 6)


@query("""WITH a AS (SELECT user_id AS speech_id, event_id, event_type, CASE WHEN value < 30 THEN 'low: value' END AS error FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY speech_id ORDER BY (error IS NULL) DESC, CASE WHEN error IS NULL THEN event_id END, event_id DESC) AS n FROM a)
SELECT speech_id, CASE WHEN error IS NULL THEN event_type END AS model, CASE WHEN error IS NULL THEN CASE event_type WHEN 'click' THEN 'act' WHEN 'purchase' THEN 'act' WHEN 'view' THEN 'look' END END AS block, error IS NULL AS label_ok, error FROM r WHERE n = 1""")
def effective_labels(spark, sf_dir):
    return lifecycle.effective_labels(attempts(spark, sf_dir), "speech_id", "model", {"click": "act", "purchase": "act", "view": "look"}, "attempt")


@query("""SELECT m.model, sum(n_chars)::DOUBLE AS prompt_tokens, count(*) * 120.0::DOUBLE AS answer_tokens, round((sum(n_chars) * p + count(*) * 120.0 * a) / 1e6, 6) AS cost, count(*)::BIGINT AS calls FROM documents, (VALUES ('m1', 0.5, 1.5), ('m2', 2.0, 8.0)) m(model, p, a) GROUP BY m.model, p, a""")
def cost_forecast(spark, sf_dir):
    prices = spark.createDataFrame([("m1", 0.5, 1.5), ("m2", 2.0, 8.0)], "model string, prompt_price double, answer_price double")
    found = lifecycle.forecast(read(spark, sf_dir, "documents", "n_chars"), "n_chars", ["m1", "m2"], prices, 120.0)
    return rounded(found.withColumn("prompt_tokens", F.col("prompt_tokens").cast("double")), 6)


@query("""WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders), s AS (SELECT day, floor((year(day) - (year(day) % 2 = 1 AND month(day) = 1 AND day(day) < 3)::INT - 1789) / 2) + 1 AS s FROM d)
SELECT day, (CASE WHEN day >= make_date((1789 + 2 * (s - 1) + 1)::BIGINT, 12, 1) THEN s ELSE s - 1 END)::INT AS complete, CASE WHEN month(day) < 12 THEN year(day)::INT END AS partial FROM s""")
def complete_sessions(spark, sf_dir):
    days = read(spark, sf_dir, "orders", "o_orderdate").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select("day", dates.last_complete_session(F.col("day")).alias("complete"), dates.incomplete_year(F.col("day")).alias("partial"))


@query("WITH k AS (SELECT DISTINCT l_orderkey AS k FROM lineitem) SELECT r.k AS l_orderkey FROM range((SELECT min(k) FROM k), (SELECT max(k) FROM k) + 1) r(k) WHERE r.k NOT IN (SELECT k FROM k)")
def order_key_gaps(spark, sf_dir):
    """Order keys without a line: real gaps, over the whole table."""
    return checks.missing_in_range(read(spark, sf_dir, "lineitem", "l_orderkey"), "l_orderkey")
