"""Hand-computed cases of the library's operators."""

import math
import threading

import pytest
from pyspark.sql import functions as F

from rostrum.functions import dates, text
from rostrum.operators import agreement, checks, decompose, designs, estimates, panels, payloads, resolve, runs, sampling, windows
from rostrum.plans import catalog
from rostrum.sources import readers, sinks
from rostrum.streaming import attempts


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_clustered_mean_by_hand(spark):
    df = spark.createDataFrame([("x", "a", 1.0), ("x", "a", 3.0), ("x", "b", 5.0), ("x", "b", 7.0), ("y", "c", 2.0), ("y", "c", None), ("y", "c", float("nan")), (None, "d", 9.0)], "k string, m string, v double")
    found = {r["k"]: r for r in estimates.cell_means(df, "v", ["k"], "m").collect()}
    # cluster residual sums -4 and 4: sqrt(2/1 * 32) / 4 = 2
    assert found["x"]["mean"] == 4 and abs(found["x"]["se"] - 2) < 1e-12 and found["x"]["n_clusters"] == 2
    assert abs(found["x"]["ci_low"] - (4 - 1.959964 * 2)) < 1e-9
    assert found["y"]["mean"] == 2 and found["y"]["se"] is None and found["y"]["n"] == 1 and len(found) == 2


def test_gap_and_missing_side(spark):
    cells = spark.createDataFrame([(1, "R", 3.0, 0.3), (1, "D", 1.0, 0.4), (2, "R", 1.0, 0.1)], "c int, p string, mean double, se double")
    found = {r["c"]: r for r in estimates.gap(cells, "p", "R", "D", ["c"]).collect()}
    assert found[1]["gap"] == 2 and abs(found[1]["se"] - 0.5) < 1e-12 and found[2]["gap"] is None


def test_trends(spark):
    df = spark.createDataFrame([("R", m, t, 1.0 + 2 * t) for m in "ab" for t in range(4)] + [("D", m, t, 5.0 - t) for m in "ac" for t in range(4)], "p string, m string, t int, v double").withColumn("g", F.lit(1))
    slope = {r["p"]: r for r in estimates.trend(df, "v", "t", ["p"], "m").collect()}
    assert abs(slope["R"]["slope"] - 2) < 1e-9 and abs(slope["R"]["intercept"] - 1) < 1e-9 and abs(slope["R"]["se"]) < 1e-6
    (gap,) = estimates.gap_trend(df, "v", "t", "p", "R", "D", ["g"], "m").collect()
    assert abs(gap["gap_slope"] - 3) < 1e-9 and gap["n_clusters"] == 3


def test_within_cell_ols_recovers_coefficients_and_collinear_terms(spark):
    data = [(c, f"m{i % 5}", float(i), float((i * i) % 7), 10 * c + 2.0 * i - 3.0 * ((i * i) % 7)) for c in (1, 2) for i in range(20)]
    df = spark.createDataFrame(data, "c int, m string, x double, z double, y double").withColumn("x2", F.col("x"))
    found = {r["term"]: r for r in estimates.within_cell_ols(df, "y", ["x", "z"], ["c"], [], "m").collect()}
    assert abs(found["x"]["coef"] - 2) < 1e-9 and abs(found["z"]["coef"] + 3) < 1e-9
    twice = {r["term"]: r["coef"] for r in estimates.within_cell_ols(df, "y", ["x", "x2", "z"], ["c"], [], "m").collect()}
    assert abs(twice["x"] - 1) < 1e-9 and abs(twice["x2"] - 1) < 1e-9


def test_contrast_with_missing_cell(spark):
    df = spark.createDataFrame([("a", 0, "m", 1.0), ("a", 1, "m", 3.0), ("a", 0, "n", 2.0), ("a", 1, "n", 5.0)], "g string, t int, m string, v double")
    weights = spark.createDataFrame([("change", "a", 1, 1.0), ("change", "a", 0, -1.0), ("gone", "b", 1, 1.0)], "contrast string, g string, t int, weight double")
    found = {r["contrast"]: r for r in estimates.cell_contrasts(df, "v", ["g", "t"], "m", weights).collect()}
    assert found["change"]["estimate"] == 2.5 and found["change"]["se"] > 0 and 0 < found["change"]["p"] < 1
    assert found["gone"]["estimate"] is None and found["gone"]["n_cells_missing"] == 1


def test_p_value(spark):
    z = [0.0, 0.5, 1.959964, 4.0, -6.0]
    found = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(estimates.p_value(F.col("z"))).collect()]
    assert all(abs(p - math.erfc(abs(x) / math.sqrt(2))) <= 2e-7 * math.erfc(abs(x) / math.sqrt(2)) for p, x in zip(found, z, strict=True))


def test_agreement(spark):
    pairs = [(0, 0)] * 20 + [(0, 1)] * 5 + [(1, 0)] * 10 + [(1, 1)] * 15 + [(None, 1)]
    (r,) = agreement.agreement(spark.createDataFrame(pairs, "a int, b int"), "a", "b").collect()
    assert r["n"] == 50 and abs(r["accuracy"] - 0.7) < 1e-12 and abs(r["kappa"] - 0.4) < 1e-12
    assert abs(r["macro_f1"] - (40 / 55 + 30 / 45) / 2) < 1e-12
    (same,) = agreement.agreement(spark.createDataFrame([(1, 1)], "a int, b int"), "a", "b").collect()
    assert same["kappa"] is None and same["accuracy"] == 1
    assert rows(agreement.confusion(spark.createDataFrame([(1, 2)], "a int, b int"), "a", "b")) == [(1, 1, 0), (1, 2, 1), (2, 1, 0), (2, 2, 0)]


def test_correlation_guards(spark):
    df = spark.createDataFrame([("ok", 1.0, 2.0), ("ok", 2.0, 1.0), ("ok", 3.0, 5.0), ("ok", 4.0, 6.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("flat", 1.0, 4.0), ("two", 1.0, 1.0), ("two", 2.0, 2.0)], "k string, x double, y double")
    found = {r["k"]: r for r in agreement.correlations(df, "x", "y", ["k"]).collect()}
    assert found["flat"]["pearson"] is None and found["two"]["pearson"] is None and abs(found["ok"]["spearman"] - 0.8) < 1e-12


def test_time_lookups(spark):
    periods = spark.createDataFrame([("h", 5, "a"), ("h", 10, "b"), ("s", 7, "c")], "k string, start int, v string")
    asked = spark.createDataFrame([("h", 3), ("h", 5), ("h", 99), ("s", 1), ("x", 1)], "k string, at int")
    assert rows(windows.as_of(asked, periods, ["k"], "at", "start", "v")) == [("h", 3, "a"), ("h", 5, "a"), ("h", 99, "b"), ("s", 1, "c"), ("x", 1, None)]
    spans = spark.createDataFrame([("h", 1, 5, "p"), ("h", 5, 9, "q")], "k string, a int, b int, who string")
    assert sorted(r["who"] for r in windows.interval_join(asked, spans, ["k"], "at", "a", "b").collect()) == ["p", "p", "q"]


def test_islands_with_null_first(spark):
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate([None, None, "a", "b", "b", "a"])], "g string, i int, v string")
    assert sorted((r["first"], r["last"], r["v"]) for r in windows.islands(df, ["g"], "i", "v").collect()) == [(0, 1, None), (2, 2, "a"), (3, 4, "b"), (5, 5, "a")]


def test_terciles_are_not_ntile(spark):
    df = spark.createDataFrame([(1, i) for i in range(4)], "g int, v int")
    assert [r["tercile"] for r in windows.tercile_by_order(df, ["g"], [F.col("v")]).orderBy("v").collect()] == [1, 2, 3, 3]


def test_effective_rows(spark):
    df = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, True), ("b", 1, False), ("b", 2, None)], "k string, at int, ok boolean")
    assert rows(windows.effective_rows(df, ["k"], "ok", "at").select("k", "at")) == [("a", 2), ("b", 2)]


def test_runs(spark):
    tries = spark.createDataFrame([("s", "m1", 1, 2.0, None), ("s", "m2", 1, None, "Timeout: x"), ("t", "m1", 1, 1.0, None), ("t", "m2", 1, 3.0, None), ("t", "m2", 2, 9.0, None)], "speech_id string, model string, attempt int, score double, error string")
    assert rows(runs.pending(tries, tries, ["m1", "m2"])) == [("s", "m2")]
    found = {r["speech_id"]: r for r in runs.ensemble(tries, ["score"]).collect()}
    assert found["s"]["score_std"] is None and found["t"]["score_mean"] == 2 and abs(found["t"]["score_std"] - math.sqrt(2)) < 1e-12
    assert rows(runs.run_summary(tries)) == [("m1", 2, 0, 2, 0), ("m2", 3, 1, 2, 1)]


def test_decompositions_add_up(spark):
    df = spark.createDataFrame([(p, b, float(v)) for p, b, v in [(1, "x", 1), (1, "x", 3), (1, "y", 10), (2, "x", 4), (2, "y", 12), (2, "y", 14), (2, "z", 5)]], "p int, b string, v double")
    parts = decompose.share_mean_change(df, "v", "b", "p", 1, 2, []).collect()
    change = (4 + 12 + 14 + 5) / 4 - 14 / 3
    assert abs(sum(r["agenda"] + r["positions"] for r in parts) - change) < 1e-12
    steps = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.5), (2, "a", 0.3), (2, "c", 0.9)], "p int, u string, v double")
    (step,) = decompose.turnover(steps, "u", "p", "v", []).collect()
    assert abs(step["change"] - (step["within"] + step["entry"] + step["exit"])) < 1e-12 and (step["stayers"], step["exits"], step["entrants"]) == (1, 1, 1)


def test_overlap(spark):
    df = spark.createDataFrame([("g", "a", 1.0), ("g", "a", 2.0), ("g", "b", 2.0), ("g", "b", 3.0)], "g string, s string, v double")
    (r,) = decompose.overlap(df, "v", "s", "a", "b", ["g"]).collect()
    assert r["overlap"] == 0.5 and r["beyond_a"] == 0 and r["median_b"] == 2.5


def test_quotas_and_nested_samples(spark):
    df = spark.createDataFrame([("a", i) for i in range(2)] + [("b", i) for i in range(50)] + [("c", i) for i in range(50)], "s string, i int")
    assert rows(sampling.even_quotas(df, ["s"], 21).select("s", "quota")) == [("a", 2), ("b", 10), ("c", 9)]
    assert sampling.quota_sample(df, ["s"], "i", 21, 1).count() == 21
    small, large = ({tuple(r) for r in sampling.stratified_sample(df, ["s"], "i", n, 3).collect()} for n in (3, 9))
    assert small < large


def test_cluster_draws_have_fixed_size(spark):
    clusters = spark.createDataFrame([("x", i) for i in range(5)] + [("y", 9)], "s string, c int")
    weights = sampling.cluster_weights(clusters, ["s"], "c", 10, 1)
    assert {(r["s"], r["w"]) for r in weights.groupBy("draw", "s").agg(F.sum("weight").alias("w")).collect()} == {("x", 5), ("y", 1)}


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (4, "b")], "k int, v string")
    assert checks.assert_unique(df, ["k"]) is df and checks.assert_domain(df, "v", ["a", "b"]) is df
    assert rows(checks.missing_in_range(df, "k")) == [(3,)]
    for bad in (lambda: checks.assert_unique(df, ["v"]), lambda: checks.assert_domain(df, "v", ["a"]), lambda: checks.assert_dense(df, "k"), lambda: checks.assert_schema(df, []), lambda: checks.join_checked(df, df.filter("k = 1"), ["k"], complete=True)):
        with pytest.raises(checks.IntegrityError):
            bad()
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, None)], "k int, v double, t string")
    assert checks.tables_differ(a, a.withColumn("v", F.col("v") * (1 + 1e-14)), ["k"]).count() == 0
    assert rows(checks.tables_differ(a, a.withColumn("v", F.col("v") + F.col("k") - 1), ["k"])) == [(2,)]


def test_resolution(spark):
    units = spark.createDataFrame([("u1", "NY", "O'Neil-Smith"), ("u2", "NY", "Jones")], "u string, st string, name string")
    people = spark.createDataFrame([("p1", "NY", "SMITH, Ann"), ("p2", "NY", "SMITH, Bob"), ("p3", "CA", "JONES")], "p string, st string, person string")
    pairs = resolve.candidates(units, people, ["st"], "name", "person")
    assert rows(pairs.select("u", "p")) == [("u1", "p1"), ("u1", "p2")]
    assert rows(resolve.resolved(pairs, "u", "p", F.col("person").contains("Ann"))) == [("u1", "p1", "tie_break", 2)]
    seats = spark.createDataFrame([("s", "a", "1"), ("s", "a", "2"), ("s", "b", "2"), ("s", "c", "3"), ("s", "d", "3")], "s string, u string, p string")
    assert rows(resolve.eliminate(seats, "u", "p", ["s"]).select("u", "p", "round")) == [("a", "1", 2), ("b", "2", 1)]


def test_speakers(spark):
    terms = spark.createDataFrame([("H", "VAN HOLLEN", ["CHRIS"], "MD", 1, 9, "x"), ("H", "SMITH", ["ANN"], "NY", 1, 9, "y"), ("H", "SMITH", ["BOB"], "WA", 1, 9, "z")], "c string, last string, firsts array<string>, state string, start int, end int, person string")
    asked = spark.createDataFrame([("Van Hollen", 5, None), ("Ann Smith", 5, None), ("Smith", 5, None), ("Smith", 5, "WA"), ("Smith", 99, None), ("Bob Smith", 5, "NY")], "name string, at int, st string").withColumn("c", F.lit("H"))
    found = {(r["name"], r["at"], r["st"]): (r["person"], r["status"]) for r in resolve.resolve_speaker(asked, terms, "name", ["c"], "at", "st").collect()}
    assert found == {("Van Hollen", 5, None): ("x", "matched"), ("Ann Smith", 5, None): ("y", "matched"), ("Smith", 5, None): (None, "ambiguous"), ("Smith", 5, "WA"): ("z", "matched"), ("Smith", 99, None): (None, "no_candidate"), ("Bob Smith", 5, "NY"): (None, "state_mismatch")}


def test_text(spark):
    df = spark.createDataFrame([(1, " a\t b\n c "), (2, "the tax cut and Tax  Cuts; taxes"), (3, None), (4, 'so {"a": "}{", "b": {"c": 1}} end'), (5, "Mr. AB. Hello\nthere.\nMs. CD of Ohio. Bye")], "k int, t string")
    found = {r["k"]: r for r in df.select("k", text.normalise(F.col("t")).alias("n"), text.normalise(F.col("t"), True).alias("u"), text.count_words(F.col("t")).alias("w"), text.count_keywords(F.col("t"), ["tax", "tax cut"], ["tax  cuts"]).alias("h"), text.extract_json("t").alias("j"), text.fold("t").alias("f")).collect()}
    assert found[1]["n"] == "a b  c" and found[1]["u"] == "a b c" and found[1]["w"] == 3
    assert found[2]["h"] == 1 and found[3]["n"] is None and found[3]["j"] is None
    assert found[4]["j"] == '{"a": "}{", "b": {"c": 1}}' and found[2]["f"].startswith("THE TAX")
    parts = text.segments(df.filter("k = 5"), "k", r"M[rs]\. ([A-Z]+)(?: of \w+)?\. ", "t").orderBy("place").collect()
    assert [(r["label"], r["body"]) for r in parts] == [("AB", "Hello there."), ("CD", "Bye")]
    hits = text.keyword_context(df.filter("k = 2"), "k", ["tax"], "t", 5).orderBy("start").collect()
    assert [(r["start"], r["hit"], r["snippet"]) for r in hits] == [(4, "tax", "the tax cut "), (16, "Tax", " and Tax  Cut")]
    assert spark.range(1).select(text.cut_and_strip(F.lit("keep <b>this</b> END not this"), ["END", "STOP"], ["<[^>]*>"])).first()[0] == "keep this"
    assert spark.createDataFrame([("É’x",)], "t string").select(text.fold("t")).first()[0] == "E'X"


def test_dates(spark):
    df = spark.createDataFrame([("2001-01-02",), ("2001-01-03",), ("2010-06-01",)], "d string").select(F.to_date("d").alias("d"))
    found = [tuple(map(str, r)) for r in df.select(dates.session_of(F.col("d")), dates.election_day(F.year("d")), dates.session_start(dates.session_of(F.col("d")))).collect()]
    assert found == [("106", "2001-11-06", "1999-01-03"), ("107", "2001-11-06", "2001-01-03"), ("111", "2010-11-02", "2009-01-03")]
    cuts = spark.createDataFrame([(1.0,), (5.0,), (9.0,)], "v double").select(dates.cut(F.col("v"), [0, 5, 9], ["low", "high"]))
    assert [r[0] for r in cuts.collect()] == ["low", "high", None]


def test_panels(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3), ("b", None, 4)], "g string, h string, u int")
    assert ("all", "all", 4) in rows(panels.crosstab(df, "g", "h")) and ("b", "none", 1) in rows(panels.crosstab(df, "g", "h"))
    assert rows(panels.complete_cells(df, ["g", "h"], 1, "u")) == [("a", "x", 1, 1, False), ("a", "y", 1, 1, False), ("b", "x", 1, 1, False), ("b", "y", 0, 0, True)]
    votes = spark.createDataFrame([(1, "D", True), (1, "R", False), (2, "D", True), (2, "R", True), (3, "D", True), (3, "D", False), (3, "R", True)], "r int, p string, y boolean")
    found = {r["r"]: (r["party_unity"], r["bipartisan"], r["no_majority"]) for r in panels.party_votes(votes, "r", "p", F.col("y"), ~F.col("y"), ("D", "R")).collect()}
    assert found == {1: (True, False, False), 2: (False, True, False), 3: (False, False, True)}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1, "t": "x"}\n{"k": 2}\n')
    assert rows(readers.json_lines(spark, str(tmp_path / "a.jsonl"), "k int, t string")) == [(1, "x"), (2, None)]
    with pytest.raises(Exception, match="missing"):
        readers.json_lines(spark, str(tmp_path / "a.jsonl"), "k int, t string", ["t"]).collect()
    (tmp_path / "ids.txt").write_text("# note\na\n\nb\n")
    assert rows(readers.ids_from_text(spark, str(tmp_path / "ids.txt"))) == [("a",), ("b",)]
    df = spark.createDataFrame([(1, 2.0)], "k int, v double")
    sinks.write_once(df, str(tmp_path / "t"))
    with pytest.raises(readers.MissingColumns):
        readers.parquet(spark, str(tmp_path / "t"), ["k", "nope"])
    assert sinks.save_table(df, str(tmp_path / "t"), ["k"]) == "same" and sinks.save_table(df, str(tmp_path / "u"), ["k"]) == "new"
    with pytest.raises(checks.IntegrityError):
        sinks.save_table(df.withColumn("v", F.lit(3.0)), str(tmp_path / "t"), ["k"])
    sinks.replace(df.withColumn("k", F.lit(7)), str(tmp_path / "t"))
    assert rows(spark.read.parquet(str(tmp_path / "t"))) == [(7, 2.0)]
    both = readers.union_with_nulls(spark.createDataFrame([("a", 9)], "speech_id string, icpsr int"), spark.createDataFrame([("b", "t")], "speech_id string, text string"), readers.CORPUS)
    assert both.count() == 2 and both.schema["congress_number"].dataType.simpleString() == "smallint"
    people = spark.createDataFrame([(("B1", 5), ("Ann", "Díaz", None, None), [("sen", "NY", "Democrat", None, None, None, None)])], readers.PERSONS)
    (term,) = readers.persons_to_terms(people).collect()
    assert (term["last"], term["firsts"], term["chamber"]) == ("DIAZ", ["ANN"], "S")


def test_attempt_stream(spark, tmp_path):
    schema = "k string, at int, ok boolean"
    for i, batch in enumerate([[("a", 1, False)], [("a", 2, True), ("b", 1, False)], [("a", 3, True)]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(str(tmp_path / "log"))
        attempts.follow(spark.readStream.schema(schema).json(str(tmp_path / "log")), str(tmp_path / "out"), str(tmp_path / "check"), ["k"], "ok", "at").awaitTermination()
        if i == 2:
            assert rows(spark.read.parquet(str(tmp_path / "out/v=2")).select("k", "at")) == [("a", 2), ("b", 1)]


def test_chi2_tail():
    # Upper 5 % points of chi-squared for 1, 2, 3, 4 and 5 degrees of freedom.
    for df, x in enumerate([3.841459, 5.991465, 7.814728, 9.487729, 11.070498], 1):
        assert abs(designs.chi2_tail(x, df) - 0.05) < 1e-6


def test_block_change(spark):
    data = [(b, p, f"m{i % 6}", 1.0 + (3.0 if (b, p) == ("y", 2) else 0.0) + 0.1 * ((i * 7 + p) % 5)) for b in "xyz" for p in (1, 2) for i in range(30)]
    found = designs.block_change_test(spark.createDataFrame(data, "b string, p int, m string, v double"), "v", "b", "p", 1, 2, "m")
    assert abs(found["changes"]["y"] - found["changes"]["x"] - 3) < 1e-9 and found["p"] < 1e-6 and found["df"] == 2


def test_event_study_recovers_effects(spark):
    effect = {-2: 0.0, -1: 0.0, 0: 0.5, 1: 1.0}
    data = [(f"e{e}", f"u{u}", u % 2, k, 0.3 * u + 0.2 * k * (e + 1) + (u % 2) * effect[k]) for e in range(2) for u in range(8) for k in effect for _ in range(2)]
    df = spark.createDataFrame(data, "e string, u string, t int, k int, v double")
    found = {r["k"]: r["coef"] for r in designs.event_study(df, "v", "k", "t", "u", "e", "u", [-2, -1, 0, 1], -1).collect()}
    assert all(abs(found[k] - effect[k]) < 1e-9 for k in (-2, 0, 1))


def test_payloads(spark):
    df = spark.createDataFrame([(1, '{"type": "debate", "topic": "tax"}'), (2, '{"type": "debate"}'), (3, '{"type": "other", "topic": "tax"}'), (4, '{"type": "x"}'), (5, '{"type": "other", "topic": null}')], "k int, j string")
    found = {r["k"]: (r["type"], r["error"]) for r in payloads.validate_labels(df, "j", "type", ["debate", "other"], "topic", "debate", ["tax"]).collect()}
    assert found[1] == ("debate", None) and found[5] == ("other", None)
    assert [found[k][1] for k in (2, 3, 4)] == ["topic: not in the vocabulary", "topic: only for debate", "type: not in the vocabulary"]
    with pytest.raises(checks.IntegrityError, match="seed"):
        payloads.check_resumable({"seed": 1, "x": 2}, {"seed": 2, "x": 2}, ["seed", "x"])
    rows_ = spark.createDataFrame([("a", 1)], "speech_id string, attempt int")
    assert payloads.carried(rows_, rows_, "speech_id", "r1").first()["carried_from"]["run"] == "r1"


def test_tie_break_match_has_every_candidate(spark, tmp_path):
    suppliers = [(1, 5, 1000.0), (2, 5, 5000.0), (3, 6, 0.0), (4, 7, 0.0), (5, 8, 0.0)]
    customers = [(2, 5, 1100.0), (8, 5, 9000.0), (10, 5, 5200.0), (11, 5, 4700.0), (20, 6, 3000.0), (30, 8, 100.0), (31, 8, 900.0)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    want = []
    for s, nation, balance in suppliers:
        every = [(c, abs(balance - b) < 500) for c, n, b in customers if n == nation]
        near = [c for c, close in every if close]
        if len(every) == 1:
            want.append((s, every[0][0], "unique", 1))
        elif every:
            want.append((s, near[0], "tie_break", len(every)) if len(near) == 1 else (s, None, "ambiguous", len(every)))
    assert [w[2] for w in want] == ["tie_break", "ambiguous", "unique", "tie_break"]
    assert rows(catalog.tie_break_match(spark, str(tmp_path))) == want


def test_dense_gap_check_reads_all_orders(spark, tmp_path):
    # only keys 1 and 51 are 1 modulo 50; the years of the others fill and make gaps
    orders = [(1, "1994-05-01"), (51, "1996-05-01"), (2, "1995-01-01"), (3, "1999-12-31"), (4, "1992-01-01")]
    spark.createDataFrame(orders, "o_custkey long, o_orderdate string").withColumn("o_orderdate", F.to_date("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    assert rows(catalog.dense_gap_check(spark, str(tmp_path))) == [(1993,), (1997,), (1998,)]


def test_resolved_near_is_resolved_without_pairs(spark):
    nan, inf = float("nan"), float("inf")
    values = [None, nan, inf, -inf, 0.0, 0.1, 500.0, 500.1, -500.0, 499.99999999999994, 1000.0, 1800.5, 2300.25, 4000.0]
    # units and persons of several blocks, repeated, without key, block or value
    units = spark.createDataFrame([(None if i % 37 == 0 else i % 31, None if i % 23 == 0 else i % 7, values[i * i % 14]) for i in range(120)], "u long, b int, x double")
    persons = spark.createDataFrame([(None if i % 19 == 0 else i % 17, None if i % 13 == 0 else i * i % 11, values[(i * 5 + 3) % 14]) for i in range(40)] + [(99, 6, 900.0), (98, 20, 1.0)], "p long, b int, y double")
    want = rows(resolve.resolved(units.join(persons, "b"), "u", "p", F.abs(F.col("x") - F.col("y")) < 500).select(F.coalesce("u", F.lit(-1)), F.coalesce("p", F.lit(-1)), "resolved_by", "n_candidates"))
    got = rows(resolve.resolved_near(units, persons, "b", "u", "p", "x", "y", 500).select(F.coalesce("u", F.lit(-1)), F.coalesce("p", F.lit(-1)), "resolved_by", "n_candidates"))
    assert got == want and {w[2] for w in want} >= {"tie_break", "ambiguous"}


def test_tie_break_match_makes_no_row_for_each_pair(spark, tmp_path):
    # one nation, 5,000 suppliers and 400,000 customers: 2,000 million pairs
    spark.range(5_000).select(F.col("id").alias("s_suppkey"), F.lit(1).alias("s_nationkey"), (F.col("id") * 2000.0).alias("s_acctbal")).write.parquet(f"{tmp_path}/supplier.parquet")
    near_first = F.when(F.col("id") == 0, 100.0).otherwise(F.col("id") + 3000.0)
    spark.range(400_000).select(F.col("id").alias("c_custkey"), F.lit(1).alias("c_nationkey"), near_first.alias("c_acctbal")).write.parquet(f"{tmp_path}/customer.parquet")
    late = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        found = {r["s"]: (r["c"], r["resolved_by"], r["n_candidates"]) for r in catalog.tie_break_match(spark, str(tmp_path)).collect()}
    finally:
        late.cancel()
    assert len(found) == 5_000 and found[0] == (0, "tie_break", 400_000) and found[1] == (None, "ambiguous", 400_000)
