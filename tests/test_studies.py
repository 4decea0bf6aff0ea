import json

import pytest
from pyspark.sql import functions as F

from rostrum.functions import dates, text
from rostrum.operators import bootstrap, checks, corpus, decompose, designs, elections, estimates, evaluation, lifecycle, members, rollcalls
from rostrum.sources import sinks


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_share_mean_change_by_hand(spark):
    # b2 has no rows in the second period: it is taken at the group's own mean
    df = spark.createDataFrame([(1, "b1", 1.0), (1, "b2", 5.0), (2, "b1", 2.0)], "p int, b string, v double")
    found = {r["b"]: r for r in decompose.share_mean_change(df, "v", "b", "p", 1, 2, []).collect()}
    # means 3 and 2, centre 2.5; shares (.5, .5) and (1, 0)
    assert found["b2"]["agenda"] == pytest.approx((5 + 2.5) / 2 * -0.5 + 2.5 * 0.5) and found["b2"]["positions"] == pytest.approx(0.25 * (2.5 - 5))
    assert (found["b2"]["agenda"], found["b2"]["positions"]) == (-0.625, -0.625)
    assert sum(r["total"] for r in found.values()) == pytest.approx(-1.0)


def test_gap_change_and_weights(spark):
    df = spark.createDataFrame([(s, p, b, float(v)) for s, p, b, v in [("R", 1, "x", 2), ("R", 1, "y", 4), ("D", 1, "x", 1), ("R", 2, "x", 5), ("D", 2, "x", 1), ("D", 2, "y", 3)]], "s string, p int, b string, v double")
    found = {(r["component"], r["block"]): r["value"] for r in decompose.gap_change(df, "v", "b", "p", 1, 2, "s", "R", "D", []).collect()}
    assert found["total", "all"] == pytest.approx((5 - 2) - (3 - 1)) and found["positions", "all"] + found["agenda", "all"] == pytest.approx(found["total", "all"])
    twice = df.unionByName(df.filter("b = 'y'"))
    weighed = df.withColumn("w", F.when(F.col("b") == "y", 2.0).otherwise(1.0))
    a, b = (rows(decompose.gap_change(x, "v", "b", "p", 1, 2, "s", "R", "D", [], w).select("component", "block", F.round("value", 9))) for x, w in ((twice, None), (weighed, "w")))
    assert a == b
    steps = decompose.step_changes(df, "v", "b", "p", [("1-2", 1, 2), ("2-1", 2, 1)], "s", "R", "D", []).filter("component = 'total'")
    assert {r["step"]: round(r["value"], 9) for r in steps.collect()} == {"1-2": 1.0, "2-1": -1.0}


def test_turnover_by_membership(spark):
    served = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 2), ("d", 1), ("d", 2)], "u string, p int")
    df = spark.createDataFrame([("a", 1, 0.1), ("b", 1, 0.5), (None, 1, 0.9), ("a", 2, 0.3), ("c", 2, 0.9), (None, 2, 0.6), ("d", 2, 0.3)], "u string, p int, v double")
    (r,) = decompose.turnover(df, "u", "p", "v", [], served, []).collect()
    assert (r["stayers"], r["exits"], r["entrants"]) == (1, 1, 1)  # d stays, although it says nothing in the first period
    assert r["within"] == pytest.approx(0.2) and r["entry"] == pytest.approx((0.9 - 0.3) / 4) and r["exit"] == pytest.approx(-(0.5 - 0.1) / 3)
    assert r["unmatched"] == pytest.approx((0.6 - 0.3) / 4 - (0.9 - 0.1) / 3) and r["change"] == pytest.approx(r["within"] + r["entry"] + r["exit"] + r["unmatched"])
    assert rows(decompose.stayers_without_rows(df, "u", "p", served, [])) == [(1, 2, 1, 0, 0)]
    roles = {(r["u"], r["p"]): (r["as_earlier"], r["as_later"]) for r in decompose.classify_turnover(df, "u", "p", served, []).collect()}
    assert roles["b", 1] == ("exit", "entrant") and roles[None, 1] == ("unmatched", "unmatched") and roles["d", 2] == ("exit", "stayer")


def test_overlap_keeps_its_direction(spark):
    df = spark.createDataFrame([("D", 3.0), ("D", 4.0), ("R", 1.0), ("R", 2.0)], "s string, v double")
    (r,) = decompose.overlap(df, "v", "s", "D", "R", []).collect()
    assert (r["beyond_a"], r["beyond_b"], r["overlap"]) == (1.0, 1.0, 0.0)
    (r,) = decompose.overlap(df.filter("s = 'D'"), "v", "s", "D", "R", []).collect()
    assert r["overlap"] is None and r["beyond_a"] is None


def test_exclusions_are_whole_words(spark):
    one = spark.range(1)
    assert one.select(text.count_keywords(F.lit("the party and Party, art party"), ["party"], ["art"])).first()[0] == 3
    assert one.select(text.count_keywords(F.lit("tea party and party"), ["party"], [r"tea\s+party"])).first()[0] == 1
    assert one.select(text.count_keywords(F.lit("theé the"), ["the"], unicode=True)).first()[0] == 1


def test_small_spread_far_from_zero(spark):
    df = spark.createDataFrame([(c, 1e9 + v) for c, v in [("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", 7.0)]], "c string, v double").withColumn("g", F.lit(1))
    assert estimates.cell_means(df, "v", ["g"], "c").first()["se"] == pytest.approx(2.0)


def test_replace_survives_a_stop(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1,)], "k int").write.parquet(path)
    (tmp_path / "t").rename(tmp_path / "t.old")  # a run stopped between its two renames
    sinks.replace(spark.createDataFrame([(2,)], "k int"), path)
    assert rows(spark.read.parquet(path)) == [(2,)] and not (tmp_path / "t.old").exists()


def test_corpus_build_closes(spark):
    text_ = "word " * 60
    raw = spark.createDataFrame(
        [("1", "20010103", "107a", "D", "NY", "60", text_), ("1", "20010104", "107a", "D", "NY", "60", text_), ("2", "20010105", "107i", "I", "VT", "60", text_), ("3", "20010106", "107c", "I", "ME", " 60 ", text_),
         ("4", "20010107", "107d", "D", " gu", "60", text_), ("5", "20010108", "107x", "X", "NY", "60", text_), ("6", "20010109", "107a", "D", "NY", "49", text_), ("7", "20010109", "107a", "D", "NY", "50", " \n ")],
        "speech_id string, date string, speakerid string, party string, state string, word_count string, text string",
    ).withColumns({"chamber": F.lit("S"), "last_name": F.lit("N"), "congress": F.lit("107")})
    rules = corpus.Rules(delegates=["GU"], excluded=["107x"], corrections={"107c": "R"}, caucus={"107i": "D"})
    built = corpus.build_corpus(raw, rules)
    stats = corpus.build_stats(built).first().asDict()
    assert stats["rows_read"] == 8 and stats["rows_written"] == 3 and sum(v for k, v in stats.items() if k.startswith("dropped_")) == 5
    assert (stats["party_correction"], stats["party_caucus"], str(stats["first_day"]), str(stats["last_day"])) == (1, 1, "2001-01-03", "2001-01-06")
    kept = built.filter("drop_reason is null")
    assert {(r["speech_id"], r["party"], r["party_original"], str(r["date"])) for r in kept.collect()} == {("1", "D", "D", "2001-01-03"), ("2", "D", "I", "2001-01-05"), ("3", "R", "I", "2001-01-06")}
    with pytest.raises(checks.IntegrityError, match="107i"):
        corpus.build_corpus(raw, corpus.Rules(delegates=["GU"], excluded=["107x"], corrections={"107c": "R"}))
    with pytest.raises(checks.IntegrityError):
        corpus.check_full_build(kept, {"limit": None, "rows_written": 4})
    with pytest.raises(checks.IntegrityError):
        corpus.check_full_build(kept, {"limit": 5, "rows_written": 3})
    nested = {r["party"]: r["counts"] for r in corpus.nested_counts(raw, "party", "state").collect()}
    assert nested["I"] == {"ME": 1, "VT": 1}


def test_members(spark):
    served = spark.createDataFrame([("a", 1, "H"), ("a", 2, "S"), ("b", 1, "H"), ("b", 2, "H"), ("b", 3, "H")], "u string, s int, c string")
    left = {(r["u"], r["s"]): r["left"] for r in members.leaves_next(served, served, "u", "s", ["c"], 3).collect()}
    assert left == {("a", 1): True, ("a", 2): True, ("b", 1): False, ("b", 2): False, ("b", 3): None}
    anywhere = {(r["u"], r["s"]): r["last_session"] for r in members.last_session_flag(served, served, "u", "s", 3).collect()}
    assert anywhere["a", 1] is False and anywhere["a", 2] is True
    numbers = spark.createDataFrame([("n1", "p", 1), ("n2", "p", 4), ("n3", "q", 2)], "n string, p string, s int")
    assert rows(members.prior_service(numbers, "n", "p", "s")) == [("n2", "p", 4, 1)]
    terms = spark.createDataFrame([(1, "X"), (2, "X"), (3, "Y")], "s int, name string")
    assert rows(members.term_labels(terms, "name", "s")) == [(1, "X 1-2"), (2, "X 1-2"), (3, "Y 3-3")]
    assert rows(members.pair_labels(terms, "name", "s")) == [(1, "X"), (2, "Y")]
    with pytest.raises(checks.IntegrityError):
        members.pair_labels(terms.filter("s > 1").withColumn("s", F.col("s") - 1), "name", "s")
    band = {r["band"]: r["share"] for r in members.band_shares(spark.createDataFrame([(-0.05,), (0.2,), (None,)], "v double"), "v", [0.1, 0.5], []).collect()}
    assert band == {"0.1": 0.5, "0.5": 1.0}
    assert spark.range(1).select(members.toward(F.lit(0.3), F.lit("D"), "R"), members.two_by_two(F.lit(True), "a", "b", F.lit(False), "c", "d"), members.person_key(F.lit(None).cast("string"), F.lit(7))).first() == (-0.3, "a, d", "icpsr:7")
    line = spark.createDataFrame([(x, y) for x, y in [(1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (4.0, 4.0)]], "x double, y double").withColumn("g", F.lit(1))
    fit = members.hc1_slope(line, "x", "y", ["g"], "b").first()
    assert fit["b"] == pytest.approx(1.0) and fit["b_se"] == pytest.approx(0.0, abs=1e-9)


def test_bootstrap_of_a_table(spark):
    df = spark.createDataFrame([("g", c, float(v)) for c, v in zip("abcdef", (1, 2, 3, 4, 5, 6))], "g string, c string, v double")
    mean = lambda t, draw, w: t.groupBy(draw, "g").agg((F.sum(F.col(w) * F.col("v")) / F.sum(w)).alias("m"))
    table = bootstrap.bootstrap_table(df, mean, ["g"], "c", ["g"], "m", 200, 3)
    r = bootstrap.intervals(table, ["g"]).first()
    assert r["value"] == 3.5 and r["n_draws"] == 200 and 1.8 < r["low"] < 3.0 and 4.0 < r["high"] < 5.3
    assert rows(bootstrap.bootstrap_table(df.repartition(5), mean, ["g"], "c", ["g"], "m", 200, 3)) == rows(table)
    test = bootstrap.bootstrap_wald(table.withColumn("value", F.when(F.col("draw") == -1, F.col("value") - 3.5).otherwise(F.col("value"))), "g")
    assert test["df"] == 1 and test["chi2"] == 0 and test["p"] == 1
    spread = {r["statistic"]: r["value"] for r in bootstrap.weighted_spread(df.withColumns({"w": F.lit(1), "f": F.col("v") > 4}), "v", ["f"], ["g"], "w").collect()}
    assert spread["sd"] == pytest.approx(3.5**0.5) and spread["f"] == pytest.approx(1 / 3)


def test_validation_grid_equals_single_designs(spark):
    data = [(f"u{i % 12}", "R" if i % 2 else "D", 1 + i % 3, float((i * 7) % 11), float((i * 5) % 13)) for i in range(120)]
    df = spark.createDataFrame(data, "u string, side string, s int, score double, bench double")
    grid = bootstrap.validation_grid(df, "score", ["bench"], {"all": F.lit(True), "some": F.col("score") > 3}, {"unit": ["u"]}, [1, 20], "side", ["side", "s"])
    means = df.filter("score > 3").groupBy("u", "side", "s").agg(F.avg("score").alias("x"), F.avg("bench").alias("y"))
    one = {r["statistic"]: r["r"] for r in designs.validation_statistics(means, "x", "y", "side", ["side", "s"]).collect()}
    found = {r["statistic"]: r["r"] for r in grid.filter("sample = 'some' and threshold = 1").collect()}
    assert found.keys() == one.keys() and all(found[k] == pytest.approx(one[k]) for k in one)
    assert grid.filter("threshold = 20 and statistic = 'overall'").first()["n"] == 0


def test_rollcalls(spark):
    raw = spark.createDataFrame([(107, "House", "2001-01-03"), (106, "House", "2000-01-03"), (107, "President", "2001-01-03"), (107, "Senate", "2030-01-01")], "congress int, chamber string, date string")
    assert [(r["congress_number"], r["chamber"]) for r in rollcalls.rollcalls(raw, 107, "2025-12-31", {"House": "H", "Senate": "S"}).collect()] == [(107, "H")]
    calls = spark.createDataFrame([("On Passage", "H R 1", None), ("On Motion to Recommit", "H R 1", None), (None, None, "x")], "q string, b string, d string")
    assert [r[0] for r in calls.select(rollcalls.final_passage(F.col("q"), F.col("b"), "on passage", r"^h\s*r", "recommit")).collect()] == [True, False, False]
    assert [r[0] for r in calls.select(rollcalls.rollcall_text(["q", "b", "d"])).collect()] == ["On Passage | H R 1", "On Motion to Recommit | H R 1", "x"]


def test_elections(spark):
    table = spark.createDataFrame([(1, "R", "D", "D"), (2, "R", "R", "D"), (3, "D", "R", "R")], "session int, president string, house string, senate string")
    cases = elections.flip_cases(table)
    assert rows(cases) == [(1, 2, "H", "D", "R")]
    served = spark.createDataFrame([("a", 1, "H"), ("a", 2, "H"), ("b", 1, "H"), ("c", 1, "H"), ("c", 2, "S")], "u string, s int, c string")
    speeches = spark.createDataFrame([("a", 1, "H", "D", 1.0), ("a", 2, "H", "D", 2.0), ("b", 1, "H", "R", 3.0), ("c", 2, "S", "R", 4.0)], "u string, s int, c string, side string, v double")
    found = elections.flip_rows(speeches, cases, served, "u", "s", "c", "side")
    assert {(r["u"], r["s"], r["after"], r["treated"]) for r in found.collect()} == {("a", 1, False, True), ("a", 2, True, True)}
    terms = spark.createDataFrame([(1, "R"), (2, "R")], "session int, side string")
    holds = spark.createDataFrame([("H", 1, "D"), ("S", 1, "D"), ("H", 2, "R"), ("S", 2, "D")], "chamber string, session int, side string")
    assert [(r["session"], r["constellation"]) for r in elections.constellations(terms, holds, "H", "S").orderBy("session").collect()] == [(1, "divided"), (2, "split")]
    years = spark.createDataFrame([(2002, 2)], "year int, session int")
    assert {(r["chamber"], r["loser"]) for r in elections.outcomes(terms, holds, years).collect()} == {("H", "D"), ("S", None)}
    counties = spark.createDataFrame([("c1", "D", "TOTAL", 60), ("c1", "D", "MAIL", 20), ("c1", "R", "MAIL", 30), ("c1", "R", "DAY", 10)], "county string, party string, mode string, v int").withColumns({"y": F.lit(2020), "st": F.lit("NY")})
    assert elections.state_share(counties, "y", "st", "county", "party", "mode", "v", ("D", "R")).first()["share"] == pytest.approx(0.4)
    effects = spark.createDataFrame([("e1", 0.1), ("e2", 0.2)], "e string, b double")
    sizes = spark.createDataFrame([("e1", "R:after", 3), ("e1", "D:after", 2), ("e2", "D:after", 50)], "e string, cell string, n int")
    noted = {r["e"]: (r["small"], r["note"]) for r in elections.small_cells_note(effects, sizes, ["e"], "cell", 10).collect()}
    assert noted == {"e1": (True, "D:after (n=2); R:after (n=3)"), "e2": (False, None)}
    level = spark.createDataFrame([("D", "D", "D"), ("D", "R", "D"), ("R", "D", "D"), ("R", "R", "D")], "p string, c string, s string").select(elections.power_level("p", "c", "s"))
    assert [r[0] for r in level.collect()] == ["both", "white_house", "chamber", "neither"]


def test_evaluation(spark):
    people = spark.createDataFrame([(i, "a" if i < 30 else "b", i) for i in range(60)], "id int, s string, v int")
    sheet = evaluation.check_sheet(people, ["s"], "id", 20, 6, 5, ["v"])
    picked = sheet.collect()
    assert len(picked) == 20 and [r["overlap"] for r in picked] == [1] * 6 + [0] * 14 and sheet.columns == ["id", "overlap", "v"]
    assert sum(r["id"] < 30 for r in picked) == 10 and picked == evaluation.check_sheet(people.repartition(7), ["s"], "id", 20, 6, 5, ["v"]).collect()
    codes = spark.createDataFrame([(1, "P", "Tax"), (2, "o", None)], "id int, k string, t string")
    assert rows(evaluation.coder_labels(codes, "id", "k", "t", {"p": "policy", "o": "other"}, {"tax": "taxes"}, "policy")) == [(1, "policy", "taxes"), (2, "other", None)]
    with pytest.raises(checks.IntegrityError, match="2"):
        evaluation.coder_labels(codes.withColumn("k", F.lit("p")), "id", "k", "t", {"p": "policy"}, {"tax": "taxes"}, "policy")
    hits = spark.createDataFrame([("l", 1), ("l", 0), ("m", 1)], "l string, c int")
    assert rows(evaluation.precision(hits, "l", "c")) == [("l", 2, 0.5), ("m", 1, 1.0)]
    with pytest.raises(checks.IntegrityError):
        evaluation.precision(hits.withColumn("c", F.lit(2)), "l", "c")
    tagged = evaluation.tagged_samples(people, {"all": F.lit(True), "few": F.col("id") < 5, "none": F.lit(None).cast("boolean")})
    assert {r["sample"]: r["count"] for r in tagged.groupBy("sample").count().collect()} == {"all": 60, "few": 5}
    assert evaluation.flag_table(people, F.col("id") < 30, F.col("s") == "a").first().asDict() == {"both": 30, "first_only": 0, "second_only": 0, "neither": 30, "agreement": 1.0}


def test_runs_and_manifests(spark, tmp_path):
    class Shouting:  # here, so that workers get it by value
        def score(self, prompt):
            if prompt is None:
                raise ValueError("no text")
            return prompt.upper()

    for label, run in (("d100k", "20250102T000000Z"), ("pilot", "20250101T000000Z")):
        (tmp_path / f"{label}_manifest_{run}.json").write_text(json.dumps({"models": ["m"] if label == "pilot" else None}))
    folder = str(tmp_path)
    assert lifecycle.latest_run(folder) == "20250102T000000Z" and lifecycle.label_of(folder, "20250101T000000Z") == "pilot"
    assert lifecycle.models_of(folder, "20250101T000000Z", ["x"]) == ["m"] and lifecycle.models_of(folder, "20250102T000000Z", ["x"]) == ["x"]
    with pytest.raises(checks.IntegrityError):
        lifecycle.label_of(folder, "19990101T000000Z")
    assert lifecycle.match_models({"a": {"name": "x", "mode": "on"}}, {"b": {"name": "x", "mode": "enabled"}}, {"mode": {"1": ["on", "enabled"]}}) == {"a": "b"}
    with pytest.raises(checks.IntegrityError):
        lifecycle.match_models({"a": {"name": "x"}}, {"b": {"name": "y"}}, {})
    out = lifecycle.score_rows(spark.createDataFrame([(1, "a"), (2, None)], "id int, p string"), Shouting, "id", "p", "m", 0, tries=2, pause=0.0)
    assert rows(out) == [(1, "m", "A", None, 1, 0), (2, "m", None, "ValueError: no text", 2, 0)]
    served = spark.createDataFrame([("m", "m-1"), ("m", "m-2")], "model string, served string")
    with pytest.raises(checks.IntegrityError, match="m-2"):
        lifecycle.check_served(served, "model", "served", {"m": "m-1"})
    manifest = lifecycle.new_manifest("r", "l", lifecycle.settings("t {speech_text}", "c", {"n": 1}), "t {speech_text}", 7)
    assert manifest["settings"]["prompt_sha256"] == lifecycle.text_sha256("t {speech_text}")
    assert spark.range(1).select(lifecycle.render("a {speech_text} b", F.lit("$1 \\x"))).first()[0] == "a $1 \\x b"
    ids = spark.createDataFrame([(i, "s") for i in range(9)], "id int, s string")
    assert lifecycle.selected_ids(spark, {"strata": ["s"], "limit": 4, "seed": 1}, ids, "id").count() == 4
    assert lifecycle.stage_record(0, {}, ids, "id", 9, {}, "now")["n_ids"] == 9


def test_scored_run(spark):
    ensemble = spark.createDataFrame([("s1", 0.5), ("s2", 0.0), ("s3", None)], "speech_id string, ideology double")
    models = spark.createDataFrame([("s1", "m", 0.5), ("s1", "n", 0.0), ("s2", "m", 0.0), ("s2", "n", None), ("s3", "m", None)], "speech_id string, model string, score double")
    table = spark.createDataFrame([(f"s{i}", "a", f"m{i}", i) for i in (1, 2, 3, 4)], "speech_id string, source string, member_id string, congress int")
    crosswalk = spark.createDataFrame([("a", "m1", 11), ("a", "m3", None)], "source string, member_id string, icpsr int")
    found = {r["speech_id"]: r for r in lifecycle.scored_run(ensemble, models, table, crosswalk, None, "speech_id", ["source", "member_id"], ["score"]).collect()}
    assert {k: (r["procedural"], r["member_key"]) for k, r in found.items()} == {"s1": (False, "icpsr:11"), "s2": (True, "a:m2"), "s3": (False, "a:m3")}
    with pytest.raises(checks.IntegrityError):
        lifecycle.scored_run(ensemble, models, table.filter("speech_id <> 's1'"), crosswalk, None, "speech_id", ["source", "member_id"], ["score"])
    marked = table.withColumns({"in_validation": F.lit(True), "score": F.col("congress").cast("double") - 1, "label": F.when(F.col("congress") < 3, "policy").when(F.col("congress") == 3, "procedural")})
    assert [lifecycle.validation_rows(marked, r, "score", "label", ["procedural"]).count() for r in ("none", "zero_score", "labels")] == [4, 3, 2]
    with pytest.raises(ValueError, match="unknown"):
        lifecycle.validation_rows(marked, "x", "score", "label", [])


def test_further_functions(spark):
    day = lambda s: F.lit(s).cast("date")
    assert spark.range(1).select(dates.last_complete_session(day("2024-12-01")), dates.last_complete_session(day("2024-11-30")), dates.incomplete_year(day("2024-11-30")), dates.incomplete_year(day("2024-12-01"))).first() == (118, 117, 2024, None)
    assert dates.bin_labels([0, 30, 50]) == ["0-29", "30-49", "50+"]
    assert spark.range(1).select(text.surname_key(F.lit("O'Neil-Smith"))).first()[0] == "ONEILSMITH"
    codes = spark.createDataFrame([("New  York",), ("Québec",), (None,)], "n string").select(text.code_of(F.col("n"), {"NEW YORK": "NY", "QUEBEC": "QC"}))
    assert [r[0] for r in codes.collect()] == ["NY", "QC", None]
    record = "[Pages 1]\nMr. X. Hello there.\n______\n{time} 1200\nMore words.\n______\nNEXT TITLE\nother"
    cleaned = spark.range(1).select(text.clean_record(F.lit(record), r"Mr\. X\. ", r"\{time\} \d+", ["END OF RECORD"], [r"\[Page \w+\]"])).first()[0]
    assert cleaned == "Hello there. More words."
    assert text.keyword_table(spark, {"l": ["a", "b"]}).count() == 2
    assert rows(checks.missing_in_range(spark.createDataFrame([(3,), (6,)], "k int"), "k")) == [(4,), (5,)]
