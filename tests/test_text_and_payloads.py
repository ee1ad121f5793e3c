from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tipoff.functions import boxmath, parse, text
from tipoff.sources import payloads


def values(spark, column, data, schema="s string"):
    df = spark.createDataFrame([(v,) for v in data], schema)
    return [r[0] for r in df.select(column).collect()]


def test_normaliser(spark):
    names = {
        "BOSTON CELTICS": "boston",
        "Žalgiris": "zalgiris",
        "Fenerbahçe Beko Istanbul": "fenerbahce",
        "Telekom Baskets Bonn": "bonn",
        "BC 49 Berlin": "berlin",
        "EA7 Emporio Armani Milano": "olimpia",
        "Barça Basket": "barcelona",
        "Partizan Mozzart-Bet": "partizan",
        "Nanjing Monkey Kings": "nanjing tongxi",
        "Zhejiang Golden Bulls": "zhejiang guangsha",
        "Śląsk Wrocław": "slask wroclaw",
        "LA Lakers": "los angeles",
        "Shibuya Sunrockers": "shibuya sun rockers",
        "  ": "",
    }
    got = values(spark, text.normalise_name(F.col("s")), names)
    assert got == list(names.values())


def test_ligatures_full_width_and_roman_numbers(spark):
    names = ["ﬁrenze Ｂologna", "ﬁnest Ａthens", "Ⅳ Club", "ﬀ ①"]
    assert values(spark, text.normalise_name(F.col("s")), names) == ["firenze bologna", "finest athens", "iv", "ff"]


def test_similarity(spark):
    pairs = [
        ("boston celtics", "boston celtics", 1.0),
        ("boston celtics", "miami heat", 0.0),
        ("boston celtics", "boston bruins", 0.5),
        ("", "boston", 0.0),
        ("bonn", "bonn rhein sieg", 0.5 + 0.25 / 3),
        ("a b", "a b c", 2 / 3),
    ]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    sim = text.token_similarity(text.tokens(F.col("a")), text.tokens(F.col("b")))
    back = text.token_similarity(text.tokens(F.col("b")), text.tokens(F.col("a")))
    for r, (_, _, want) in zip(df.select(sim.alias("x"), back.alias("y")).collect(), pairs, strict=True):
        assert r["x"] == pytest.approx(want)
        assert r["y"] == pytest.approx(want)


def test_listing_dates(spark):
    today = dt.date(2026, 3, 1)
    cases = {
        "05.11.2025 19:30": dt.datetime(2025, 11, 5, 19, 30),
        "5.1.2024": dt.datetime(2024, 1, 5, 12),
        "28.02. 20:15": dt.datetime(2026, 2, 28, 20, 15),
        "02.03. 20:15": dt.datetime(2025, 3, 2, 20, 15),
        "29.02.": None,
        "31.12.": dt.datetime(2025, 12, 31, 12),
        "32.01.2025": None,
        "Finished": None,
    }
    got = values(spark, parse.listing_timestamp(F.col("s"), today), cases)
    assert got == list(cases.values())


def test_abbreviation(spark):
    assert values(spark, text.abbreviation(F.col("s")), ["Los Angeles Lakers", "Real", "a b c d"]) == ["LAL", "REA", "ABC"]


def test_shot_strictness(spark):
    cases = ["33/73", "14/18 (78%)", " 9 / 24 ", "9/4", "x", "", "3", "5/-1", "14/18(78%)"]
    lenient = F.array(*parse.shot_lenient(F.col("s")))
    strict = F.array(*parse.shot_strict(F.col("s")))
    assert values(spark, lenient, cases) == [
        [33, 73], [14, 18], [9, 24], [9, 4], [0, 0], [0, 0], [0, 0], [5, -1], [0, 0]
    ]
    assert values(spark, parse.shot_attempts(F.col("s")), cases) == [73, 18, 24, 4, None, None, 3, -1, None]
    assert values(spark, strict, cases) == [
        [33, 73], [14, 18], [9, 24], [None, None], [None, None], [None, None], [None, None], [None, None], [14, 18]
    ]


def test_integers(spark):
    assert values(spark, parse.integer(F.col("s")), ["12", " 7 ", "12.5", "-3", "a", None]) == [12, 7, None, -3, None, None]
    assert values(spark, parse.count_of(F.col("s")), ["0", "-3"]) == [0, None]


def test_possessions_and_pace(spark):
    row = spark.range(1).select(
        boxmath.possessions(F.lit(73), F.lit(18), F.lit(11), F.lit(10)).alias("p"),
        boxmath.possessions(F.lit(73), F.lit(None).cast("int"), F.lit(11), F.lit(10)).alias("none"),
        boxmath.pace(F.lit(20.0), F.lit("quarter")).alias("q"),
        boxmath.pace(F.lit(10.0), F.lit("OVERTIME")).alias("o"),
        boxmath.pace(F.lit(80.0), F.lit("GAME")).alias("g"),
    ).first()
    assert (round(row["p"], 6), row["none"], row["q"], row["o"], row["g"]) == (79.92, None, 80.0, 80.0, 80.0)


def test_ratios_survive_zero_and_null(spark):
    cols = boxmath.efficiency_by_opponent(*[F.lit(x) for x in (100, 90, 0.0, 80.0, 5, 6)])
    row = spark.range(1).select(cols["home_ortg"].alias("h"), cols["home_drtg"].alias("d"), cols["away_drtg"].alias("a")).first()
    assert (row["h"], row["d"], row["a"]) == (None, 112.5, None)


def block(period, **metrics):
    items = [{"name": k.replace("_", " "), "home": h, "away": a} for k, (h, a) in metrics.items()]
    return {"period": period, "groups": [{"groupName": "g", "statisticsItems": items}]}


FULL = dict(
    Field_goals=("33/73", "30/70"), Free_throws=("14/18 (78%)", "10/12"), Turnovers=("10", "12"),
    Offensive_rebounds=("11", "9"), Defensive_rebounds=("30", "31"),
)


def stats(spark, *blocks, score=None):
    text_ = json.dumps({"statistics": list(blocks)})
    df = spark.createDataFrame([(1, text_)], "event_id long, payload string")
    score = score or {"period1": 20, "current": 90, "overtime": 7}
    pairs = F.create_map(*[F.lit(x) for kv in score.items() for x in kv])
    return df.select(
        "event_id",
        payloads.parse_statistics(F.col("payload")).alias("statistics"),
        pairs.alias("home_score"),
        pairs.alias("away_score"),
    )


def test_period_rows_prefer_periods(spark):
    out = payloads.period_rows(stats(spark, block("ALL", **FULL), block("1ST", **FULL), block("1OT", **FULL))).collect()
    got = {(r["period_type"], r["period_number"], r["home_score"]) for r in out}
    assert got == {("QUARTER", 1, 20), ("OVERTIME", 1, 7)}
    assert round(out[0]["home_possessions"], 6) == 79.92


def test_full_game_is_a_fallback(spark):
    out = payloads.period_rows(stats(spark, block("ALL", **FULL), block("XX"))).collect()
    assert [(r["period_type"], r["home_score"], r["has_quarter_breakdown"]) for r in out] == [("GAME", 90, False)]
    assert payloads.period_rows(stats(spark, block("ALL"))).count() == 0


def test_later_duplicate_metric_wins_and_zero_attempts_are_missing(spark):
    extra = {"period": "1Q", "groups": [{"groupName": "a", "statisticsItems": [
        {"name": "Field Goals ", "home": "1/2", "away": "0/0"}, {"name": "field goals", "home": "3/9", "away": "0/0"}]}]}
    row = payloads.period_rows(stats(spark, extra)).first()
    assert (row["home_fga"], row["away_fga"]) == (9, None)


def test_strict_statistics_need_every_metric(spark):
    good = dict(FULL)
    good["3-Pointers"] = ("5/20", "7/21")
    ok = payloads.match_statistics(stats(spark, block("ALL", **good))).first()
    assert ok["reject_reason"] is None and ok["home_three_attempted"] == 20
    bad = payloads.match_statistics(stats(spark, block("ALL", **FULL))).first()
    assert bad["reject_reason"] == "home: 3 pointers"
    none = payloads.match_statistics(stats(spark, block("1Q", **good))).first()
    assert none["reject_reason"] == "no full-game block"


def test_overtime_stops_at_first_gap(spark, rows):
    df = stats(spark, score={"period1": 20, "period2": 0, "period5": 5, "period7": 9})
    got = rows(payloads.score_rows(df), "period_type", "period_number", "home_score")
    assert got == [("OVERTIME", 1, 5), ("QUARTER", 1, 20), ("QUARTER", 2, 0)]


def test_sharpest_line(spark, rows):
    def opp(over, under, line):
        return {"over": {"value": over}, "under": {"value": under}, "handicap": {"value": line}}

    data = [
        (1, "16", [opp("1.9", "1.9", "210.5"), opp("1.5", "2.5", "200.5")]),
        (1, "9", [opp("1.9", "1.9", "210.5")]),
        (2, "16", [opp("x", "1.9", "1")]),
        (3, "5", [opp("1.8", "2.0", "180.5"), opp("2.0", "1.8", "190.5")]),
    ]
    answers = [
        (m, json.dumps({"data": {"findPrematchOddsForBookmaker": {"bookmakerId": b, "opportunities": o}}})) for m, b, o in data
    ]
    df = spark.createDataFrame(answers, "match_id long, payload string")
    node = payloads.parse_line_response(F.col("payload"))["data"]["findPrematchOddsForBookmaker"]
    out = payloads.sharpest_lines(
        df.select("match_id", node["bookmakerId"].alias("bookmaker"), node["opportunities"].alias("opportunities"))
    )
    assert rows(out, "match_id", "total_line", "total_line_source") == [(1, 210.5, "16"), (3, 180.5, "5")]


def test_quarter_rows_need_four_scores(spark):
    data = [
        (1, [(20, 18), (0, 21), (25, 22), (30, 30)]),
        (2, [(20, 18), (22, 21)]),
        (3, [(None, 18), (None, 1), (None, 2), (None, 3)]),
    ]
    df = spark.createDataFrame(data, "match_id long, q_scores array<struct<home:int,away:int>>")
    out = payloads.quarter_rows(df).orderBy("period_number").collect()
    assert [(r["match_id"], r["period_number"], r["home_score"]) for r in out] == [
        (1, 1, 20), (1, 2, None), (1, 3, 25), (1, 4, 30)
    ]
