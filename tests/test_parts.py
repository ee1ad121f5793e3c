"""The feature table made part by part, for queries of nearly all its columns."""

from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tipoff.plans import features
from tipoff.queries import features as feature_queries
from tipoff.session import drop_staged, staged_in_parts, staged_tables, stored_by_parts


@pytest.fixture(scope="module")
def given(spark):
    """Contests of two leagues and ten teams, some with quarters and box scores."""
    i = F.col("match_id")
    contests = spark.range(90).withColumnRenamed("id", "match_id").withColumns(
        {
            "scheduled_at": F.timestamp_seconds(1.7e9 + i * 50_000),
            "home_team_id": i % 10,
            "away_team_id": (i + 3) % 10,
            "home_score_final": (70 + i % 11).cast("int"),
            "away_score_final": F.when(i % 17 > 0, 65 + i % 13).cast("int"),
            "league": F.when(i % 5 > 2, "1-URGENT").otherwise("5-LOW"),
            "season_type": F.lit("REGULAR"),
            "total_line": F.when(i % 4 > 0, 140.5 + i % 9),
            "total_line_open": 139.5 + i % 7,
        }
    )
    for side in ("home", "away"):
        for c in ("possessions", "turnovers", "three_pointers_made", "three_pointers_attempted", "offensive_rating", "defensive_rating"):
            contests = contests.withColumn(f"{side}_{c}", F.when(i % 3 == 0, 90.0 + i % 8))
    box = ("score", "fga", "fta", "off_reb", "turnovers", "possessions", "pace")
    values = {f"{s}_{c}": (20 + i % 5 + F.col("period_number")).cast("double") for s in ("home", "away") for c in box}
    rows = contests.where(i % 6 > 0).select("match_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("period_number"))
    return contests, rows.withColumns({"period_type": F.lit("QUARTER"), **values})


def test_parts_give_the_rows_of_the_whole(spark, given, rows):
    before = set(staged_tables(spark))
    out = features.stored_score_features(*given)
    left = set(staged_tables(spark)) - before
    assert [path.rsplit("/", 1)[1].split("-")[0] for path in left] == ["features"]
    want = features.score_features(*given)
    assert out.columns == want.columns and out.count() == 90
    assert rows(out) == rows(want)
    for file in out.inputFiles():
        leagues = [r["league"] for r in spark.read.parquet(file).collect()]
        assert leagues == sorted(leagues)


def test_a_part_goes_when_it_is_stored(spark):
    table = spark.range(40).withColumn("x", F.col("id") * 2)
    parts = staged_in_parts(table, "some", "id")
    assert sum(p.count() for p in parts.values()) == 40 and all(p.count() for p in parts.values())
    there = []

    def made(part):
        there.append(len(set(parts) & set(staged_tables(spark))))
        return part.select("x")

    out = stored_by_parts(parts, made, "made")
    assert there == [4, 3, 2, 1] and not set(parts) & set(staged_tables(spark))
    assert sorted(r["x"] for r in out.collect()) == list(range(0, 80, 2))
    few = staged_in_parts(table.limit(1), "some", "id")
    assert sorted(p.count() for p in few.values()) == [0, 0, 0, 1]
    drop_staged(spark, few)


def test_wide_queries_do_not_shuffle_both_sides_whole(spark, given, monkeypatch):
    def whole(d):
        raise AssertionError("the whole table is joined at once")

    monkeypatch.setattr(feature_queries, "score_table", whole)
    monkeypatch.setattr(feature_queries, "_score_tables", lambda d: given)
    d = SimpleNamespace(spark=spark, sf_dir="parts of a test")
    alone = sorted(map(tuple, feature_queries.model_inputs(d).collect()))
    n = feature_queries.score_table_checked(d)
    assert n.count() == 90 and "Exchange" not in n._jdf.queryExecution().executedPlan().toString()
    assert alone == sorted(map(tuple, feature_queries.model_inputs(d).collect()))
    known = {(r["league"], r["feature"]): r["n"] for r in feature_queries.model_inputs(d).collect()}
    assert known[("1-URGENT", "home_pts_scored_game_L5")] == 36 and known[("5-LOW", "home_pts_scored_game_L5")] == 54
