"""What keeps steps small on large tables: rows that stay in place, columns computed once, short batches."""

from __future__ import annotations

import uuid
from dataclasses import replace
from hashlib import md5

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tipoff.config import PACE_TREES
from tipoff.operators import settle, splits
from tipoff.plans import backtest, features
from tipoff.queries import features as feature_queries
from tipoff.session import staged, staged_tables
from tipoff.sources import payloads


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_of_a_contest_are_shuffled_once(data):
    assert planned(data.lines.groupBy("match_id").agg(F.collect_list("q"))).count("Exchange hashpartitioning") == 1


def test_stored_cuts_leave_the_rows_in_place(spark):
    rows = spark.range(200).select(
        F.col("id").alias("match_id"), (F.col("id") % 3).alias("league"), F.timestamp_seconds(F.col("id") * 60).alias("scheduled_at")
    )
    out = splits.split_latest(rows, "league", store=True)
    plan = planned(out)
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    want = {r["match_id"]: r["split"] for r in splits.split_latest(rows, "league").collect()}
    assert {r["match_id"]: r["split"] for r in out.collect()} == want and "test" in want.values()


def test_payloads_are_parsed_once(spark):
    facts = spark.createDataFrame([(1, 10, 11, 80, 70)], "match_id long, home_team_id long, away_team_id long, home_score_final int, away_score_final int")
    rows = spark.createDataFrame([(1, '{"statistics": []}')], "match_id long, payload string")
    box = payloads.match_statistics(rows.withColumn("statistics", payloads.parse_statistics(F.col("payload"))).drop("payload"))
    out = payloads.advanced_rows(box.join(facts, "match_id"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert out.count() == 0 and box.first()["reject_reason"] == "no full-game block"


def test_python_workers_get_short_batches_of_long_texts(spark):
    @F.pandas_udf("long")
    def held(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts))

    rows = spark.range(400, numPartitions=1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    assert rows.select(held("text").alias("n")).agg(F.max("n")).first()[0] < 16_000_000


def test_indexed_bootstrap_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(settle, "POSITIONS", 8)
    wins, losses, pushes, draws = 9, 8, 4, 40
    n = wins + losses + pushes
    report = spark.createDataFrame([("a", wins, losses, pushes), ("b", 0, 0, 0)], "league string, wins long, losses long, pushes long")
    means = []
    for b in range(1, draws + 1):
        at = []
        for i in range(n):
            digest = md5(f"a-{b}-{i // 4}".encode()).hexdigest()
            at.append(int(int(digest[8 * (i % 4) : 8 * (i % 4) + 8], 16) / 2**32 * n))
        means.append((sum(x < wins for x in at) * 0.9 - sum(x >= wins + pushes for x in at)) / n)
    got = {r["league"]: r for r in settle.bootstrap_interval_indexed(report, ["league"], draws).collect()}
    low, high = np.percentile(means, [2.5, 97.5])
    assert (got["a"]["roi_ci_low"], got["a"]["roi_ci_high"]) == pytest.approx((100 * low, 100 * high))
    assert got["b"]["roi_ci_low"] is None


def games(spark, n=60):
    """Contests of two leagues, of ten teams."""
    when = F.timestamp_seconds(F.col("id") * 90_000)
    rows = spark.range(n).select(F.col("id").alias("match_id"), when.alias("scheduled_at"), (F.col("id") % 10).alias("home_team_id"), ((F.col("id") + 3) % 10).alias("away_team_id"))
    return rows.withColumns(
        {
            "home_score_final": (70 + F.col("match_id") % 11).cast("int"),
            "away_score_final": (65 + F.col("match_id") % 13).cast("int"),
            "league": F.when(F.col("match_id") % 2 == 0, "a").otherwise("b"),
        }
    )


def counted(spark, df, column):
    """``df``, and a counter of the times that values of ``column`` are computed."""
    seen = spark.sparkContext.accumulator(0)

    def look(value):
        seen.add(1)
        return value

    return df.withColumn(column, F.udf(look, df.schema[column].dataType)(column)), seen


def quarters(rows):
    out = rows.select("match_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("period_number"))
    box = ("score", "fga", "fta", "off_reb", "turnovers", "possessions", "pace")
    values = {f"{s}_{c}": (20 + F.col("match_id") % 5 + F.col("period_number")).cast("double") for s in ("home", "away") for c in box}
    return out.withColumns({"period_type": F.lit("QUARTER"), **values})


def test_pace_contests_are_computed_once(spark):
    rows, seen = counted(spark, games(spark).withColumnRenamed("league", "tournament_name"), "home_score_final")
    assert features.pace_features(rows, quarters(rows)).count() == 60
    assert seen.value == 60


def test_rows_of_the_pace_model_are_computed_once(spark):
    rows = games(spark).select("match_id", "scheduled_at", (F.col("match_id") % 7).cast("double").alias("x"), (F.col("match_id") % 7 + 90.0).alias("q1_avg_pace"))
    complete, seen = counted(spark, rows, "x")
    _, _, split, _ = backtest.pace_model(complete, trees=replace(PACE_TREES, iterations=2, depth=2, patience=1))
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 48, "test": 12}
    assert seen.value == 60


class _Given:
    """Tables of a folder that no other test reads."""

    def __init__(self, spark, table):
        self.spark, self.sf_dir, self.table = spark, uuid.uuid4().hex, table


def test_features_read_once_are_not_stored(spark, monkeypatch):
    table = games(spark).withColumns({"home_days_rest": F.when(F.col("match_id") % 4 > 0, 1), "home_pts_scored_game_L5": F.lit(80.0)})
    table = table.withColumn("league", F.when(F.col("league") == "a", "1-URGENT").otherwise("5-LOW"))
    given = _Given(spark, table)
    monkeypatch.setattr(feature_queries, "score_table", lambda d: d.table)
    before = set(staged_tables(spark))
    got = {(r["league"], r["feature"]): r["n_known"] for r in feature_queries.group_columns(given).collect()}
    assert got[("1-URGENT", "home_days_rest")] == 15 and got[("5-LOW", "home_days_rest")] == 30
    assert got[("5-LOW", "home_pts_scored_game_L5")] == 30 and set(staged_tables(spark)) == before


def test_kept_features_lie_by_league_and_leave_nothing_else(spark, monkeypatch):
    given = _Given(spark, games(spark))
    monkeypatch.setattr(feature_queries, "score_table", lambda d: staged(d.table, "on-the-way"))
    before = set(staged_tables(spark))
    kept = feature_queries.kept_score_table(given)
    assert [path.rsplit("/", 1)[1].split("-")[0] for path in set(staged_tables(spark)) - before] == ["features"]
    for file in kept.inputFiles():
        leagues = [r["league"] for r in spark.read.parquet(file).collect()]
        assert leagues == sorted(leagues)
    assert kept.count() == 60 and feature_queries.read_once(given) is kept
