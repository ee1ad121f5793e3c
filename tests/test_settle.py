from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tipoff.config import BETS
from tipoff.operators import grid, settle


def frame(spark, data):
    return spark.createDataFrame(data, "prob double, actual double, line double")


def test_settlement_truth_table(spark):
    df = frame(spark, [(0.7, 210.0, 200.0), (0.3, 190.0, 200.0), (0.7, 190.0, 200.0), (0.7, 200.0, 200.0), (0.5, 210.0, 200.0)])
    out = settle.settled(df, 0.60).collect()
    assert [r["label"] for r in out] == [1, 1, -1, 0, None]
    assert [round(r["pnl"], 9) for r in out] == [0.9, 0.9, -1.0, 0.0, 0.0]


def test_threshold_is_inclusive_and_over_wins_ties(spark):
    out = settle.settled(frame(spark, [(0.5, 210.0, 200.0), (0.6, 190.0, 200.0), (0.4, 190.0, 200.0)]), 0.5).collect()
    assert [r["label"] for r in out] == [1, -1, 1]


def test_roi_counts_pushes_and_winrate_does_not(spark):
    df = frame(spark, [(0.9, 210.0, 200.0), (0.9, 200.0, 200.0)]).withColumn("league", F.lit("x"))
    row = settle.sweep(df, ["league"], replace(BETS, thresholds=(0.6,))).first()
    assert (row["n"], row["winrate"], round(row["roi"], 9)) == (2, 100.0, 45.0)


def test_bootstrap_is_repeatable_and_brackets_the_mean(spark):
    rep = spark.createDataFrame(
        [("a", 0.5, 60, 50, 2), ("b", 0.5, 0, 0, 0)], "league string, threshold double, wins long, losses long, pushes long"
    )
    rep = settle.with_ratios(rep)
    one = {r["league"]: r for r in settle.bootstrap_interval(rep, ["league"]).collect()}
    two = {r["league"]: r for r in settle.bootstrap_interval(rep.repartition(3), ["league"]).collect()}
    assert one == two
    assert one["a"]["roi_ci_low"] < one["a"]["roi"] < one["a"]["roi_ci_high"]
    assert one["b"]["roi_ci_low"] is None


def test_both_bootstraps_agree(spark):
    rep = settle.with_ratios(
        spark.createDataFrame([("a", 0.5, 300, 280, 20)], "league string, threshold double, wins long, losses long, pushes long")
    )
    by_count = settle.bootstrap_interval(rep, ["league"]).first()
    by_index = settle.bootstrap_interval_indexed(rep, ["league", "threshold"], 1500).first()
    assert by_count["roi_ci_low"] == pytest.approx(by_index["roi_ci_low"], abs=1.0)
    assert by_count["roi_ci_high"] == pytest.approx(by_index["roi_ci_high"], abs=1.0)
    spread = 100 * np.std([0.9] * 300 + [-1.0] * 280 + [0.0] * 20) / np.sqrt(600)
    assert by_count["roi_ci_high"] - by_count["roi_ci_low"] == pytest.approx(2 * 1.96 * spread, rel=0.1)


def test_flags(spark):
    data = [(0, 0.0, None), (5, 3.0, 1.0), (5, 3.0, -1.0), (5, -3.0, -9.0)]
    df = spark.createDataFrame(data, "n long, profit double, roi_ci_low double")
    assert [r["flag"] for r in settle.flag(df).collect()] == ["none", "significant", "profit", "loss"]


def test_best_threshold_needs_enough_bets(spark, rows):
    data = [("a", 0.54, 20, 5.0), ("a", 0.56, 9, 50.0), ("a", 0.58, 12, 5.0), ("b", 0.54, 3, 1.0)]
    df = spark.createDataFrame(data, "league string, threshold double, n long, roi double")
    got = rows(grid.best_threshold(df, ["league"], 10), "league", "best_roi", "best_thr", "best_bets")
    assert got == [("a", 5.0, 0.54, 20), ("b", None, None, 0)]


def test_gate_uses_league_minimum(spark, rows):
    data = [("CBA", 0.9), ("ACB", 0.59), ("ACB", 0.40), ("other", 0.54), ("other", 0.53)]
    df = spark.createDataFrame(data, "league string, prob double")
    assert rows(settle.bet_gate(df), "league", "prob") == [("ACB", 0.4), ("other", 0.54)]


def test_pushes_are_dropped_from_labels(spark):
    df = spark.createDataFrame([(200, 200.0), (201, 200.0), (199, 200.0), (5, None), (None, 1.0)], "game_total int, total_line double")
    assert [r["over_hit"] for r in settle.labelled(df).collect()] == [1, 0]


def test_registered_bounds_are_those_of_a_plain_bootstrap(spark):
    from types import SimpleNamespace

    from tipoff.queries.catalog import callables
    from tipoff.queries.registry import QUERIES

    bets = [(0.7, 210.0)] * 300 + [(0.7, 190.0)] * 280 + [(0.7, 200.0)] * 20
    predictions = spark.createDataFrame([("a", p, a, 200.0) for p, a in bets], "league string, prob double, actual double, line double")
    assert "ev3_bootstrap_bounds" in callables()
    rows = QUERIES["ev3_bootstrap_bounds"].run(SimpleNamespace(predictions=predictions)).collect()
    assert {r["threshold"] for r in rows} == set(BETS.thresholds)
    pnl = np.array([0.9] * 300 + [-1.0] * 280 + [0.0] * 20)
    means = 100 * pnl[np.random.default_rng(7).integers(0, 600, (BETS.draws, 600))].mean(axis=1)
    low, high = np.percentile(means, [2.5, 97.5])
    for r in rows:
        assert r["n"] == 600
        assert r["roi_ci_low"] == pytest.approx(low, abs=0.8) and r["roi_ci_high"] == pytest.approx(high, abs=0.8)
