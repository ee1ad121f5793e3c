"""Windows against independent pandas loops, in all three plans (short, blocked, hot)."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tipoff.config import FEATURES, ScaleSettings
from tipoff.operators import rolling, schedule
from tipoff.operators.rolling import lagged_means
from tipoff.operators.timeline import finish, timeline
from tipoff.operators.venue import venue_gap

PLAIN = ScaleSettings()
HOT = ScaleSettings(hot_rows=10)
HOT_WIDE_CELLS = ScaleSettings(hot_rows=10, cell_seconds=40 * 86_400)


def one_team(spark, values, days=2):
    start = dt.datetime(2025, 1, 1)
    data = [
        (1, i, start + dt.timedelta(days=days * i), None if v is None else float(v))
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(data, "team_id long, match_id long, scheduled_at timestamp, pts double")


@pytest.fixture(scope="module")
def skewed(spark):
    """One team with a third of all rows, ties in time, NULL runs and long breaks."""
    rng = np.random.default_rng(5)
    out = []
    for team, n in ((0, 900), (1, 300), (2, 300), (3, 300), (4, 1)):
        day = 0.0
        for i in range(n):
            day += rng.choice([0, 0.4, 1, 2, 3, 30], p=[0.15, 0.2, 0.3, 0.2, 0.1, 0.05])
            gap = 250 < i < 420
            x = None if gap or rng.random() < 0.5 else float(rng.integers(60, 130))
            out.append(
                (
                    team,
                    team * 10_000 + int(rng.permutation(5)[0]) * 1000 + i,
                    dt.datetime(2020, 1, 1) + dt.timedelta(days=float(day)),
                    bool(rng.random() < 0.6),
                    float(rng.integers(60, 130)),
                    x,
                    float(rng.random() < 0.5),
                )
            )
    pdf = pd.DataFrame(
        out, columns=["team_id", "match_id", "scheduled_at", "is_road", "pts", "poss", "win"]
    )
    df = spark.createDataFrame(
        out,
        "team_id long, match_id long, scheduled_at timestamp, is_road boolean, pts double, poss double, win double",
    )
    pdf["poss"] = pdf["poss"].astype(float)
    ordered = pdf.sort_values(["team_id", "scheduled_at", "match_id"]).reset_index(drop=True)
    return df, expected(ordered)


def expected(pdf):
    parts = []
    for _, g in pdf.groupby("team_id"):
        g = g.copy()
        for c in ("pts", "poss"):
            s = g[c].shift(1)
            g[f"{c}_L3"] = s.rolling(3, min_periods=1).mean()
            g[f"{c}_EMA5"] = s.ewm(span=5, min_periods=1).mean()
        t = g["scheduled_at"].tolist()
        gaps = [None] + [(b - a).days for a, b in zip(t, t[1:], strict=False)]
        g["rest"] = [min(max(7 if x is None else x, 0), 21) for x in gaps]
        g["b2b"] = [int(x == 1) for x in gaps]
        for name, n in (("short", 4), ("long", 7)):
            g[name] = [
                sum(1 for j in range(i + 1) if t[i] - t[j] <= dt.timedelta(days=n)) for i in range(len(t))
            ]
        run, streaks = 0, []
        for road, x in zip(g["is_road"], gaps, strict=True):
            run = 0 if x is None or x > 21 else run
            run = run + 1 if road else 0
            streaks.append(run)
        g["streak"] = streaks
        home, away, form = [], [], []
        for road, w in zip(g["is_road"], g["win"], strict=True):
            form.append(np.mean(home[-5:]) - np.mean(away[-5:]) if home and away else np.nan)
            (away if road else home).append(w)
        g["form"] = form
        parts.append(g)
    return pd.concat(parts)


def compare(actual: pd.DataFrame, wanted: pd.DataFrame, columns: dict[str, str]):
    both = actual.merge(wanted, on=["team_id", "match_id"], suffixes=("", "_w"))
    assert len(both) == len(wanted) == len(actual)
    for mine, theirs in columns.items():
        a = both[mine].astype(float).to_numpy()
        w = both[theirs if theirs not in actual.columns else f"{theirs}_w"].astype(float).to_numpy()
        np.testing.assert_allclose(a, w, rtol=1e-9, atol=1e-9, equal_nan=True, err_msg=mine)


@pytest.mark.parametrize("limits", [PLAIN, HOT, HOT_WIDE_CELLS], ids=["plain", "hot", "hot_wide"])
@pytest.mark.parametrize("small_blocks", [False, True])
def test_rolling_matches_pandas(skewed, monkeypatch, limits, small_blocks):
    df, wanted = skewed
    if small_blocks:
        monkeypatch.setattr(rolling, "_block_shape", lambda windows, span: (120, 100))
    tl = timeline(df, limits=limits)
    assert tl.hot == (limits is not PLAIN)
    out = finish(lagged_means(tl, ["pts", "poss"], [3], 5)).toPandas()
    cols = {f"{c}_{e}": f"{c}_{e}" for c in ("pts", "poss") for e in ("L3", "EMA5")}
    compare(out, wanted[["team_id", "match_id", *cols]], cols)


@pytest.mark.parametrize("limits", [PLAIN, HOT, HOT_WIDE_CELLS], ids=["plain", "hot", "hot_wide"])
def test_schedule_and_venue_match_loops(skewed, limits):
    df, wanted = skewed
    tl = schedule.schedule_load(timeline(df, limits=limits))
    tl = venue_gap(tl, "win", "form_gap")
    wanted = wanted[["team_id", "match_id", "rest", "b2b", "short", "long", "streak", "form"]]
    compare(
        finish(tl).toPandas(),
        wanted,
        {
            "days_rest": "rest",
            "is_b2b": "b2b",
            "games_last_short": "short",
            "games_last_long": "long",
            "consecutive_road": "streak",
            "form_gap": "form",
        },
    )


def test_first_game_has_no_history(spark, rows):
    df = one_team(spark, [100, 105, 110, 115, 120, 125])
    out = finish(lagged_means(timeline(df), ["pts"], [3, 5]))
    got = rows(out, "match_id", "pts_L3", "pts_L5")
    assert got[0] == (0, None, None)
    assert got[1][1] == 100.0
    assert got[3][1] == 105.0
    assert got[5][2] == 110.0


def test_exponential_mean_keeps_value_over_gaps(spark, rows):
    df = one_team(spark, [10, None, None, 20, 5, None, 7])
    out = finish(lagged_means(timeline(df), ["pts"], (), 5))
    got = [r[1] for r in rows(out, "match_id", "pts_EMA5", digits=6)]
    assert got == [None, 10.0, 10.0, 10.0, 17.714286, 10.89404, 10.89404]


def test_day_gap_floors(spark, rows):
    at = [dt.datetime(2025, 1, 1, 12), dt.datetime(2025, 1, 3, 11), dt.datetime(2025, 1, 4, 10)]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(at)], "team_id long, match_id long, scheduled_at timestamp")
    tl = schedule.with_gap(timeline(df))
    flag = schedule.back_to_back(F.col("_gap"), FEATURES.rest_max).alias("b")
    assert rows(tl.df.select("match_id", "_gap", flag)) == rows(
        spark.createDataFrame([(0, None, 0), (1, 1, 1), (2, 0, 0)], "match_id int, _gap int, b int")
    )


def test_no_row_sees_itself(spark, rows):
    a = finish(lagged_means(timeline(one_team(spark, [100, 110, 120])), ["pts"], [3], 5))
    b = finish(lagged_means(timeline(one_team(spark, [100, 110, 999])), ["pts"], [3], 5))
    assert rows(a, "match_id", "pts_L3", "pts_EMA5") == rows(b, "match_id", "pts_L3", "pts_EMA5")
