"""League strength and mean fills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


MATCHUP_COLUMNS = (
    "home_attack_strength",
    "away_attack_strength",
    "home_defense_strength",
    "away_defense_strength",
    "win_rate_diff_L5",
    "expected_matchup_pace",
)


def league_levels(contests: DataFrame, league: str, pace: str | None = None) -> DataFrame:
    """Mean points per team and game, and mean pace, by league.

    An aggregate with map-side combining, not a window over the league: a league may hold a
    third of all contests.
    """
    points = (F.sum("home_score_final") + F.sum("away_score_final")) / (
        F.count("home_score_final") + F.count("away_score_final")
    )
    aggs = [points.alias("league_points")]
    if pace:
        aggs.append(F.avg(pace).alias("league_pace"))
    return contests.groupBy(league).agg(*aggs)


def matchup(
    df: DataFrame, levels: DataFrame, league: str, scored: str, allowed: str
) -> DataFrame:
    """Attack and defence relative to the league, form difference, expected pace."""
    df = df.join(levels, league, "left")
    points = F.nullif(F.col("league_points"), F.lit(0))
    out: dict[str, Column] = {
        "home_attack_strength": F.col(f"home_{scored}_L5") / points,
        "away_attack_strength": F.col(f"away_{scored}_L5") / points,
        "home_defense_strength": F.col(f"home_{allowed}_L5") / points,
        "away_defense_strength": F.col(f"away_{allowed}_L5") / points,
    }
    if {"home_win_L5", "away_win_L5"} <= set(df.columns):
        out["win_rate_diff_L5"] = F.col("home_win_L5") - F.col("away_win_L5")
    if {"home_pace_L5", "away_pace_L5", "league_pace"} <= set(df.columns):
        out["expected_matchup_pace"] = (
            F.col("home_pace_L5") + F.col("away_pace_L5") - F.col("league_pace")
        )
    return df.withColumns(out).drop("league_points", "league_pace")


def fill_global_mean(
    df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None
) -> DataFrame:
    """Replace NULL by the column mean of ``fit_on`` (default: all rows)."""
    means = (df if fit_on is None else fit_on).agg(*[F.avg(c).alias(c) for c in columns]).first()
    known = {c: means[c] for c in columns if means[c] is not None}
    doubles = df.withColumns({c: F.col(c).cast("double") for c in columns})
    return doubles.fillna(known) if known else doubles


def side_means(rows: DataFrame, columns: Sequence[str], league: str = "league") -> DataFrame:
    """Per league and side: row count, and mean and count of each per-appearance column.

    One aggregation over the appearances, before sides are joined; ``home_<c>`` means follow
    from the home rows and ``away_<c>`` means from the road rows.
    """
    return (
        rows.groupBy(league, "is_road").agg(
            F.count("*").alias("_n"),
            *[(F.sum(c) / F.nullif(F.count(c), F.lit(0))).alias(f"_m_{c}") for c in columns],
            *[F.count(c).alias(f"_k_{c}") for c in columns],
        )
    )


def sided_global_means(means: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Mean over all contests of every ``home_<c>`` / ``away_<c>``."""
    sums = means.groupBy("is_road").agg(
        *[
            (F.sum(F.col(f"_m_{c}") * F.col(f"_k_{c}")) / F.nullif(F.sum(f"_k_{c}"), F.lit(0))).alias(c)
            for c in columns
        ]
    )
    sides = {r["is_road"]: r for r in sums.collect()}
    return {
        f"{side}_{c}": sides[road][c]
        for side, road in (("home", False), ("away", True))
        for c in columns
        if road in sides and sides[road][c] is not None
    }


def sided_league_fills(means: DataFrame, columns: Sequence[str], league: str = "league") -> DataFrame:
    """Per league, the fill of every ``home_<c>`` / ``away_<c>``: league mean, else overall.

    The overall mean is the one after the league fill: league means weighted by league rows.
    """
    known = {c: F.col(f"_m_{c}").isNotNull() for c in columns}
    totals = means.groupBy("is_road").agg(
        *[
            (
                F.sum(F.when(known[c], F.col("_n") * F.col(f"_m_{c}")))
                / F.nullif(F.sum(F.when(known[c], F.col("_n"))), F.lit(0))
            ).alias(c)
            for c in columns
        ]
    )
    overall = {r["is_road"]: r for r in totals.collect()}

    def fill(c: str, road: bool) -> Column:
        here = F.max(F.when(F.col("is_road") == road, F.col(f"_m_{c}")))
        rest = overall[road][c] if road in overall else None
        return F.coalesce(here, F.lit(rest).cast("double"))

    fills = [
        fill(c, road).alias(f"_f_{side}_{c}")
        for side, road in (("home", False), ("away", True))
        for c in columns
    ]
    return means.groupBy(league).agg(*fills)


def fill_league_mean(
    df: DataFrame, columns: Sequence[str], league: str, fit_on: DataFrame | None = None
) -> DataFrame:
    """Replace NULL by the league mean; leagues without data take the mean after that fill.

    The second mean equals the league means weighted by league rows, so one aggregate over
    the rows gives both.
    """
    base = df if fit_on is None else fit_on
    per_league = base.groupBy(league).agg(
        F.count("*").alias("_n"), *[F.avg(c).alias(f"_m_{c}") for c in columns]
    )
    everything = Window.partitionBy()

    def overall(c: str) -> Column:
        known = F.col(f"_m_{c}").isNotNull()
        return F.sum(F.when(known, F.col("_n") * F.col(f"_m_{c}"))).over(everything) / F.sum(
            F.when(known, F.col("_n"))
        ).over(everything)

    # one row per league: the unpartitioned window sees leagues, never contests
    fills = per_league.select(
        league, *[F.coalesce(F.col(f"_m_{c}"), overall(c)).alias(f"_f_{c}") for c in columns]
    )
    joined = df.join(fills, league, "left")
    return joined.withColumns(
        {c: F.coalesce(F.col(c), F.col(f"_f_{c}")) for c in columns}
    ).drop(*[f"_f_{c}" for c in columns])


def league_strength(df: DataFrame, league: str, value: str, name: str) -> DataFrame:
    """Mean of ``value`` over the row's league, attached to every row."""
    means = df.groupBy(league).agg(F.avg(value).alias(name))
    return df.join(means, league, "left")
