"""Per-period rows to one row per contest."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.functions.boxmath import mean_of, ratio

REGULATION = (1, 2, 3, 4)

BOX_COLUMNS = {
    "home_fga": "home_fga",
    "away_fga": "away_fga",
    "home_fta": "home_fta",
    "away_fta": "away_fta",
    "home_off_reb": "home_off_reb",
    "away_off_reb": "away_off_reb",
    "home_to": "home_turnovers",
    "away_to": "away_turnovers",
    "home_poss": "home_possessions",
    "away_poss": "away_possessions",
}


def regulation_periods(periods: DataFrame) -> DataFrame:
    return periods.where(
        (F.upper("period_type") == "QUARTER") & F.col("period_number").isin(list(REGULATION))
    )


def pivot_scores(periods: DataFrame) -> DataFrame:
    """``h_q1..h_q4`` and ``a_q1..a_q4``, the first non-NULL score of each period."""
    wide = (
        periods.groupBy("match_id")
        .pivot("period_number", list(REGULATION))
        .agg(
            F.first("home_score", ignorenulls=True).alias("h"),
            F.first("away_score", ignorenulls=True).alias("a"),
        )
    )
    return wide.select(
        "match_id",
        *[F.col(f"{p}_{side}").alias(f"{side}_q{p}") for side in ("h", "a") for p in REGULATION],
    )


def period_summary(periods: DataFrame) -> DataFrame:
    """Score pivot, mean pace and NULL-keeping box sums in one aggregation."""

    def score(side: str, p: int):
        cell = F.when(F.col("period_number") == p, F.col(f"{side}_score"))
        return F.first(cell, ignorenulls=True).alias(f"{side[0]}_q{p}")

    return periods.groupBy("match_id").agg(
        *[score(side, p) for side in ("home", "away") for p in REGULATION],
        F.avg("home_pace").alias("match_home_pace"),
        F.avg("away_pace").alias("match_away_pace"),
        F.sum("home_possessions").alias("home_poss"),
        F.sum("away_possessions").alias("away_poss"),
        F.sum("home_turnovers").alias("home_tov"),
        F.sum("away_turnovers").alias("away_tov"),
    )


def mean_pace(periods: DataFrame) -> DataFrame:
    return periods.groupBy("match_id").agg(
        F.avg("home_pace").alias("match_home_pace"), F.avg("away_pace").alias("match_away_pace")
    )


def sum_keep_null(periods: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Sums per contest; a column with no value at all stays NULL."""
    return periods.groupBy("match_id").agg(*[F.sum(src).alias(out) for out, src in columns.items()])


def sum_or_zero(periods: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Sums per contest; a column with no value at all becomes 0."""
    return periods.groupBy("match_id").agg(
        *[F.coalesce(F.sum(src), F.lit(0)).alias(out) for out, src in columns.items()]
    )


def with_fallback(sums: DataFrame, game_rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Full outer join of period sums with full-game rows; the period sum wins when present."""
    fallback = game_rows.select("match_id", *[F.col(c).alias(f"_fb_{c}") for c in columns])
    return sums.join(fallback, "match_id", "full").select(
        "match_id", *[F.coalesce(F.col(c), F.col(f"_fb_{c}")).alias(c) for c in columns]
    )


def game_level(periods: DataFrame) -> DataFrame:
    """Everything the pace model needs per contest, from QUARTER and GAME rows together.

    The period slices, the box sums and the full-game fallback are conditional aggregates of
    a single pass over the period table, where slices joined to each other would need one
    shuffle each. A contest with quarter rows uses their zero-filled sums; one with only a
    full-game row uses that row.
    """
    quarter = F.upper("period_type") == "QUARTER"
    game = F.upper("period_type") == "GAME"
    slices = [
        F.max(F.when(quarter & (F.col("period_number") == p), F.col(f"{side}_{what}"))).alias(
            f"q{p}_{side}_{what}"
        )
        for p in REGULATION
        for what in ("score", "pace")
        for side in ("home", "away")
    ]
    has_quarters = F.max(quarter.cast("int")) == 1
    sums = [
        F.when(has_quarters, F.coalesce(F.sum(F.when(quarter, F.col(src))), F.lit(0)))
        .otherwise(F.max(F.when(game, F.col(src))))
        .alias(out)
        for out, src in BOX_COLUMNS.items()
    ]
    game_pace = [
        F.max(F.when(game, F.col(f"{side}_pace"))).alias(f"_{side}_game_pace")
        for side in ("home", "away")
    ]
    return periods.where(quarter | game).groupBy("match_id").agg(*slices, *sums, *game_pace)


def contest_stats(contests: DataFrame, periods: DataFrame) -> DataFrame:
    """Contest rows with period totals, paces, targets and the per-side inputs of rolling."""
    df = contests.join(game_level(periods), "match_id", "left")
    df = df.withColumns(
        {
            **{
                f"q{p}_total": F.col(f"q{p}_home_score") + F.col(f"q{p}_away_score")
                for p in REGULATION
            },
            **{
                f"q{p}_avg_pace": (F.col(f"q{p}_home_pace") + F.col(f"q{p}_away_pace")) / 2
                for p in REGULATION
            },
            "game_total": F.col("home_score_final") + F.col("away_score_final"),
        }
    )
    game_pace = (F.col("_home_game_pace") + F.col("_away_game_pace")) / 2
    df = df.withColumn(
        "game_avg_pace",
        F.coalesce(mean_of(*[F.col(f"q{p}_avg_pace") for p in REGULATION]), game_pace),
    )
    if not periods.where(F.upper("period_type") == "GAME").isEmpty():
        df = df.withColumn("q1_avg_pace", F.coalesce("q1_avg_pace", "game_avg_pace"))
    sides: dict[str, F.Column] = {}
    for side, other in (("home", "away"), ("away", "home")):
        poss, fga = F.col(f"{side}_poss"), F.col(f"{side}_fga")
        own, opp = F.col(f"{side}_score_final"), F.col(f"{other}_score_final")
        sides[f"{side}_pace"] = F.coalesce(
            mean_of(*[F.col(f"q{p}_{side}_pace") for p in REGULATION]), F.col(f"_{side}_game_pace")
        )
        sides[f"{side}_ft_rate"] = ratio(F.col(f"{side}_fta"), poss)
        sides[f"{side}_to_rate"] = ratio(F.col(f"{side}_to"), poss)
        sides[f"{side}_oreb_rate"] = ratio(F.col(f"{side}_off_reb"), fga)
        sides[f"{side}_pts_per_poss"] = ratio(own, poss)
        sides[f"{side}_pts_scored"] = own
        sides[f"{side}_pts_allowed"] = opp
        sides[f"{side}_win"] = (own > opp).cast("double")
    df = df.withColumns(sides).withColumns(
        {"home_opp_pace": F.col("away_pace"), "away_opp_pace": F.col("home_pace")}
    )
    return df.drop("_home_game_pace", "_away_game_pace")


def target_totals(df: DataFrame) -> DataFrame:
    """Game, first-quarter and first-half totals; the half counts a missing quarter as 0."""
    half = reduce(
        lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in ("h_q1", "h_q2", "a_q1", "a_q2")]
    )
    return df.withColumns(
        {
            "game_total": F.col("home_score_final") + F.col("away_score_final"),
            "q1_total": F.col("h_q1") + F.col("a_q1"),
            "h1_total": half,
        }
    )


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-NULL count per column, with the row count."""
    return df.agg(F.count("*").alias("n_rows"), *[F.count(c).alias(f"n_{c}") for c in columns])
