"""The two feature tables: score features per contest, and pace features per contest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.config import FEATURES, SCALE, FeatureSettings, ScaleSettings
from tipoff.functions import boxmath
from tipoff.operators import fills
from tipoff.operators.periods import contest_stats, period_summary, target_totals
from tipoff.operators.rolling import lagged_means, lagged_means_by
from tipoff.operators.schedule import days_rest, schedule_load, with_gap
from tipoff.operators.timeline import (
    appearances,
    finish,
    join_halves,
    longest_timeline,
    timeline,
)
from tipoff.operators.venue import venue_gap
from tipoff.plans import columns as names
from tipoff.session import drop_staged, free_shuffles, staged, staged_in_parts, staged_tables, stored_by_parts


def _score_stats(df: DataFrame) -> dict:
    """(home value, away value) of every per-appearance statistic."""
    hs, as_ = F.col("home_score_final"), F.col("away_score_final")
    zero = F.lit(0)
    h1_home = F.coalesce("h_q1", zero) + F.coalesce("h_q2", zero)
    h1_away = F.coalesce("a_q1", zero) + F.coalesce("a_q2", zero)

    def mirrored(home, away):
        return (home, away), (away, home)

    scored_allowed = {
        "q1": mirrored(F.col("h_q1"), F.col("a_q1")),
        "h1": mirrored(h1_home, h1_away),
        "h2": mirrored(hs - h1_home, as_ - h1_away),
        "game": mirrored(hs, as_),
    }
    out = {}
    for part, (scored, allowed) in scored_allowed.items():
        out[f"pts_scored_{part}"] = scored
        out[f"pts_allowed_{part}"] = allowed
    out["win"] = ((hs > as_).cast("double"), (as_ > hs).cast("double"))
    out["pace"] = (F.col("match_home_pace"), F.col("match_away_pace"))
    ratings = boxmath.efficiency_by_opponent(
        hs, as_, *[F.col(c) for c in ("home_poss", "away_poss", "home_tov", "away_tov")]
    )
    for stat in names.RATING_STATS:
        out[stat] = (ratings[f"home_{stat}"], ratings[f"away_{stat}"])
    period_poss = {s: F.when(F.col(f"{s}_poss") >= 1, F.col(f"{s}_poss")) for s in ("home", "away")}

    def box(column):
        return tuple(F.col(f"{s}_{column}") for s in ("home", "away"))

    out["box_ortg"] = box("offensive_rating")
    out["box_drtg"] = box("defensive_rating")
    out["box_true_pace"] = tuple(
        F.coalesce(F.col(f"{s}_possessions"), period_poss[s]) for s in ("home", "away")
    )
    out["box_tpa"] = box("three_pointers_attempted")
    out["box_tpa_rate"] = tuple(
        boxmath.three_point_rate(
            F.col(f"{s}_three_pointers_attempted"), F.col(f"{s}_possessions"), period_poss[s]
        )
        for s in ("home", "away")
    )
    return out


KEEP = (
    "home_team_id",
    "away_team_id",
    "home_score_final",
    "away_score_final",
    "season_type",
    "league",
    "total_line",
    "total_line_open",
    "game_total",
    "q1_total",
    "h1_total",
    "match_home_pace",
    "match_away_pace",
    "has_boxscore",
    "scheduled_at_kept",
)


def _plan(cfg: FeatureSettings) -> dict[str, tuple[tuple[int, ...], int]]:
    """Windows and span of every rolled statistic."""
    plan = {c: (cfg.score_windows, cfg.ema_span) for c in (*names.SCORE_STATS, *names.EXTRA_STATS)}
    plan |= {c: (cfg.score_windows[:1], cfg.ema_span) for c in names.RATING_STATS}
    return plan | {c: (cfg.score_windows[-1:], cfg.ema_span) for c in names.BOX_STATS}


def _score_appearances(
    contests: DataFrame, periods: DataFrame, cfg: FeatureSettings, limits: ScaleSettings
) -> DataFrame:
    """Two rows per contest with all rolled, calendar and venue columns; the home row has the contest's own."""
    base = contests.join(period_summary(periods), "match_id", "left")
    base = target_totals(base).withColumns(
        {
            "has_boxscore": F.coalesce((F.col("home_poss") >= 1).cast("int"), F.lit(0)),
            "scheduled_at_kept": F.col("scheduled_at"),
        }
    )
    stats = _score_stats(base) | {"league": (F.col("league"), F.col("league"))}
    tl = timeline(
        appearances(base, stats, [c for c in KEEP if c != "league"]), limits=limits, longest=longest_timeline(contests)
    )
    tl = schedule_load(tl, cfg)
    tl = venue_gap(tl, "win", "ha_gap", cfg.venue_window)
    plan = _plan(cfg)
    return finish(lagged_means_by(tl, plan)).drop(*plan)


def _score_contests(
    rolled: DataFrame, cfg: FeatureSettings, fit_on: str | None
) -> Callable[[DataFrame], DataFrame]:
    """What makes contests of appearances, both rows of a contest among them; fill and league means are
    those of ``rolled``, all appearances."""
    outputs = [f"{c}_{e}" for c, (ks, span) in _plan(cfg).items() for e in names.suffixes(ks, span)]
    calendar = ["days_rest", "is_b2b", "games_last_short", "games_last_long", "is_high_density"]

    fit_rows = rolled if fit_on is None else rolled.where(fit_on)
    # each contest has one home row among the stored appearances, so the periods are not read again
    level_rows = fit_rows.where(~F.col("is_road"))
    # one row for each league, stored so that it is known to be small: the wide rows stay in place
    levels = staged(fills.league_levels(level_rows, "league", "match_home_pace"), "levels")

    def joined(rows: DataFrame) -> DataFrame:
        keep = [c for c in KEEP if c != "league"]
        wide = join_halves(rows, [*outputs, *calendar, "consecutive_road", "ha_gap"], ["league", *keep])
        wide = wide.withColumnsRenamed(
            {
                "scheduled_at_kept": "scheduled_at",
                "home_ha_gap": "home_fortress_index",
                "away_ha_gap": "away_vulnerability_index",
            }
        ).drop("home_consecutive_road")
        wide = fills.matchup(wide, levels, "league", "pts_scored_game", "pts_allowed_game")
        return wide.withColumns(
            {
                "is_playoff": boxmath.is_type(F.col("season_type"), "playoffs"),
                "rest_diff": F.col("home_days_rest") - F.col("away_days_rest"),
            }
        )

    scored = [
        f"{c}_{e}"
        for c in (*names.SCORE_STATS, *names.EXTRA_STATS)
        for e in names.suffixes(cfg.score_windows, cfg.ema_span)
    ]
    box = [f"{c}_{e}" for c in names.BOX_STATS for e in names.suffixes(cfg.score_windows[-1:], cfg.ema_span)]
    means = staged(fills.side_means(fit_rows, [*scored, *box]), "means")
    every = joined(rolled)
    fit_wide = every if fit_on is None else every.where(fit_on)
    pairs = fit_wide.agg(*[F.avg(c).alias(c) for c in fills.MATCHUP_COLUMNS]).first()
    known = fills.sided_global_means(means, scored)
    known |= {c: pairs[c] for c in fills.MATCHUP_COLUMNS if pairs[c] is not None}
    by_league = staged(fills.sided_league_fills(means, box), "fills")

    def filled(rows: DataFrame) -> DataFrame:
        wide = joined(rows).join(by_league, "league", "left").withColumns(
            {f"{s}_{c}": F.coalesce(f"{s}_{c}", f"_f_{s}_{c}") for s in ("home", "away") for c in box}
        )
        wide = wide.drop(*[f"_f_{s}_{c}" for s in ("home", "away") for c in box]).fillna(known)
        return line_signals(wide)

    return filled


def score_features(
    contests: DataFrame,
    periods: DataFrame,
    cfg: FeatureSettings = FEATURES,
    limits: ScaleSettings = SCALE,
    fit_on: str | None = None,
) -> DataFrame:
    """Every column of ``names.COLUMN_GROUPS`` per contest, with totals and the line.

    One scan of the contests gives both appearances, one partitioning by team serves all
    rolling, calendar and venue columns, and one join by contest puts the sides together. The appearances are written once: the fill means are taken from them before the
    two halves are joined. ``fit_on`` is a SQL condition on ``scheduled_at``, ``league`` or the
    contest id choosing the rows that fill and league means are taken from; the default takes
    all rows, later ones included.
    """
    rolled = staged(_score_appearances(contests, periods, cfg, limits), "score-appearances")
    free_shuffles(rolled.sparkSession)
    return _score_contests(rolled, cfg, fit_on)(rolled)


def stored_score_features(
    contests: DataFrame,
    periods: DataFrame,
    cfg: FeatureSettings = FEATURES,
    limits: ScaleSettings = SCALE,
    fit_on: str | None = None,
    then: Callable[[DataFrame], DataFrame] = lambda table: table.sortWithinPartitions("league"),
) -> DataFrame:
    """The rows of ``score_features``, stored, each task's by league; or what ``then`` makes of each part of them.

    The appearances lie in parts by contest. The sides of one part are joined at a time, and a part goes
    when its contests are stored, so that neither all sides are shuffled at once nor all rows kept twice.
    """
    before = set(staged_tables(contests.sparkSession))
    parts = staged_in_parts(_score_appearances(contests, periods, cfg, limits), "score-appearances", "match_id")
    spark = contests.sparkSession
    free_shuffles(spark)
    rolled = spark.read.schema(next(iter(parts.values())).schema).parquet(*parts)
    made = _score_contests(rolled, cfg, fit_on)
    free_shuffles(spark)
    on_the_way = set(staged_tables(spark)) - before
    out = stored_by_parts(parts, lambda rows: then(made(rows)), "features")
    drop_staged(spark, on_the_way)
    return out


def line_signals(df: DataFrame) -> DataFrame:
    """Closing line, its movement, and recent form against it."""
    return df.withColumns(
        {
            "bookmaker_total_closing": F.col("total_line"),
            "line_movement": F.col("total_line") - F.col("total_line_open"),
            "market_vs_history_delta": F.col("home_pts_scored_game_L5")
            + F.col("away_pts_scored_game_L5")
            - F.col("total_line"),
        }
    )


def pace_features(
    contests: DataFrame,
    periods: DataFrame,
    cfg: FeatureSettings = FEATURES,
    limits: ScaleSettings = SCALE,
) -> DataFrame:
    """Contest statistics with L3/L5/L10 means of both teams, rest, playoff flag and matchup."""
    stats = contest_stats(contests, periods)
    stats = stats.withColumn(
        "is_playoff", (F.col("scheduled_at") >= F.lit(cfg.playoff_start).cast("timestamp")).cast("int")
    )
    # read three times: for the appearances, the contest columns and the levels
    stats = staged(stats, "pace-contests")
    both = {c: (F.col(f"home_{c}"), F.col(f"away_{c}")) for c in names.PACE_STATS}
    rows = appearances(stats, both)
    tl = with_gap(timeline(rows, limits=limits, longest=longest_timeline(contests)))
    tl = tl.with_df(tl.df.withColumn("days_rest", days_rest(F.col("_gap"))).drop("_gap"))
    rolled = finish(lagged_means(tl, names.PACE_STATS, cfg.pace_windows))
    rolled = staged(rolled.drop(*names.PACE_STATS, "scheduled_at", "team_id"), "pace-appearances")
    outputs = [f"{c}_L{w}" for c in names.PACE_STATS for w in cfg.pace_windows]
    # the contest columns are joined back by contest id: carrying them through the team
    # partitioning would move each of them twice
    wide = stats.join(join_halves(rolled, [*outputs, "days_rest"]), "match_id", "inner")
    levels = staged(fills.league_levels(stats, "tournament_name", "home_pace"), "levels")
    return fills.matchup(wide, levels, "tournament_name", "pts_scored", "pts_allowed")


def complete_cases(df: DataFrame, target: str = "q1_avg_pace") -> DataFrame:
    """Rows with all rolled inputs and the target, restricted to inputs, target and order."""
    inputs = names.pace_inputs(df.columns)
    return df.dropna(subset=[*inputs, target]).select("match_id", "scheduled_at", target, *inputs)
