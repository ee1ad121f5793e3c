"""Possessions, pace and efficiency ratios as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tipoff.config import (
    DEFAULT_SEASON_WEIGHT,
    FREE_THROW_POSSESSION_SHARE,
    MINUTES_BY_PERIOD_TYPE,
    PACE_MINUTES,
    SEASON_TIERS,
)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL on a zero or missing denominator."""
    return a / F.nullif(b, F.lit(0))


def possessions(fga: Column, fta: Column, off_reb: Column, turnovers: Column) -> Column:
    """FGA + 0.44 FTA - OREB + TO; NULL if any input is."""
    return fga + F.lit(FREE_THROW_POSSESSION_SHARE) * fta - off_reb + turnovers


def pace(poss: Column, period_type: Column) -> Column:
    """Possessions per 40 minutes, rounded half-even to 2 digits."""
    minutes = reduce(
        lambda acc, item: F.when(F.upper(period_type) == item[0], F.lit(item[1])).otherwise(acc),
        MINUTES_BY_PERIOD_TYPE.items(),
        F.lit(MINUTES_BY_PERIOD_TYPE["QUARTER"]),
    )
    return F.bround(poss / minutes * PACE_MINUTES, 2)


def mean_of(*cols: Column) -> Column:
    """Row-wise mean over the non-NULL values."""
    count = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in cols])
    return total / F.nullif(count, F.lit(0))


def efficiency_by_opponent(
    home_score: Column,
    away_score: Column,
    home_poss: Column,
    away_poss: Column,
    home_turnovers: Column,
    away_turnovers: Column,
) -> dict[str, Column]:
    """Per-100 ratings where a side's defence is measured on the opponent's possessions."""
    hp = F.when(home_poss >= 1, home_poss)
    ap = F.when(away_poss >= 1, away_poss)
    return {
        "home_ortg": home_score / hp * 100.0,
        "home_drtg": away_score / ap * 100.0,
        "home_tov_rate": home_turnovers / hp * 100.0,
        "home_true_pace": hp,
        "away_ortg": away_score / ap * 100.0,
        "away_drtg": home_score / hp * 100.0,
        "away_tov_rate": away_turnovers / ap * 100.0,
        "away_true_pace": ap,
    }


def efficiency_own(scored: Column, allowed: Column, poss: Column) -> dict[str, Column]:
    """Box-score ratings: both on the team's own possessions. Callers reject ``poss <= 0``."""
    usable = F.when(poss > 0, poss)
    return {
        "possessions": usable,
        "true_pace": usable,
        "offensive_rating": scored / usable * 100.0,
        "defensive_rating": allowed / usable * 100.0,
    }


def three_point_rate(attempts: Column, box_poss: Column, period_poss: Column) -> Column:
    """3-point attempts per 100 possessions; box possessions first, then the period sum."""
    return ratio(attempts, F.coalesce(box_poss, period_poss)) * 100.0


def regulation_points(*periods: Column) -> Column:
    """Sum of the regulation periods; NULL when it is zero."""
    total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p in periods])
    return F.nullif(total, F.lit(0))


def overtime_count(*periods: Column) -> Column:
    return reduce(lambda a, b: a + b, [p.isNotNull().cast("int") for p in periods])


def season_weight(ts: Column) -> Column:
    """Training weight of the calendar month."""
    month = F.month(ts)
    return reduce(
        lambda acc, tier: F.when(month.isin(list(tier[0])), F.lit(tier[1])).otherwise(acc),
        SEASON_TIERS,
        F.lit(DEFAULT_SEASON_WEIGHT),
    )


def is_type(col: Column, name: str) -> Column:
    """Case-insensitive comparison of an enum-like text as 0/1."""
    return F.coalesce((F.lower(col) == name.lower()).cast("int"), F.lit(0))
