"""Scans over the stored tables. Filters and column lists reach the reader."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff.config import DEFAULT_LEAGUE, FEATURES, SEASON_PATTERNS
from tipoff.operators.periods import regulation_periods

ADVANCED_COLUMNS = (
    "possessions",
    "turnovers",
    "three_pointers_made",
    "three_pointers_attempted",
    "offensive_rating",
    "defensive_rating",
)


def read_database(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A table of a relational database; pass partition options for a parallel read."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def league_of(column: str = "tournament_name", default: str = DEFAULT_LEAGUE) -> Column:
    return F.coalesce(F.col(column), F.lit(default))


def finished() -> Column:
    return F.col("home_score_final").isNotNull() & F.col("away_score_final").isNotNull()


def join_sides(df: DataFrame, other: DataFrame, columns: Sequence[str], how: str = "left") -> DataFrame:
    """Attach (match, team) rows to contests as ``home_*`` / ``away_*`` columns."""
    for side in ("home", "away"):
        rows = other.select(
            "match_id",
            F.col("team_id").alias(f"{side}_team_id"),
            *[F.col(c).alias(f"{side}_{c}") for c in columns],
        )
        df = df.join(rows, ["match_id", f"{side}_team_id"], how)
    return df


def season_contests(
    matches: DataFrame, advanced: DataFrame, season_start: str = FEATURES.season_start
) -> DataFrame:
    """Finished contests of the season with period rows, box-score columns per side."""
    base = matches.where(
        finished() & F.col("has_quarter_breakdown") & (F.col("scheduled_at") >= F.lit(season_start).cast("timestamp"))
    ).select(
        "match_id",
        "scheduled_at",
        "home_team_id",
        "away_team_id",
        "home_score_final",
        "away_score_final",
        "season_type",
        league_of().alias("league"),
        "total_line",
        "total_line_open",
    )
    return join_sides(base, advanced, ADVANCED_COLUMNS)


def season_periods(
    periods: DataFrame, matches: DataFrame, season_start: str = FEATURES.season_start
) -> DataFrame:
    """Regulation period rows of the season's contests."""
    gate = matches.where(F.col("scheduled_at") >= F.lit(season_start).cast("timestamp")).select("match_id")
    return (
        regulation_periods(periods)
        .join(gate, "match_id", "left_semi")
        .select(
            "match_id",
            "period_number",
            "home_score",
            "away_score",
            "home_pace",
            "away_pace",
            "home_possessions",
            "away_possessions",
            "home_turnovers",
            "away_turnovers",
        )
    )


def with_team_names(matches: DataFrame, teams: DataFrame) -> DataFrame:
    """Inner join to the team dimension for both sides."""
    names = teams.select("team_id", "name")
    for side in ("home", "away"):
        named = names.select(F.col("team_id").alias(f"{side}_team_id"), F.col("name").alias(f"{side}_team"))
        matches = matches.join(named, f"{side}_team_id", "inner")
    return matches


def all_contests(matches: DataFrame, teams: DataFrame) -> DataFrame:
    """Every finished contest with team names."""
    base = matches.where(finished()).select(
        "match_id",
        "scheduled_at",
        "home_team_id",
        "away_team_id",
        "home_score_final",
        "away_score_final",
        "went_to_overtime",
        "season",
        "has_quarter_breakdown",
        league_of().alias("tournament_name"),
    )
    return with_team_names(base, teams)


def all_periods(periods: DataFrame) -> DataFrame:
    """QUARTER and GAME rows of all contests."""
    return periods.where(F.upper("period_type").isin("QUARTER", "GAME"))


def latest(df: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Newest first with optional offset and limit; without either, no sort is made."""
    if not limit and not offset:
        return df
    df = df.orderBy(F.col("scheduled_at").desc(), F.col("match_id").desc())
    df = df.offset(offset) if offset else df
    return df.limit(limit) if limit else df


def _backlog(df: DataFrame, teams: DataFrame, columns: Sequence[str], limit, offset=None) -> DataFrame:
    picked = latest(df, limit, offset)
    return with_team_names(picked, teams).select(
        "match_id", *columns, F.to_date("scheduled_at").alias("match_date"), "home_team", "away_team"
    )


def missing_periods(
    matches: DataFrame,
    teams: DataFrame,
    leagues: Sequence[str] | None = None,
    seasons: Sequence[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Finished contests without period rows, by league list and season codes."""
    df = matches.where(~F.col("has_quarter_breakdown") & F.col("home_score_final").isNotNull())
    if leagues:
        df = df.where(F.col("tournament_name").isin(list(leagues)))
    patterns = [SEASON_PATTERNS[s] for s in seasons or [] if s in SEASON_PATTERNS]
    if patterns:
        df = df.where(reduce(lambda a, b: a | b, [F.col("season").like(p) for p in patterns]))
    return _backlog(df, teams, ["external_id", "tournament_name"], limit)


def missing_lines(
    matches: DataFrame,
    teams: DataFrame,
    leagues: Sequence[str] | None = None,
    limit: int | None = None,
    offset: int | None = None,
) -> DataFrame:
    """Finished contests that have a listing id but no line."""
    df = matches.where(
        F.col("listing_id").isNotNull()
        & F.col("total_line").isNull()
        & F.col("home_score_final").isNotNull()
    ).withColumn("league", league_of())
    if leagues:
        df = df.where(F.col("league").isin(list(leagues)))
    return _backlog(df, teams, ["listing_id", "league"], limit, offset)


def missing_listing(
    matches: DataFrame, teams: DataFrame, league: str | None, limit: int | None = None
) -> DataFrame:
    """Finished contests of a league without a listing id; ``None`` is the unnamed league."""
    named = F.col("tournament_name").isNull() if league is None else F.col("tournament_name") == league
    df = matches.where(named & F.col("listing_id").isNull() & F.col("home_score_final").isNotNull())
    return _backlog(df, teams, [], limit)


def prefixed_rows(matches: DataFrame, teams: DataFrame, league: str) -> DataFrame:
    """Contests of a league whose external id is still a listing id (``_`` is a wildcard)."""
    df = matches.where(
        (F.col("tournament_name") == league)
        & F.col("external_id").like("fs_%")
        & F.col("home_score_final").isNotNull()
    )
    return _backlog(df, teams, ["external_id"], None)


def numeric_id() -> Column:
    return F.col("external_id").rlike("^[0-9]+$")


def missing_advanced(
    matches: DataFrame,
    advanced: DataFrame,
    leagues: Sequence[str],
    season_start: str,
    limit: int = 0,
) -> DataFrame:
    """Finished contests with a numeric id and no box-score row; ``limit <= 0`` means all."""
    df = matches.where(
        league_of().isin(list(leagues))
        & (F.col("scheduled_at") >= F.lit(season_start).cast("timestamp"))
        & finished()
        & numeric_id()
    ).join(advanced.select("match_id"), "match_id", "left_anti")
    return latest(df, limit if limit > 0 else None).select(
        "match_id",
        F.col("external_id").cast("bigint").alias("event_id"),
        "home_team_id",
        "away_team_id",
        "home_score_final",
        "away_score_final",
    )


def resolve_leagues(df: DataFrame, requested: Sequence[str], league: str = "league") -> DataFrame:
    """Requested league names with a flag telling whether the data has them."""
    spark = df.sparkSession
    present = df.select(league).distinct().withColumn("available", F.lit(True))
    asked = spark.createDataFrame([(r,) for r in requested], f"{league} string")
    return asked.join(present, league, "left").select(
        league, F.coalesce("available", F.lit(False)).alias("available")
    )


def leagues(df: DataFrame, league: str = "league") -> DataFrame:
    return df.where(F.col(league).isNotNull()).select(league).distinct().orderBy(league)


def apply_spec(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), league: str = "league") -> DataFrame:
    """League include / exclude lists; an empty include list keeps all leagues."""
    if include:
        df = df.where(F.col(league).isin(list(include)))
    if exclude:
        df = df.where(~F.col(league).isin(list(exclude)))
    return df
