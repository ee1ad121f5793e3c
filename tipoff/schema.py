"""Column types of the stored tables and payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCHES = """
    match_id bigint, external_id string, home_team_id bigint, away_team_id bigint,
    scheduled_at timestamp, season string, tournament_id int, tournament_name string,
    season_type string, status string, home_score_final smallint, away_score_final smallint,
    home_score_regulation smallint, away_score_regulation smallint,
    went_to_overtime boolean, overtime_periods_count smallint,
    total_line double, total_line_open double, total_line_source string,
    total_line_scraped_at timestamp, first_half_line double, second_half_line double,
    has_quarter_breakdown boolean, listing_id string, arena string, attendance int,
    home_is_b2b boolean, away_is_b2b boolean, created_at timestamp, updated_at timestamp
"""

TEAMS = """
    team_id bigint, external_id string, name string, abbreviation string,
    conference string, division string, created_at timestamp
"""

PERIODS = """
    match_id bigint, period_number smallint, period_type string,
    home_score smallint, away_score smallint, q4_includes_ot_points boolean,
    home_fga smallint, away_fga smallint, home_fta smallint, away_fta smallint,
    home_off_reb smallint, away_off_reb smallint, home_turnovers smallint,
    away_turnovers smallint, home_possessions double, away_possessions double,
    home_pace double, away_pace double, period_duration_seconds int
"""

ADVANCED = """
    match_id bigint, team_id bigint, possessions double, true_pace double, turnovers int,
    three_pointers_made int, three_pointers_attempted int,
    offensive_rating double, defensive_rating double, updated_at timestamp
"""

STATISTICS = (
    "array<struct<period:string,groups:array<struct<groupName:string,"
    "statisticsItems:array<struct<name:string,home:string,away:string>>>>>>"
)

SCORE = "map<string,int>"

EVENT = f"""
    id bigint, homeTeam struct<id:bigint,name:string,shortName:string>,
    awayTeam struct<id:bigint,name:string,shortName:string>,
    homeScore {SCORE}, awayScore {SCORE}, startTimestamp bigint,
    season struct<name:string>, status struct<type:string>
"""

_VALUE = "struct<value:string>"
OPPORTUNITIES = f"array<struct<over:{_VALUE},under:{_VALUE},handicap:{_VALUE}>>"
LINE_RESPONSE = (
    "data struct<findPrematchOddsForBookmaker:struct<bookmakerId:string,"
    f"opportunities:{OPPORTUNITIES}>>"
)

#: values an enum-like column may take, compared case-insensitively
ALLOWED = {
    "status": ["SCHEDULED", "LIVE", "FINISHED", "POSTPONED", "CANCELLED"],
    "season_type": ["REGULAR", "PLAYOFFS", "PRESEASON"],
    "period_type": ["QUARTER", "OVERTIME", "GAME"],
}


def unknown_values(df: DataFrame) -> DataFrame:
    """Rows with a value that its column may not take, with ``bad_column`` naming the first such one.

    Columns are those of ``ALLOWED`` that the table has; NULL is allowed.
    """
    bad = [
        F.when(~F.upper(c).isin(values), F.lit(c)) for c, values in ALLOWED.items() if c in df.columns
    ]
    named = df.withColumn("bad_column", F.coalesce(*bad, F.lit(None).cast("string")))
    return named.where(F.col("bad_column").isNotNull())
