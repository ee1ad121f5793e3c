"""Scan, filter, dimension join, sink and progress queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tipoff.operators import merge, progress
from tipoff.queries.registry import as_long, query, rounded
from tipoff.queries.views import sql
from tipoff.session import fresh_path
from tipoff.sources import ordered, sinks, tables

SEASON = "1997-01-01"
FINISHED = "home_score_final IS NOT NULL AND away_score_final IS NOT NULL"
LEAGUE = "coalesce(tournament_name, 'NBA')"
GATED = f"{FINISHED} AND has_quarter_breakdown AND scheduled_at >= TIMESTAMP '{SEASON} 00:00:00'"
SIDE_JOINS = (
    "LEFT JOIN advanced ha ON ha.match_id = m.match_id AND ha.team_id = m.home_team_id "
    "LEFT JOIN advanced aa ON aa.match_id = m.match_id AND aa.team_id = m.away_team_id"
)
NAMES = "JOIN teams ht ON ht.team_id = m.home_team_id JOIN teams aw ON aw.team_id = m.away_team_id"


@query(
    "src1_season_contests",
    sql(
        "matches advanced",
        f"""
        SELECT m.match_id, m.home_team_id, m.away_team_id, home_score_final, away_score_final,
               season_type, {LEAGUE} AS league, total_line, total_line_open,
               ha.possessions AS home_possessions, aa.possessions AS away_possessions,
               ha.three_pointers_attempted AS home_three_pointers_attempted,
               aa.three_pointers_attempted AS away_three_pointers_attempted,
               round(ha.offensive_rating, 6) AS home_offensive_rating,
               round(aa.defensive_rating, 6) AS away_defensive_rating
        FROM matches m {SIDE_JOINS} WHERE {GATED}
        """,
    ),
)
def season_contests(d):
    out = tables.season_contests(d.matches, d.advanced, SEASON).select(
        "match_id",
        "home_team_id",
        "away_team_id",
        "home_score_final",
        "away_score_final",
        "season_type",
        "league",
        "total_line",
        "total_line_open",
        "home_possessions",
        "away_possessions",
        "home_three_pointers_attempted",
        "away_three_pointers_attempted",
        "home_offensive_rating",
        "away_defensive_rating",
    )
    return rounded(out, "home_offensive_rating", "away_defensive_rating")


@query(
    "src2_season_periods",
    sql(
        "matches periods",
        f"""
        SELECT p.match_id, CAST(period_number AS BIGINT) AS period_number, home_score, away_score,
               round(home_pace, 6) AS home_pace, round(away_possessions, 6) AS away_possessions,
               home_turnovers
        FROM periods p JOIN matches m ON m.match_id = p.match_id
        WHERE period_type = 'QUARTER' AND period_number IN (1, 2, 3, 4)
          AND scheduled_at >= TIMESTAMP '{SEASON} 00:00:00'
        """,
    ),
)
def season_periods(d):
    out = tables.season_periods(d.periods, d.matches, SEASON).select(
        "match_id",
        "period_number",
        "home_score",
        "away_score",
        "home_pace",
        "away_possessions",
        "home_turnovers",
    )
    return as_long(rounded(out, "home_pace", "away_possessions"), "period_number")


@query(
    "src3_all_contests_with_names",
    sql(
        "matches teams",
        f"""
        SELECT match_id, ht.name AS home_team, aw.name AS away_team, home_score_final,
               away_score_final, went_to_overtime, season, has_quarter_breakdown,
               {LEAGUE} AS tournament_name
        FROM matches m {NAMES} WHERE {FINISHED}
        """,
    ),
)
def all_contests(d):
    return tables.all_contests(d.matches, d.teams).drop(
        "scheduled_at", "home_team_id", "away_team_id"
    )


@query(
    "src3_all_periods",
    sql(
        "periods",
        """
        SELECT match_id, CAST(period_number AS BIGINT) AS period_number, period_type,
               home_fga, away_fta, home_off_reb, away_turnovers
        FROM periods WHERE period_type IN ('QUARTER', 'GAME')
        """,
    ),
)
def all_periods(d):
    out = tables.all_periods(d.periods).select(
        "match_id", "period_number", "period_type", "home_fga", "away_fta", "home_off_reb", "away_turnovers"
    )
    return as_long(out, "period_number")


@query(
    "src5_missing_periods",
    sql(
        "matches teams",
        f"""
        SELECT match_id, external_id, tournament_name, CAST(scheduled_at AS DATE) AS match_date,
               ht.name AS home_team, aw.name AS away_team
        FROM matches m {NAMES}
        WHERE NOT has_quarter_breakdown AND home_score_final IS NOT NULL
          AND tournament_name IN ('1-URGENT', '3-MEDIUM')
          AND (season LIKE '%25/26%' OR season LIKE '%23/24%')
        """,
    ),
)
def missing_periods(d):
    return tables.missing_periods(
        d.matches, d.teams, ["1-URGENT", "3-MEDIUM"], ["2526", "2324", "unknown"]
    )


MISSING_LINES = f"""
SELECT m.match_id, listing_id, {LEAGUE} AS league, CAST(scheduled_at AS DATE) AS match_date,
       ht.name AS home_team, aw.name AS away_team
FROM matches m {NAMES}
WHERE listing_id IS NOT NULL AND total_line IS NULL AND home_score_final IS NOT NULL
  AND {LEAGUE} IN ('NBA', '2-HIGH')
"""


@query("src6_missing_lines", sql("matches teams", MISSING_LINES))
def missing_lines(d):
    return tables.missing_lines(d.matches, d.teams, ["NBA", "2-HIGH"])


@query(
    "sl2_newest_page",
    sql("matches teams", MISSING_LINES + " ORDER BY scheduled_at DESC, m.match_id DESC LIMIT 20 OFFSET 10"),
)
def newest_page(d):
    return tables.missing_lines(d.matches, d.teams, ["NBA", "2-HIGH"], limit=20, offset=10)


@query(
    "src7_missing_listing",
    sql(
        "matches teams",
        f"""
        SELECT match_id, CAST(scheduled_at AS DATE) AS match_date, ht.name AS home_team, aw.name AS away_team
        FROM matches m {NAMES}
        WHERE tournament_name IS NULL AND listing_id IS NULL AND home_score_final IS NOT NULL
        """,
    ),
)
def missing_listing(d):
    return tables.missing_listing(d.matches, d.teams, None)


@query(
    "src8_prefixed_rows",
    sql(
        "matches teams",
        f"""
        SELECT match_id, external_id, CAST(scheduled_at AS DATE) AS match_date,
               ht.name AS home_team, aw.name AS away_team
        FROM matches m {NAMES}
        WHERE tournament_name = '5-LOW' AND external_id LIKE 'fs_%' AND home_score_final IS NOT NULL
        """,
    ),
)
def prefixed_rows(d):
    return tables.prefixed_rows(d.matches, d.teams, "5-LOW")


@query(
    "src9_missing_advanced",
    sql(
        "matches advanced",
        f"""
        SELECT match_id, CAST(external_id AS BIGINT) AS event_id, home_team_id, away_team_id,
               home_score_final, away_score_final
        FROM matches m
        WHERE {LEAGUE} IN ('NBA', '1-URGENT', '2-HIGH')
          AND scheduled_at >= TIMESTAMP '{SEASON} 00:00:00' AND {FINISHED}
          AND regexp_matches(external_id, '^[0-9]+$')
          AND NOT EXISTS (SELECT 1 FROM advanced t WHERE t.match_id = m.match_id)
        """,
    ),
)
def missing_advanced(d):
    return tables.missing_advanced(d.matches, d.advanced, ["NBA", "1-URGENT", "2-HIGH"], SEASON)


@query(
    "pf1_default_league",
    sql("matches", f"SELECT match_id, {LEAGUE} AS league FROM matches"),
)
def default_league(d):
    return d.matches.select("match_id", tables.league_of().alias("league"))


@query(
    "pf2_finished",
    sql("matches", f"SELECT match_id, home_score_final, away_score_final FROM matches WHERE {FINISHED}"),
)
def finished(d):
    return d.matches.where(tables.finished()).select("match_id", "home_score_final", "away_score_final")


@query(
    "pf3_league_specs",
    sql(
        "contests",
        """
        SELECT 'one' AS spec, match_id FROM contests WHERE league IN ('1-URGENT')
        UNION ALL
        SELECT 'rest', match_id FROM contests WHERE league NOT IN ('1-URGENT', '2-HIGH')
        UNION ALL SELECT 'all', match_id FROM contests
        """,
    ),
)
def league_specs(d):
    specs = {"one": (["1-URGENT"], []), "rest": ([], ["1-URGENT", "2-HIGH"]), "all": ([], [])}
    parts = [
        tables.apply_spec(d.contests, inc, exc).select(F.lit(name).alias("spec"), "match_id")
        for name, (inc, exc) in specs.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "pf5_dynamic_predicates",
    sql(
        "matches",
        """
        SELECT season, count(*) AS n FROM matches
        WHERE NOT has_quarter_breakdown AND home_score_final IS NOT NULL
          AND (season LIKE '%24/25%' OR season LIKE '%23/24%') GROUP BY season
        """,
    ),
)
def dynamic_predicates(d):
    found = tables.missing_periods(d.matches, d.teams, None, ["2425", "2324"])
    return found.join(d.matches.select("match_id", "season"), "match_id").groupBy("season").agg(
        F.count("*").alias("n")
    )


@query(
    "pf6_numeric_ids",
    sql("matches", "SELECT match_id FROM matches WHERE regexp_matches(external_id, '^[0-9]+$')"),
)
def numeric_ids(d):
    return d.matches.where(tables.numeric_id()).select("match_id")


@query(
    "pf7_prefixed_ids",
    sql("matches", "SELECT match_id FROM matches WHERE external_id LIKE 'fs_%'"),
)
def prefixed_ids(d):
    return d.matches.where(F.col("external_id").like("fs_%")).select("match_id")


@query(
    "jn1_two_dimension_joins",
    sql(
        "contests teams",
        f"SELECT match_id, ht.name AS home_team, aw.name AS away_team FROM contests m {NAMES}",
    ),
)
def dimension_joins(d):
    return tables.with_team_names(d.contests, d.teams).select("match_id", "home_team", "away_team")


@query(
    "jn2_side_pivot_join",
    sql(
        "contests advanced",
        f"""
        SELECT m.match_id, ha.possessions AS home_possessions, aa.possessions AS away_possessions,
               ha.turnovers AS home_turnovers, aa.turnovers AS away_turnovers
        FROM contests m {SIDE_JOINS}
        """,
    ),
)
def side_pivot(d):
    return tables.join_sides(d.contests, d.advanced, ["possessions", "turnovers"]).select(
        "match_id", "home_possessions", "away_possessions", "home_turnovers", "away_turnovers"
    )


@query(
    "jn7_anti_join",
    sql(
        "contests advanced",
        "SELECT match_id FROM contests c WHERE NOT EXISTS "
        "(SELECT 1 FROM advanced a WHERE a.match_id = c.match_id)",
    ),
)
def anti_join(d):
    return d.contests.select("match_id").join(d.advanced.select("match_id"), "match_id", "left_anti")


@query(
    "jn8_semi_join",
    sql(
        "matches periods",
        "SELECT DISTINCT external_id FROM matches m JOIN periods p ON p.match_id = m.match_id "
        "WHERE external_id IS NOT NULL",
    ),
)
def semi_join(d):
    return progress.existing_ids(d.matches, d.periods)


@query(
    "jn13_merge_sources",
    """
    SELECT user_id, source_order, event_id FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY source_order) AS r FROM (
        SELECT user_id, 0 AS source_order, max(event_id) AS event_id FROM events
        WHERE event_type = 'purchase' GROUP BY user_id
        UNION ALL SELECT user_id, 1, max(event_id) FROM events WHERE event_type = 'signup' GROUP BY user_id
        UNION ALL SELECT user_id, 2, min(event_id) FROM events GROUP BY user_id)) WHERE r = 1
    """,
)
def merged_sources(d):
    events = d.table("events")

    def source(kind, agg):
        df = events if kind is None else events.where(F.col("event_type") == kind)
        return df.groupBy("user_id").agg(agg("event_id").alias("event_id"))

    parts = [source("purchase", F.max), source("signup", F.max), source(None, F.min)]
    return merge.merge_sources(parts, "user_id", ["event_id"])


@query(
    "ag8_enrichment_progress",
    sql(
        "matches advanced",
        f"""
        SELECT league, count(*) FILTER (WHERE num) AS total_scoutable,
               count(*) FILTER (WHERE num AND done) AS enriched,
               count(*) FILTER (WHERE num AND NOT done) AS pending,
               count(*) FILTER (WHERE external_id LIKE 'fs_%') AS listing_only,
               round(100.0E0 * count(*) FILTER (WHERE num AND done)
                     / nullif(count(*) FILTER (WHERE num), 0), 1) AS pct_done
        FROM flagged GROUP BY league
        """,
        flagged=f"""
        SELECT {LEAGUE} AS league, external_id,
               coalesce(regexp_matches(external_id, '^[0-9]+$'), false) AS num,
               EXISTS (SELECT 1 FROM advanced t WHERE t.match_id = m.match_id) AS done
        FROM matches m WHERE {FINISHED}
        """,
    ),
)
def enrichment_progress(d):
    return progress.enrichment_progress(d.matches, d.advanced)


@query(
    "sl6_ordered_progress",
    sql(
        "matches advanced",
        f"""
        SELECT CAST(row_number() OVER (ORDER BY pending DESC, total DESC) AS BIGINT) AS place, league
        FROM (SELECT {LEAGUE} AS league, count(*) FILTER (WHERE num) AS total,
                     count(*) FILTER (WHERE num AND NOT done) AS pending
              FROM (SELECT *, coalesce(regexp_matches(external_id, '^[0-9]+$'), false) AS num,
                           EXISTS (SELECT 1 FROM advanced t WHERE t.match_id = m.match_id) AS done
                    FROM matches m WHERE {FINISHED}) GROUP BY 1)
        """,
    ),
)
def ordered_progress(d):
    from pyspark.sql import Window

    report = progress.enrichment_progress(d.matches, d.advanced)
    # one row per league
    by = Window.orderBy(F.col("pending").desc(), F.col("total_scoutable").desc())
    return report.select(F.row_number().over(by).cast("bigint").alias("place"), "league")


@query(
    "ag16_outcome_counts",
    sql(
        "matches advanced",
        f"""
        SELECT league, outcome, count(*) AS n FROM (
          SELECT {LEAGUE} AS league, CASE WHEN home_score_final IS NULL OR away_score_final IS NULL THEN 'skip'
                 WHEN EXISTS (SELECT 1 FROM advanced t WHERE t.match_id = m.match_id) THEN 'exists'
                 WHEN external_id IS NULL THEN 'error' ELSE 'ok' END AS outcome
          FROM matches m) GROUP BY 1, 2
        """,
    ),
)
def outcome_counts(d):
    done = d.advanced.select("match_id").distinct().withColumn("done", F.lit(True))
    rows = d.matches.join(done, "match_id", "left").select(
        tables.league_of().alias("league"),
        F.when(~tables.finished(), "skip")
        .when(F.col("done"), "exists")
        .when(F.col("external_id").isNull(), "error")
        .otherwise("ok")
        .alias("outcome"),
    )
    return merge.outcome_counts(rows, "league", "outcome")


@query(
    "ag17_table_totals",
    sql(
        "matches teams periods",
        "SELECT 'matches' AS table_name, count(*) AS n FROM matches UNION ALL "
        "SELECT 'teams', count(*) FROM teams UNION ALL SELECT 'periods', count(*) FROM periods",
    ),
)
def table_totals(d):
    return progress.table_totals({"matches": d.matches, "teams": d.teams, "periods": d.periods})


@query(
    "st4_distinct_leagues",
    sql("matches", f"SELECT DISTINCT {LEAGUE} AS league FROM matches"),
)
def distinct_leagues(d):
    return tables.leagues(d.matches.select(tables.league_of().alias("league")))


@query(
    "st5_resolve_leagues",
    sql(
        "contests",
        "SELECT r.league, EXISTS (SELECT 1 FROM contests c WHERE c.league = r.league) AS available "
        "FROM (VALUES ('1-URGENT'), ('3-MEDIUM'), ('unheard of')) r(league)",
    ),
)
def resolved_leagues(d):
    return tables.resolve_leagues(d.contests, ["1-URGENT", "3-MEDIUM", "unheard of"])


# -- sinks: the change set is made of every second advanced row and of new contests -----------

CHANGES = (
    "SELECT match_id, team_id, possessions + 1 AS possessions, turnovers FROM advanced WHERE match_id % 2 = 0 "
    "UNION ALL SELECT match_id, home_team_id, 50.0E0, 3 FROM contests WHERE match_id % 3 = 1"
)


def _changes(d):
    known = d.advanced.where("match_id % 2 = 0").selectExpr(
        "match_id", "team_id", "possessions + 1 AS possessions", "turnovers"
    )
    new = d.contests.where("match_id % 3 = 1").selectExpr(
        "match_id", "home_team_id AS team_id", "50.0E0 AS possessions", "CAST(3 AS BIGINT) AS turnovers"
    )
    return known.unionByName(new)


@query(
    "sl1_ordered_scan",
    sql(
        "matches",
        """
        SELECT match_id, position FROM (
          SELECT match_id, scheduled_at, row_number() OVER (ORDER BY scheduled_at, match_id) AS position FROM matches)
        WHERE scheduled_at >= TIMESTAMP '1996-03-01 00:00:00'
        """,
    ),
)
def ordered_scan(d):
    """Contests since a time with their place in the order of all, from the files that reach it."""
    path = ordered.write_ordered(d.matches, fresh_path(d.spark, "ordered"))
    start = F.lit("1996-03-01").cast("timestamp")
    return ordered.scan_ordered(d.spark, path, start, position="position").select("match_id", "position")


@query(
    "sl1_ordered_periods",
    sql(
        "periods",
        """
        SELECT match_id, period_type, CAST(period_number AS BIGINT) AS period_number,
               row_number() OVER (ORDER BY match_id, period_type, period_number) AS position FROM periods
        """,
    ),
)
def ordered_periods(d):
    """All period rows in the order of their contests."""
    keys = ("match_id", "period_type", "period_number")
    path = ordered.write_ordered(d.periods.select(*keys), fresh_path(d.spark, "ordered"), keys)
    return as_long(ordered.scan_ordered(d.spark, path, key="match_id", position="position"), "period_number")


@query(
    "snk1_csv_round_trip",
    sql("contests", "SELECT match_id, league, home_score_final, total_line FROM contests"),
)
def csv_sink(d):
    return sinks.round_trip_csv(d.contests.select("match_id", "league", "home_score_final", "total_line"))


@query(
    "snk2_keyed_upsert",
    sql(
        "contests advanced",
        """
        SELECT coalesce(a.match_id, c.match_id) AS match_id, coalesce(a.team_id, c.team_id) AS team_id,
               CASE WHEN c.match_id IS NOT NULL THEN c.possessions ELSE a.possessions END AS possessions,
               CASE WHEN a.match_id IS NULL THEN c.turnovers ELSE a.turnovers END AS turnovers,
               a.three_pointers_made,
               CASE WHEN c.match_id IS NOT NULL THEN 2 ELSE 1 END AS updated_at
        FROM advanced a FULL JOIN changes c ON a.match_id = c.match_id AND a.team_id = c.team_id
        """,
        changes=CHANGES,
    ),
)
def keyed_upsert(d):
    base = d.advanced.select("match_id", "team_id", "possessions", "turnovers", "three_pointers_made")
    base = merge.stamped(base, F.lit(1))
    return merge.upsert(base, merge.stamped(_changes(d), F.lit(2)), ["match_id", "team_id"], immutable=["turnovers"])


@query(
    "snk3_replace_by_key",
    sql(
        "periods",
        """
        SELECT match_id, CAST(period_number AS BIGINT) AS period_number, home_score FROM periods
        WHERE match_id NOT IN (SELECT match_id FROM periods WHERE period_type = 'GAME')
        UNION ALL SELECT match_id, 1, home_score * 2 FROM periods WHERE period_type = 'GAME'
        """,
    ),
)
def replace_by_key(d):
    base = as_long(d.periods.select("match_id", "period_number", "home_score"), "period_number")
    new = d.periods.where("period_type = 'GAME'").selectExpr(
        "match_id", "CAST(1 AS BIGINT) AS period_number", "home_score * 2 AS home_score"
    )
    return merge.replace_by_key(base, new, ["match_id"])


@query(
    "snk4_insert_absent",
    sql(
        "teams",
        """
        SELECT team_id, name FROM teams
        UNION ALL
        SELECT (SELECT max(team_id) FROM teams) + row_number() OVER (
                   ORDER BY substring(md5(c_name), 1, 3), c_name) AS team_id, c_name
        FROM (SELECT DISTINCT c_name FROM customer) WHERE c_name NOT IN (SELECT name FROM teams)
        """,
    ),
)
def insert_absent(d):
    found = d.table("customer").selectExpr("c_name AS name", "c_custkey AS seen")
    return merge.insert_absent(
        d.teams.select("team_id", "name"), found, "name", ["seen"], "team_id"
    ).select("team_id", "name")


@query(
    "snk5_partial_update",
    sql(
        "contests",
        """
        SELECT match_id, CASE WHEN match_id % 4 = 0 THEN CASE WHEN match_id % 8 = 0 THEN NULL ELSE 200.5E0 END
                              ELSE total_line END AS total_line, total_line_open
        FROM contests
        """,
    ),
)
def partial_update(d):
    base = d.contests.select("match_id", "total_line", "total_line_open")
    change = d.contests.where("match_id % 4 = 0").selectExpr(
        "match_id", "CASE WHEN match_id % 8 = 0 THEN NULL ELSE 200.5E0 END AS total_line"
    )
    return merge.patch(base, change, "match_id", ["total_line"])
