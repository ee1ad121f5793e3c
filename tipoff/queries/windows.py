"""Window, timeline and side-merge queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tipoff.operators import fills, schedule
from tipoff.operators.rolling import lagged_means
from tipoff.operators.timeline import appearances, finish, rejoin_sides, timeline
from tipoff.operators.venue import venue_gap
from tipoff.queries.registry import as_long, query, rounded
from tipoff.queries.views import sql

W = "PARTITION BY team_id ORDER BY scheduled_at, match_id"
Q = 1 - 2 / 6  # decay of span 5


def ema_sql(column: str, out: str) -> str:
    """Adjusted exponential mean of earlier rows as a ratio of running sums (needs ``rn``)."""
    weight = f"pow({1 / Q!r}, rn)"
    frame = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return (
        f"sum(CASE WHEN {column} IS NOT NULL THEN {column} * {weight} END) OVER {frame} / "
        f"sum(CASE WHEN {column} IS NOT NULL THEN {weight} END) OVER {frame} AS {out}"
    )


@query(
    "entry_matchup_strength",
    sql(
        "contests appearances",
        """
        SELECT c.match_id, c.league,
               round(h.l5, 6) AS home_pts_L5, round(a.l5, 6) AS away_pts_L5,
               round(h.l5 / l.pts, 6) AS home_attack_strength,
               round(a.l5 / l.pts, 6) AS away_attack_strength
        FROM contests c
        LEFT JOIN rolled h ON h.match_id = c.match_id AND NOT h.is_road
        LEFT JOIN rolled a ON a.match_id = c.match_id AND a.is_road
        LEFT JOIN levels l ON l.league = c.league
        """,
        rolled=f"SELECT match_id, is_road, avg(pts) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS l5 FROM appearances",
        levels="SELECT league, avg(pts) AS pts FROM appearances GROUP BY league",
    ),
)
def matchup_strength(d):
    rows = d.appearances("pts", keep=("league",))
    rolled = finish(lagged_means(timeline(rows), ["pts"], [5]))
    wide = rejoin_sides(rolled, ["pts_L5"], keep=("league",))
    levels = fills.league_levels(d.contests, "league")
    joined = wide.join(levels, "league", "left")
    out = joined.select(
        "match_id",
        "league",
        "home_pts_L5",
        "away_pts_L5",
        (F.col("home_pts_L5") / F.col("league_points")).alias("home_attack_strength"),
        (F.col("away_pts_L5") / F.col("league_points")).alias("away_attack_strength"),
    )
    return rounded(
        out, "home_pts_L5", "away_pts_L5", "home_attack_strength", "away_attack_strength"
    )


@query(
    "st1_appearances",
    sql("appearances", "SELECT match_id, team_id, is_road, pts, opp FROM appearances"),
)
def stacked(d):
    return d.appearances("pts", "opp").drop("scheduled_at")


@query(
    "wn1_lagged_rolling_mean",
    sql(
        "appearances",
        f"""
        SELECT match_id, team_id,
               round(avg(pts) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS pts_L3,
               round(avg(pts) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS pts_L5,
               round(avg(pts) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 6) AS pts_L10,
               round(avg(opp) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS opp_L5
        FROM appearances
        """,
    ),
)
def rolling_mean(d):
    tl = timeline(d.appearances("pts", "opp"))
    out = finish(lagged_means(tl, ["pts", "opp"], [3, 5, 10]))
    out = out.select("match_id", "team_id", "pts_L3", "pts_L5", "pts_L10", "opp_L5")
    return rounded(out, "pts_L3", "pts_L5", "pts_L10", "opp_L5")


def _possession_rows(d):
    sums = d.periods.where("period_type = 'QUARTER'").groupBy("match_id").agg(
        F.sum("home_possessions").alias("hp"), F.sum("away_possessions").alias("ap")
    )
    base = d.contests.join(sums, "match_id", "left")
    return appearances(
        base,
        {
            "pts": (F.col("home_score_final"), F.col("away_score_final")),
            "poss": (F.col("hp"), F.col("ap")),
        },
    )


@query(
    "wn2_lagged_exponential_mean",
    sql(
        "contests periods appearances",
        f"""
        SELECT match_id, team_id, round(pts_ema, 6) AS pts_EMA5, round(poss_ema, 6) AS poss_EMA5
        FROM (SELECT match_id, team_id, {ema_sql('pts', 'pts_ema')}, {ema_sql('poss', 'poss_ema')}
              FROM numbered)
        """,
        sums="SELECT match_id, sum(home_possessions) AS hp, sum(away_possessions) AS ap "
        "FROM periods WHERE period_type = 'QUARTER' GROUP BY match_id",
        numbered=f"""
        SELECT a.*, CASE WHEN a.is_road THEN s.ap ELSE s.hp END AS poss,
               row_number() OVER ({W}) AS rn
        FROM appearances a LEFT JOIN sums s USING (match_id)
        """.replace("PARTITION BY team_id ORDER BY scheduled_at, match_id",
                    "PARTITION BY a.team_id ORDER BY a.scheduled_at, a.match_id"),
    ),
)
def exponential_mean(d):
    out = finish(lagged_means(timeline(_possession_rows(d)), ["pts", "poss"], (), 5))
    return rounded(out.select("match_id", "team_id", "pts_EMA5", "poss_EMA5"), "pts_EMA5", "poss_EMA5")


GAP = f"CAST(floor((epoch_us(scheduled_at) - epoch_us(lag(scheduled_at) OVER ({W}))) / 86400000000.0) AS BIGINT)"


@query(
    "wn3_days_rest",
    sql(
        "appearances",
        """
        SELECT match_id, team_id, gap AS raw_rest,
               least(greatest(coalesce(gap, 7), 0), 21) AS days_rest FROM gaps
        """,
        gaps=f"SELECT match_id, team_id, {GAP} AS gap FROM appearances",
    ),
)
def rest_days(d):
    tl = schedule.with_gap(timeline(d.appearances()))
    gap = F.col("_gap")
    out = tl.df.select(
        "match_id",
        "team_id",
        schedule.days_rest(gap).alias("raw_rest"),
        schedule.days_rest(gap, 7, 21).alias("days_rest"),
    )
    return out


@query(
    "wn4_back_to_back",
    sql(
        "appearances",
        """
        SELECT match_id, team_id,
               CAST(CASE WHEN gap = 1 AND gap <= 21 THEN 1 ELSE 0 END AS BIGINT) AS is_b2b FROM gaps
        """,
        gaps=f"SELECT match_id, team_id, {GAP} AS gap FROM appearances",
    ),
)
def back_to_back(d):
    tl = schedule.with_gap(timeline(d.appearances()))
    flag = schedule.back_to_back(F.col("_gap"), 21).cast("bigint")
    return tl.df.select("match_id", "team_id", flag.alias("is_b2b"))


DENSITY = sql(
    "appearances",
    """
    SELECT match_id, team_id,
           CAST(pos - (SELECT count(*) FROM numbered b WHERE b.team_id = n.team_id
                AND b.scheduled_at < n.scheduled_at - INTERVAL 4 DAY) AS BIGINT) AS games_last_short,
           CAST(pos - (SELECT count(*) FROM numbered b WHERE b.team_id = n.team_id
                AND b.scheduled_at < n.scheduled_at - INTERVAL 7 DAY) AS BIGINT) AS games_last_long
    FROM numbered n
    """,
    numbered=f"SELECT match_id, team_id, scheduled_at, row_number() OVER ({W}) AS pos FROM appearances",
)


@query("wn5_trailing_counts", DENSITY)
def trailing(d):
    tl = schedule.trailing_counts(
        timeline(d.appearances()), {"games_last_short": 4, "games_last_long": 7}
    )
    return tl.df.select("match_id", "team_id", "games_last_short", "games_last_long")


@query(
    "wn6_high_density",
    f"SELECT match_id, team_id, CAST(CASE WHEN games_last_short >= 3 THEN 1 ELSE 0 END AS BIGINT) "
    f"AS is_high_density FROM ({DENSITY})",
)
def density(d):
    tl = schedule.schedule_load(timeline(d.appearances()))
    return as_long(tl.df.select("match_id", "team_id", "is_high_density"), "is_high_density")


@query(
    "wn7_road_streak",
    sql(
        "appearances",
        f"""
        SELECT match_id, team_id,
               CAST(CASE WHEN is_road THEN sum(CASE WHEN is_road THEN 1 ELSE 0 END) OVER (
                    PARTITION BY team_id, island ORDER BY scheduled_at, match_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ELSE 0 END AS BIGINT)
               AS consecutive_road
        FROM (SELECT *, sum(CASE WHEN NOT is_road OR gap > 21 OR gap IS NULL THEN 1 ELSE 0 END)
                     OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM gaps)
        """,
        gaps=f"SELECT match_id, team_id, scheduled_at, is_road, {GAP} AS gap FROM appearances",
    ),
)
def streak(d):
    tl = schedule.road_streak(schedule.with_gap(timeline(d.appearances())), "consecutive_road", 21)
    return tl.df.select("match_id", "team_id", "consecutive_road")


@query(
    "wn8_venue_form_gap",
    sql(
        "appearances",
        f"""
        SELECT match_id, team_id,
               round(last_value(CASE WHEN NOT is_road THEN form END IGNORE NULLS) OVER f
                   - last_value(CASE WHEN is_road THEN form END IGNORE NULLS) OVER f, 6) AS ha_gap
        FROM forms
        WINDOW f AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        """,
        forms="""
        SELECT *, avg(CASE WHEN pts > opp THEN 1.0E0 ELSE 0.0E0 END) OVER (
            PARTITION BY team_id, is_road ORDER BY scheduled_at, match_id
            ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS form FROM appearances
        """,
    ),
)
def venue_form(d):
    tl = venue_gap(timeline(d.appearances("win")), "win", "ha_gap")
    return rounded(tl.df.select("match_id", "team_id", "ha_gap"), "ha_gap")


@query(
    "wn9_rest_difference",
    sql(
        "contests appearances",
        """
        SELECT h.match_id, h.rest AS home_days_rest, a.rest AS away_days_rest, h.rest - a.rest AS rest_diff
        FROM rests h JOIN rests a ON a.match_id = h.match_id AND a.is_road AND NOT h.is_road
        """,
        rests=f"SELECT match_id, is_road, least(greatest(coalesce({GAP}, 7), 0), 21) AS rest FROM appearances",
    ),
)
def rest_difference(d):
    tl = schedule.with_gap(timeline(d.appearances()))
    rows = tl.df.withColumn("days_rest", schedule.days_rest(F.col("_gap"), 7, 21))
    wide = rejoin_sides(rows, ["days_rest"])
    return wide.withColumn("rest_diff", F.col("home_days_rest") - F.col("away_days_rest"))


@query(
    "jn3_side_merge",
    sql(
        "appearances",
        """
        SELECT h.match_id, round(h.l3, 6) AS home_pts_L3, round(a.l3, 6) AS away_pts_L3
        FROM rolled h JOIN rolled a ON a.match_id = h.match_id AND a.is_road AND NOT h.is_road
        """,
        rolled=f"SELECT match_id, is_road, avg(pts) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS l3 FROM appearances",
    ),
)
def side_merge(d):
    rolled = finish(lagged_means(timeline(d.appearances("pts")), ["pts"], [3]))
    return rounded(rejoin_sides(rolled, ["pts_L3"]), "home_pts_L3", "away_pts_L3")


EVENT_W = "PARTITION BY user_id ORDER BY ts, event_id"


@query(
    "wn_user_event_timeline",
    f"""
    SELECT event_id, user_id, round(l5, 6) AS value_L5, round(ema, 6) AS value_EMA5,
           CAST(rn - (SELECT count(*) FROM events b WHERE b.user_id = n.user_id
                AND b.ts < n.ts - INTERVAL 7 DAY) AS BIGINT) AS events_last_week
    FROM (SELECT *, avg(value) OVER ({EVENT_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS l5,
                 {ema_sql('value', 'ema').replace(W, EVENT_W)}
          FROM (SELECT *, row_number() OVER ({EVENT_W}) AS rn FROM events)) n
    """,
)
def user_events(d):
    rows = d.table("events").select("event_id", "user_id", "ts", "value")
    tl = timeline(rows, entity=("user_id",), ts="ts", tie="event_id")
    tl = schedule.trailing_counts(tl, {"events_last_week": 7})
    out = finish(lagged_means(tl, ["value"], [5], 5))
    out = out.select("event_id", "user_id", "value_L5", "value_EMA5", "events_last_week")
    return rounded(out, "value_L5", "value_EMA5")
