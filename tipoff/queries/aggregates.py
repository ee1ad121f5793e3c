"""Period, league, fill and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tipoff.config import BETS, COMBOS, GRID_THRESHOLDS
from tipoff.functions import boxmath
from tipoff.operators import fills, grid, metrics, periods, settle, splits
from tipoff.queries.registry import as_long, query, rounded
from tipoff.queries.views import sql
from tipoff.sources import tables

QUARTERS = "period_type = 'QUARTER' AND period_number IN (1, 2, 3, 4)"


def _pivot(side: str) -> str:
    return ", ".join(
        f"max(CASE WHEN period_number = {p} THEN {side}_score END) AS {side[0]}_q{p}" for p in range(1, 5)
    )


WIDE = f"SELECT match_id, {_pivot('home')}, {_pivot('away')} FROM periods WHERE {QUARTERS} GROUP BY match_id"


@query("ag1_period_pivot", sql("periods", WIDE))
def period_pivot(d):
    return periods.pivot_scores(periods.regulation_periods(d.periods))


@query(
    "jn4_period_slices",
    sql(
        "periods",
        """
        SELECT match_id, max(CASE WHEN n = 1 THEN t END) AS q1_total, max(CASE WHEN n = 2 THEN t END) AS q2_total,
               max(CASE WHEN n = 3 THEN t END) AS q3_total, max(CASE WHEN n = 4 THEN t END) AS q4_total
        FROM (SELECT match_id, period_number AS n, home_score + away_score AS t FROM periods
              WHERE period_type = 'QUARTER') GROUP BY match_id
        """,
    ),
)
def period_slices(d):
    wide = periods.game_level(d.periods.where("period_type = 'QUARTER'"))
    return wide.select(
        "match_id",
        *[
            (F.col(f"q{p}_home_score") + F.col(f"q{p}_away_score")).alias(f"q{p}_total")
            for p in periods.REGULATION
        ],
    )


@query(
    "ag2_mean_pace",
    sql(
        "periods",
        f"SELECT match_id, round(avg(home_pace), 6) AS match_home_pace, "
        f"round(avg(away_pace), 6) AS match_away_pace FROM periods WHERE {QUARTERS} GROUP BY match_id",
    ),
)
def mean_pace(d):
    out = periods.mean_pace(periods.regulation_periods(d.periods))
    return rounded(out, "match_home_pace", "match_away_pace")


@query(
    "ag3_sum_keeping_null",
    sql(
        "periods",
        f"SELECT match_id, round(sum(home_possessions), 6) AS home_poss, "
        f"round(sum(away_possessions), 6) AS away_poss, CAST(sum(home_turnovers) AS BIGINT) AS home_tov "
        f"FROM periods WHERE {QUARTERS} GROUP BY match_id",
    ),
)
def sum_keeping_null(d):
    out = periods.sum_keep_null(
        periods.regulation_periods(d.periods),
        {"home_poss": "home_possessions", "away_poss": "away_possessions", "home_tov": "home_turnovers"},
    )
    return rounded(out, "home_poss", "away_poss")


@query(
    "ag3b_sum_or_zero",
    sql(
        "periods",
        "SELECT match_id, round(coalesce(sum(home_possessions), 0), 6) AS home_poss, "
        "CAST(coalesce(sum(home_fga), 0) AS BIGINT) AS home_fga FROM periods WHERE period_type = 'QUARTER' "
        "GROUP BY match_id",
    ),
)
def sum_or_zero(d):
    rows = d.periods.where("period_type = 'QUARTER'")
    return rounded(
        periods.sum_or_zero(rows, {"home_poss": "home_possessions", "home_fga": "home_fga"}), "home_poss"
    )


GAME_LEVEL = """
SELECT match_id, max(CASE WHEN period_type = 'QUARTER' THEN 1 ELSE 0 END) AS has_q,
       sum(CASE WHEN period_type = 'QUARTER' THEN home_fga END) AS qf,
       max(CASE WHEN period_type = 'GAME' THEN home_fga END) AS gf,
       sum(CASE WHEN period_type = 'QUARTER' THEN away_possessions END) AS qp,
       max(CASE WHEN period_type = 'GAME' THEN away_possessions END) AS gp
FROM periods WHERE period_type IN ('QUARTER', 'GAME') GROUP BY match_id
"""


@query(
    "jn5_outer_join_fallback",
    sql(
        "periods",
        """
        SELECT match_id, CAST(CASE WHEN has_q = 1 THEN coalesce(qf, 0) ELSE gf END AS BIGINT) AS home_fga,
               round(CASE WHEN has_q = 1 THEN coalesce(qp, 0) ELSE gp END, 6) AS away_poss FROM g
        """,
        g=GAME_LEVEL,
    ),
)
def outer_join_fallback(d):
    named = {"home_fga": "home_fga", "away_poss": "away_possessions"}
    sums = periods.sum_or_zero(d.periods.where("period_type = 'QUARTER'"), named)
    game = d.periods.where("period_type = 'GAME'").select(
        "match_id", *[F.col(src).alias(out) for out, src in named.items()]
    )
    out = periods.with_fallback(sums, game, list(named))
    return as_long(rounded(out, "away_poss"), "home_fga")


@query(
    "jn6_aggregates_to_facts",
    sql(
        "contests periods",
        f"""
        SELECT c.match_id, w.h_q1, w.a_q4, round(w.pace, 6) AS match_home_pace FROM contests c LEFT JOIN (
            SELECT match_id, max(CASE WHEN period_number = 1 THEN home_score END) AS h_q1,
                   max(CASE WHEN period_number = 4 THEN away_score END) AS a_q4, avg(home_pace) AS pace
            FROM periods WHERE {QUARTERS} GROUP BY match_id) w ON w.match_id = c.match_id
        """,
    ),
)
def aggregates_to_facts(d):
    summary = periods.period_summary(periods.regulation_periods(d.periods))
    out = d.contests.join(summary, "match_id", "left")
    return rounded(out.select("match_id", "h_q1", "a_q4", "match_home_pace"), "match_home_pace")


@query(
    "pf14_totals",
    sql(
        "contests periods",
        """
        SELECT c.match_id, home_score_final + away_score_final AS game_total, h_q1 + a_q1 AS q1_total,
               coalesce(h_q1, 0) + coalesce(h_q2, 0) + coalesce(a_q1, 0) + coalesce(a_q2, 0) AS h1_total
        FROM contests c LEFT JOIN w ON w.match_id = c.match_id
        """,
        w=WIDE,
    ),
)
def totals(d):
    wide = periods.pivot_scores(periods.regulation_periods(d.periods))
    out = periods.target_totals(d.contests.join(wide, "match_id", "left"))
    return out.select("match_id", "game_total", "q1_total", "h1_total")


@query(
    "pf17_efficiency_by_opponent",
    sql(
        "contests periods",
        """
        SELECT match_id, round(home_score_final / hp * 100, 6) AS home_ortg,
               round(away_score_final / ap * 100, 6) AS home_drtg, round(ht / hp * 100, 6) AS home_tov_rate,
               round(hp, 6) AS home_true_pace, round(away_score_final / ap * 100, 6) AS away_ortg,
               round(home_score_final / hp * 100, 6) AS away_drtg, round(at_ / ap * 100, 6) AS away_tov_rate,
               round(ap, 6) AS away_true_pace
        FROM (SELECT c.match_id, home_score_final, away_score_final, ht, at_,
                     CASE WHEN h >= 1 THEN h END AS hp, CASE WHEN a >= 1 THEN a END AS ap
              FROM contests c LEFT JOIN s ON s.match_id = c.match_id)
        """,
        s=f"SELECT match_id, sum(home_possessions) AS h, sum(away_possessions) AS a, "
        f"sum(home_turnovers) AS ht, sum(away_turnovers) AS at_ FROM periods WHERE {QUARTERS} GROUP BY match_id",
    ),
)
def efficiency_by_opponent(d):
    box = periods.period_summary(periods.regulation_periods(d.periods))
    df = d.contests.join(box, "match_id", "left")
    cols = ("home_score_final", "away_score_final", "home_poss", "away_poss", "home_tov", "away_tov")
    ratings = boxmath.efficiency_by_opponent(*[F.col(c) for c in cols])
    wanted = [f"{side}_{c}" for side in ("home", "away") for c in ("ortg", "drtg", "tov_rate", "true_pace")]
    return rounded(df.select("match_id", *[ratings[c].alias(c) for c in wanted]), *wanted)


@query(
    "pf17_shooting_rates",
    sql(
        "contests periods",
        "SELECT c.match_id, "
        + ", ".join(
            f"round({side}_fta / nullif({side}_poss, 0), 6) AS {side}_ft_rate, "
            f"round({side}_tov / nullif({side}_poss, 0), 6) AS {side}_to_rate, "
            f"round({side}_oreb / nullif({side}_fga, 0), 6) AS {side}_oreb_rate, "
            f"round({side}_score_final / nullif({side}_poss, 0), 6) AS {side}_pts_per_poss"
            for side in ("home", "away")
        )
        + " FROM contests c LEFT JOIN s ON s.match_id = c.match_id",
        s="SELECT match_id, "
        + ", ".join(
            f"CASE WHEN max(CASE WHEN period_type = 'QUARTER' THEN 1 ELSE 0 END) = 1 "
            f"THEN coalesce(sum(CASE WHEN period_type = 'QUARTER' THEN {side}_{source} END), 0) "
            f"ELSE max(CASE WHEN period_type = 'GAME' THEN {side}_{source} END) END AS {side}_{name}"
            for side in ("home", "away")
            for name, source in (("poss", "possessions"), ("fga", "fga"), ("fta", "fta"), ("oreb", "off_reb"), ("tov", "turnovers"))
        )
        + " FROM periods WHERE period_type IN ('QUARTER', 'GAME') GROUP BY match_id",
    ),
)
def shooting_rates(d):
    out = periods.contest_stats(d.contests, d.periods)
    rates = [f"{side}_{c}" for side in ("home", "away") for c in ("ft_rate", "to_rate", "oreb_rate", "pts_per_poss")]
    return rounded(out.select("match_id", *rates), *rates)


@query(
    "ag7_rowwise_mean",
    sql(
        "contests periods",
        """
        SELECT c.match_id,
               round(coalesce((coalesce(p1, 0) + coalesce(p2, 0) + coalesce(p3, 0) + coalesce(p4, 0)) / nullif(
                   (p1 IS NOT NULL)::INT + (p2 IS NOT NULL)::INT + (p3 IS NOT NULL)::INT + (p4 IS NOT NULL)::INT, 0),
                   g), 6) AS game_avg_pace
        FROM contests c LEFT JOIN s ON s.match_id = c.match_id
        """,
        s="SELECT match_id, "
        + ", ".join(
            f"max(CASE WHEN period_type = 'QUARTER' AND period_number = {p} THEN (home_pace + away_pace) / 2 END) AS p{p}"
            for p in range(1, 5)
        )
        + ", max(CASE WHEN period_type = 'GAME' THEN (home_pace + away_pace) / 2 END) AS g "
        "FROM periods WHERE period_type IN ('QUARTER', 'GAME') GROUP BY match_id",
    ),
)
def rowwise_mean(d):
    out = periods.contest_stats(d.contests, d.periods)
    return rounded(out.select("match_id", "game_avg_pace"), "game_avg_pace")


@query(
    "pf18_efficiency_own",
    sql(
        "contests advanced",
        """
        SELECT match_id, side, round(scored / possessions * 100, 6) AS offensive_rating,
               round(allowed / possessions * 100, 6) AS defensive_rating
        FROM (SELECT c.match_id, 'home' AS side, home_score_final AS scored, away_score_final AS allowed,
                     a.possessions - 95 AS possessions
              FROM contests c JOIN advanced a ON a.match_id = c.match_id AND a.team_id = c.home_team_id
              UNION ALL
              SELECT c.match_id, 'away', away_score_final, home_score_final, a.possessions - 95
              FROM contests c JOIN advanced a ON a.match_id = c.match_id AND a.team_id = c.away_team_id)
        WHERE possessions > 0
        """,
    ),
)
def efficiency_own(d):
    df = tables.join_sides(d.contests, d.advanced, ["possessions"], "left")

    def rated(side: str, other: str):
        poss = F.col(f"{side}_possessions") - 95
        ratings = boxmath.efficiency_own(F.col(f"{side}_score_final"), F.col(f"{other}_score_final"), poss)
        names = ("possessions", "offensive_rating", "defensive_rating")
        return F.struct(F.lit(side).alias("side"), *[ratings[c].alias(c) for c in names])

    both = df.select("match_id", F.inline(F.array(rated("home", "away"), rated("away", "home"))))
    out = both.where(F.col("possessions").isNotNull()).drop("possessions")
    return rounded(out, "offensive_rating", "defensive_rating")


@query(
    "pf19_three_point_rate",
    sql(
        "contests advanced periods",
        """
        SELECT c.match_id, round((20 + c.match_id % 13) / nullif(coalesce(ha.possessions, s.h), 0) * 100, 6) AS home_tpa_rate,
               round((18 + c.match_id % 11) / nullif(coalesce(aa.possessions, s.a), 0) * 100, 6) AS away_tpa_rate
        FROM contests c LEFT JOIN advanced ha ON ha.match_id = c.match_id AND ha.team_id = c.home_team_id
        LEFT JOIN advanced aa ON aa.match_id = c.match_id AND aa.team_id = c.away_team_id
        LEFT JOIN s ON s.match_id = c.match_id
        """,
        s=f"SELECT match_id, sum(home_possessions) AS h, sum(away_possessions) AS a FROM periods WHERE {QUARTERS} GROUP BY match_id",
    ),
)
def three_point_rate(d):
    box = periods.period_summary(periods.regulation_periods(d.periods)).select("match_id", "home_poss", "away_poss")
    df = tables.join_sides(d.contests, d.advanced, ["possessions"]).join(box, "match_id", "left")
    tried = {"home": F.lit(20) + F.col("match_id") % 13, "away": F.lit(18) + F.col("match_id") % 11}
    rates = {
        f"{side}_tpa_rate": boxmath.three_point_rate(n, F.col(f"{side}_possessions"), F.col(f"{side}_poss"))
        for side, n in tried.items()
    }
    return rounded(df.select("match_id", *[v.alias(k) for k, v in rates.items()]), *rates)


@query(
    "ag4_league_levels",
    sql(
        "contests periods",
        """
        SELECT c.league, round((sum(home_score_final) + sum(away_score_final)) / (2.0E0 * count(*)), 6) AS league_points,
               round(avg(s.p), 6) AS league_pace
        FROM contests c LEFT JOIN s ON s.match_id = c.match_id GROUP BY c.league
        """,
        s=f"SELECT match_id, avg(home_pace) AS p FROM periods WHERE {QUARTERS} GROUP BY match_id",
    ),
)
def league_levels(d):
    pace = periods.mean_pace(periods.regulation_periods(d.periods))
    out = fills.league_levels(d.contests.join(pace, "match_id", "left"), "league", "match_home_pace")
    return rounded(out, "league_points", "league_pace")


@query(
    "ag4_league_mean_on_rows",
    sql(
        "contests",
        "SELECT match_id, round(avg(home_score_final) OVER (PARTITION BY league), 6) AS league_home FROM contests",
    ),
)
def league_mean_on_rows(d):
    out = fills.league_strength(d.contests, "league", "home_score_final", "league_home")
    return rounded(out.select("match_id", "league_home"), "league_home")


BOX = """
SELECT c.match_id, c.league, CASE WHEN c.league <> '5-LOW' THEN a.possessions END AS poss, c.total_line
FROM contests c LEFT JOIN advanced a ON a.match_id = c.match_id AND a.team_id = c.home_team_id
"""


def _box(d):
    joined = tables.join_sides(d.contests, d.advanced, ["possessions"])
    poss = F.when(F.col("league") != "5-LOW", F.col("home_possessions"))
    return joined.select("match_id", "league", poss.alias("poss"), "total_line")


@query(
    "ag5_fill_global_mean",
    sql(
        "contests advanced",
        """
        SELECT match_id, round(coalesce(poss, (SELECT avg(poss) FROM b)), 6) AS poss,
               round(coalesce(total_line, (SELECT avg(total_line) FROM b)), 6) AS total_line FROM b
        """,
        b=BOX,
    ),
)
def global_fill(d):
    out = fills.fill_global_mean(_box(d), ["poss", "total_line"])
    return rounded(out.drop("league"), "poss", "total_line")


@query(
    "ag6_fill_league_mean",
    sql(
        "contests advanced",
        "SELECT match_id, round(coalesce(p, (SELECT avg(p) FROM f)), 6) AS poss FROM f",
        b=BOX,
        f="SELECT match_id, coalesce(poss, avg(poss) OVER (PARTITION BY league)) AS p FROM b",
    ),
)
def league_fill(d):
    out = fills.fill_league_mean(_box(d), ["poss"], "league")
    return rounded(out.select("match_id", "poss"), "poss")


@query(
    "ag18_coverage",
    sql(
        "contests advanced",
        "SELECT count(*) AS n_rows, count(poss) AS n_poss, count(total_line) AS n_total_line FROM b",
        b=BOX,
    ),
)
def column_coverage(d):
    return periods.coverage(_box(d), ["poss", "total_line"])


# -- labels, weights, splits -----------------------------------------------------------------

LABELLED = """
SELECT match_id, CAST(home_score_final + away_score_final > total_line AS BIGINT) AS over_hit FROM contests
WHERE total_line IS NOT NULL AND home_score_final + away_score_final <> total_line
"""


@query("pf4_labels", sql("contests", LABELLED))
def labels(d):
    out = settle.labelled(
        d.contests.withColumn("game_total", F.col("home_score_final") + F.col("away_score_final"))
    )
    return as_long(out.select("match_id", "over_hit"), "over_hit")


@query(
    "ag15_class_balance",
    sql(
        "contests",
        f"""
        SELECT league, round(100 * avg(over_hit), 6) AS over_rate, count(DISTINCT over_hit) AS n_classes
        FROM contests JOIN ({LABELLED}) USING (match_id) GROUP BY league
        """,
    ),
)
def balance(d):
    rows = settle.labelled(
        d.contests.withColumn("game_total", F.col("home_score_final") + F.col("away_score_final"))
    )
    return rounded(metrics.class_balance(rows, ["league"], "over_hit"), "over_rate")


@query(
    "pf15_line_signals",
    sql(
        "contests appearances",
        """
        SELECT c.match_id, total_line AS bookmaker_total_closing, total_line - total_line_open AS line_movement,
               round(h.l5 + a.l5 - total_line, 6) AS market_vs_history_delta
        FROM contests c JOIN r h ON h.match_id = c.match_id AND NOT h.is_road
        JOIN r a ON a.match_id = c.match_id AND a.is_road
        """,
        r="SELECT match_id, is_road, avg(pts) OVER (PARTITION BY team_id ORDER BY scheduled_at, match_id "
        "ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS l5 FROM appearances",
    ),
)
def signals(d):
    from tipoff.operators.rolling import lagged_means
    from tipoff.operators.timeline import finish, rejoin_sides, timeline
    from tipoff.plans.features import line_signals

    rows = d.appearances("pts", keep=("total_line", "total_line_open"))
    rolled = finish(lagged_means(timeline(rows), ["pts"], [5]))
    wide = rejoin_sides(rolled, ["pts_L5"], keep=("total_line", "total_line_open"))
    wide = wide.withColumnsRenamed(
        {f"{s}_pts_L5": f"{s}_pts_scored_game_L5" for s in ("home", "away")}
    )
    out = line_signals(wide).select(
        "match_id", "bookmaker_total_closing", "line_movement", "market_vs_history_delta"
    )
    return rounded(out, "market_vs_history_delta")


@query(
    "pf16_playoff_flags",
    sql(
        "contests",
        """
        SELECT match_id, CAST(lower(season_type) = 'playoffs' AS BIGINT) AS by_type,
               CAST(scheduled_at >= TIMESTAMP '1999-04-19 00:00:00' AS BIGINT) AS by_date FROM contests
        """,
    ),
)
def playoff_flags(d):
    return d.contests.select(
        "match_id",
        boxmath.is_type(F.col("season_type"), "playoffs").cast("bigint").alias("by_type"),
        (F.col("scheduled_at") >= F.lit("1999-04-19").cast("timestamp")).cast("bigint").alias("by_date"),
    )


@query(
    "pf20_matchup",
    sql(
        "contests appearances periods",
        f"""
        SELECT c.match_id, round(h.s / l.pts, 6) AS home_attack_strength, round(a.s / l.pts, 6) AS away_attack_strength,
               round(h.o / l.pts, 6) AS home_defense_strength, round(a.o / l.pts, 6) AS away_defense_strength,
               round(h.w - a.w, 6) AS win_rate_diff_L5, round(h.p + a.p - l.pace, 6) AS expected_matchup_pace
        FROM contests c JOIN rolled h ON h.match_id = c.match_id AND NOT h.is_road
        JOIN rolled a ON a.match_id = c.match_id AND a.is_road JOIN levels l ON l.league = c.league
        """,
        pace=f"SELECT match_id, avg(home_pace) AS hp, avg(away_pace) AS ap FROM periods WHERE {QUARTERS} GROUP BY match_id",
        rows="""
        SELECT x.*, CASE WHEN is_road THEN ap ELSE hp END AS pace,
               CASE WHEN pts > opp THEN 1.0E0 ELSE 0.0E0 END AS win
        FROM appearances x LEFT JOIN pace USING (match_id)
        """,
        rolled="""
        SELECT match_id, is_road, avg(pts) OVER f AS s, avg(opp) OVER f AS o, avg(win) OVER f AS w, avg(pace) OVER f AS p
        FROM rows WINDOW f AS (PARTITION BY team_id ORDER BY scheduled_at, match_id
                               ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)
        """,
        levels="""
        SELECT league, avg(pts) AS pts, avg(CASE WHEN NOT is_road THEN pace END) AS pace FROM rows GROUP BY league
        """,
    ),
)
def matchup(d):
    from tipoff.operators.rolling import lagged_means
    from tipoff.operators.timeline import appearances, finish, rejoin_sides, timeline

    pace = periods.mean_pace(periods.regulation_periods(d.periods))
    base = d.contests.join(pace, "match_id", "left")
    hs, as_ = F.col("home_score_final"), F.col("away_score_final")
    rows = appearances(
        base,
        {
            "pts": (hs, as_),
            "opp": (as_, hs),
            "win": ((hs > as_).cast("double"), (as_ > hs).cast("double")),
            "pace": (F.col("match_home_pace"), F.col("match_away_pace")),
        },
        ("league",),
    )
    stats = ["pts", "opp", "win", "pace"]
    rolled = finish(lagged_means(timeline(rows), stats, [5]))
    wide = rejoin_sides(rolled, [f"{s}_L5" for s in stats], ("league",))
    levels = fills.league_levels(base, "league", "match_home_pace")
    out = fills.matchup(wide, levels, "league", "pts", "opp")
    cols = [f"{side}_{c}_strength" for side in ("home", "away") for c in ("attack", "defense")]
    cols += ["win_rate_diff_L5", "expected_matchup_pace"]
    return rounded(out.select("match_id", *cols), *cols)


@query(
    "pf21_season_weight",
    sql(
        "contests",
        """
        SELECT match_id, CASE WHEN month(scheduled_at) IN (12, 1, 2, 3) THEN 1.0E0
               WHEN month(scheduled_at) IN (10, 11) THEN 0.5E0 WHEN month(scheduled_at) IN (4, 5, 6) THEN 0.2E0
               ELSE 0.5E0 END AS weight FROM contests
        """,
    ),
)
def weights(d):
    return d.contests.select("match_id", boxmath.season_weight(F.col("scheduled_at")).alias("weight"))


@query(
    "pf8_month_split",
    sql(
        "contests",
        "SELECT match_id, CASE WHEN month(scheduled_at) IN (12, 1, 2, 3) THEN 'test' ELSE 'train' END AS split FROM contests",
    ),
)
def month_split(d):
    return splits.split_by_months(d.contests, [12, 1, 2, 3]).select("match_id", "split")


@query(
    "wn10_latest_per_league",
    sql(
        "contests",
        """
        SELECT match_id, CASE WHEN r <= greatest(1, CAST(floor(n * 0.2E0) AS BIGINT)) THEN 'test' ELSE 'train' END AS split
        FROM (SELECT match_id, row_number() OVER (PARTITION BY league ORDER BY scheduled_at DESC, match_id DESC) AS r,
                     count(*) OVER (PARTITION BY league) AS n FROM contests)
        """,
    ),
)
def latest_split(d):
    return splits.split_latest(d.contests, "league").select("match_id", "split")


@query(
    "st2_test_rows",
    sql(
        "contests",
        """
        SELECT league, count(*) AS n_test FROM (
            SELECT league, row_number() OVER (PARTITION BY league ORDER BY scheduled_at DESC, match_id DESC) AS r,
                   count(*) OVER (PARTITION BY league) AS n FROM contests)
        WHERE r <= greatest(1, CAST(floor(n * 0.2E0) AS BIGINT)) GROUP BY league
        """,
    ),
)
def held_out_rows(d):
    held_out = splits.split_latest(d.contests, "league").where("split = 'test'")
    return held_out.groupBy("league").agg(F.count("*").alias("n_test"))


@query(
    "wn11_three_way_split",
    sql(
        "contests",
        """
        SELECT match_id, CASE WHEN r <= CAST(floor(n * 0.6E0) AS BIGINT) THEN 'train'
               WHEN r <= CAST(floor(n * (0.6E0 + 0.2E0)) AS BIGINT) THEN 'validation' ELSE 'test' END AS split
        FROM (SELECT match_id, row_number() OVER (ORDER BY scheduled_at, match_id) AS r,
                     count(*) OVER () AS n FROM contests)
        """,
    ),
)
def three_way(d):
    return splits.split_three_ways(d.contests, 0.6, 0.2).select("match_id", "split")


@query(
    "wn12_two_way_split",
    sql(
        "contests",
        """
        SELECT match_id, CASE WHEN r <= n - CAST(ceil(n * 0.2E0) AS BIGINT) THEN 'train' ELSE 'test' END AS split
        FROM (SELECT match_id, row_number() OVER (ORDER BY scheduled_at, match_id) AS r,
                     count(*) OVER () AS n FROM contests)
        """,
    ),
)
def two_way(d):
    return splits.split_two_ways(d.contests, 0.2).select("match_id", "split")


@query(
    "ag10_train_median_line",
    sql(
        "contests",
        """
        SELECT s.league, round(m.line, 6) AS line, count(*) AS n,
               CAST(sum(CASE WHEN total > m.line THEN 1 ELSE 0 END) AS BIGINT) AS over_hits
        FROM s JOIN m ON m.league = s.league GROUP BY 1, 2
        """,
        s="""
        SELECT league, total, r > greatest(1, CAST(floor(n * 0.2E0) AS BIGINT)) AS train FROM (
            SELECT league, home_score_final + away_score_final AS total,
                   row_number() OVER (PARTITION BY league ORDER BY scheduled_at DESC, match_id DESC) AS r,
                   count(*) OVER (PARTITION BY league) AS n FROM contests)
        """,
        m="SELECT league, median(total) AS line FROM s WHERE train GROUP BY league",
    ),
)
def train_median(d):
    rows = d.contests.withColumn("total", F.col("home_score_final") + F.col("away_score_final"))
    out = metrics.median_line(splits.split_latest(rows, "league"), ["league"], "total")
    return out.groupBy("league", "line").agg(
        F.count("*").alias("n"), F.sum("over_hit").alias("over_hits")
    )


@query(
    "ag11_quantiles",
    """
    SELECT event_type, q, round(CASE q WHEN 0.025E0 THEN a WHEN 0.5E0 THEN b ELSE c END, 6) AS value
    FROM (SELECT event_type, quantile_cont(value, 0.025) AS a, quantile_cont(value, 0.5) AS b,
                 quantile_cont(value, 0.975) AS c FROM events GROUP BY event_type),
         (VALUES (0.025E0), (0.5E0), (0.975E0)) v(q)
    """,
)
def quantiles(d):
    out = metrics.exact_quantiles(d.table("events"), ["event_type"], "value", [0.025, 0.5, 0.975])
    return rounded(out, "value")


# -- decisions and scores --------------------------------------------------------------------

SETTLED = """
SELECT p.*, t.threshold, CASE
    WHEN prob >= t.threshold THEN CASE WHEN actual = line THEN 0 WHEN actual > line THEN 1 ELSE -1 END
    WHEN prob <= 1 - t.threshold THEN CASE WHEN actual = line THEN 0 WHEN actual < line THEN 1 ELSE -1 END
    END AS label
FROM predictions p, (VALUES {}) t(threshold)
"""
THRESHOLDS = ", ".join(f"({t!r}E0)" for t in BETS.thresholds)
ALL_SETTLED = SETTLED.format(THRESHOLDS)
REPORT = """
SELECT league, threshold, wins, losses, pushes, wins + losses + pushes AS n,
       round(wins * (1.9E0 - 1.0E0) - losses * 1.0E0, 6) AS profit,
       round(CASE WHEN wins + losses > 0 THEN 100.0E0 * wins / (wins + losses) ELSE 0 END, 6) AS winrate,
       round(CASE WHEN wins + losses + pushes > 0 THEN
           100.0E0 * (wins * (1.9E0 - 1.0E0) - losses * 1.0E0) / (wins + losses + pushes) ELSE 0 END, 6) AS roi
FROM (SELECT league, threshold, count(*) FILTER (WHERE label = 1) AS wins,
             count(*) FILTER (WHERE label = -1) AS losses, count(*) FILTER (WHERE label = 0) AS pushes
      FROM settled GROUP BY league, threshold)
"""

RAW_RETURNS = """
SELECT league, threshold, n, CASE WHEN n > 0 THEN 100.0E0 * (wins * (1.9E0 - 1.0E0) - losses) / n ELSE 0 END AS roi
FROM (SELECT league, threshold, count(label) AS n, count(*) FILTER (WHERE label = 1) AS wins,
             count(*) FILTER (WHERE label = -1) AS losses FROM {} GROUP BY league, threshold)
"""


@query(
    "ev1_settlement",
    sql(
        "predictions",
        """
        SELECT match_id, CAST(label AS BIGINT) AS label,
               CASE label WHEN 1 THEN 1.9E0 - 1.0E0 WHEN -1 THEN -1.0E0 ELSE 0.0E0 END AS pnl FROM settled
        """,
        settled=SETTLED.format("(0.56E0)"),
    ),
)
def settlement(d):
    out = settle.settled(d.predictions, 0.56)
    return as_long(out.select("match_id", "label", "pnl"), "label")


@query("ev2_threshold_sweep", sql("predictions", REPORT, settled=ALL_SETTLED))
def threshold_sweep(d):
    return rounded(settle.sweep(d.predictions, ["league"]), "profit", "winrate", "roi")


@query(
    "ag9_bet_report",
    sql("predictions", REPORT, settled=SETTLED.format("(0.54E0)")),
)
def report(d):
    rows = settle.settled(d.predictions, 0.54).withColumn("threshold", F.lit(0.54))
    return rounded(settle.bet_report(rows, ["league", "threshold"]), "profit", "winrate", "roi")


@query(
    "ag19_best_threshold",
    sql(
        "predictions",
        """
        SELECT league, round(roi, 2) AS best_roi, threshold AS best_thr, n AS best_bets
        FROM (SELECT *, row_number() OVER (PARTITION BY league ORDER BY roi DESC, threshold) AS r
              FROM report WHERE n >= 10) WHERE r = 1
        """,
        settled=ALL_SETTLED,
        report=REPORT,
    ),
)
def best_threshold(d):
    return grid.best_threshold(settle.sweep(d.predictions, ["league"]), ["league"], 10)


@query(
    "pf11_bet_gate",
    sql(
        "predictions",
        """
        SELECT match_id, league FROM (
            SELECT match_id, prob, CASE league WHEN '1-URGENT' THEN 'CBA' WHEN '2-HIGH' THEN 'ACB' ELSE league END AS league
            FROM predictions)
        WHERE league <> 'CBA' AND greatest(prob, 1 - prob) >= CASE league WHEN 'ACB' THEN 0.60E0 ELSE 0.54E0 END
        """,
    ),
)
def gate(d):
    league = (
        F.when(F.col("league") == "1-URGENT", "CBA").when(F.col("league") == "2-HIGH", "ACB").otherwise(F.col("league"))
    )
    return settle.bet_gate(d.predictions.withColumn("league", league)).select("match_id", "league")


DRAWS = BETS.draws
DIGESTS = f"""
SELECT league, threshold, wins, losses, pushes, n, b, j,
       md5(concat(league, '-', threshold, '-', b, '-', j)) AS h
FROM report, (SELECT unnest(range(1, {DRAWS} + 1)) AS b), LATERAL (SELECT unnest(range(0, CAST(ceil(n / 4.0) AS BIGINT))) AS j)
WHERE n > 0
"""
DRAWN = " UNION ALL ".join(
    f"SELECT league, threshold, wins, pushes, n, b, j * 4 + {i} AS pos, "
    f"CAST(floor(CAST(concat('0x', substring(h, {8 * i + 1}, 8)) AS BIGINT) / 4294967296.0E0 * n) AS BIGINT) AS slot "
    "FROM digests"
    for i in range(4)
)


@query(
    "ev3_bootstrap_interval",
    sql(
        "predictions",
        """
        SELECT r.league, r.threshold, r.n, round(100 * quantile_cont(m.mean, 0.025), 6) AS roi_ci_low,
               round(100 * quantile_cont(m.mean, 0.975), 6) AS roi_ci_high
        FROM report r LEFT JOIN means m ON m.league = r.league AND m.threshold = r.threshold GROUP BY 1, 2, 3
        """,
        settled=ALL_SETTLED,
        report=REPORT,
        digests=DIGESTS,
        drawn=DRAWN,
        means="""
        SELECT league, threshold, b,
               (count(*) FILTER (WHERE slot < wins) * (1.9E0 - 1.0E0) - count(*) FILTER (WHERE slot >= wins + pushes)) / n AS mean
        FROM drawn WHERE pos < n GROUP BY league, threshold, b, n
        """,
    ),
)
def bootstrap_indexed(d):
    rep = settle.sweep(d.predictions, ["league"])
    out = settle.bootstrap_interval_indexed(rep, ["league", "threshold"], DRAWS)
    return rounded(
        out.select("league", "threshold", "n", "roi_ci_low", "roi_ci_high"), "roi_ci_low", "roi_ci_high"
    )


@query(
    "ev3_bootstrap_counts",
    sql(
        "predictions",
        "SELECT league, threshold, n, roi, true AS contained, true AS again FROM report",
        settled=ALL_SETTLED,
        report=REPORT,
    ),
)
def bootstrap_counts(d):
    """All draws: the interval contains the return, and a second run gives the same bounds."""
    report = settle.sweep(d.predictions, ["league"])
    one = settle.bootstrap_interval(report, ["league"])
    two = settle.bootstrap_interval(report, ["league"]).select(
        "league", "threshold", F.col("roi_ci_low").alias("low"), F.col("roi_ci_high").alias("high")
    )
    contained = F.when(F.col("n") == 0, F.col("roi_ci_low").isNull()).otherwise(
        (F.col("roi_ci_low") <= F.col("roi")) & (F.col("roi") <= F.col("roi_ci_high"))
    )
    again = F.col("low").eqNullSafe(F.col("roi_ci_low")) & F.col("high").eqNullSafe(F.col("roi_ci_high"))
    out = one.join(two, ["league", "threshold"])
    return rounded(out.select("league", "threshold", "n", "roi", contained.alias("contained"), again.alias("again")), "roi")


@query("ev3_bootstrap_bounds")
def bootstrap_bounds(d):
    """The bounds from all draws of the settings; their random numbers have no SQL."""
    out = settle.bootstrap_interval(settle.sweep(d.predictions, ["league"]), ["league"])
    return rounded(
        out.select("league", "threshold", "n", "roi_ci_low", "roi_ci_high"), "roi_ci_low", "roi_ci_high"
    )


@query(
    "ev10_significance_flag",
    sql(
        "predictions",
        """
        SELECT league, threshold, CASE WHEN n = 0 THEN 'none' WHEN profit - 100 > 0 THEN 'significant'
               WHEN profit > 0 THEN 'profit' ELSE 'loss' END AS flag FROM report
        """,
        settled=ALL_SETTLED,
        report=REPORT,
    ),
)
def significance(d):
    rep = settle.sweep(d.predictions, ["league"]).withColumn("roi_ci_low", F.col("profit") - 100)
    return settle.flag(rep).select("league", "threshold", "flag")


AUC = """
SELECT league, count(*) AS n,
       round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss FROM scored GROUP BY league
"""
SCORED = """
SELECT league, prob, least(greatest(prob, 2.220446049250313e-16), 1 - 2.220446049250313e-16) AS p,
       CASE WHEN actual > line THEN 1 ELSE 0 END AS y FROM predictions
"""


def _scored(d):
    return d.predictions.withColumn("y", (F.col("actual") > F.col("line")).cast("int"))


@query("ag13_log_loss", sql("predictions", AUC, scored=SCORED))
def logloss(d):
    out = _scored(d).groupBy("league").agg(
        F.count("*").alias("n"), metrics.log_loss(F.col("y"), F.col("prob")).alias("log_loss")
    )
    return rounded(out, "log_loss")


@query(
    "ag14_roc_auc",
    sql(
        "predictions",
        """
        SELECT league, round((sum(CASE WHEN y = 1 THEN mid END) - np * (np + 1) / 2.0E0) / (np * nn), 6) AS roc_auc
        FROM (SELECT league, y, sum(y) OVER (PARTITION BY league) AS np, sum(1 - y) OVER (PARTITION BY league) AS nn,
                     rank() OVER (PARTITION BY league ORDER BY prob)
                     + (count(*) OVER (PARTITION BY league, prob) - 1) / 2.0E0 AS mid FROM scored)
        GROUP BY league, np, nn
        """,
        scored=SCORED,
    ),
)
def auc(d):
    return rounded(metrics.roc_auc(_scored(d), ["league"], "y", "prob"), "roc_auc")


ERRORS = """
SELECT league, count(*) AS n, avg(abs(actual - line)) AS mae, sqrt(avg((actual - line) * (actual - line))) AS rmse,
       avg(abs(actual - base)) AS baseline_mae
FROM (SELECT *, avg(actual) OVER (PARTITION BY league) AS base FROM predictions) GROUP BY league
"""


def _errors(d):
    rows = fills.league_strength(d.predictions, "league", "actual", "base")
    return metrics.error_metrics(rows, ["league"], "actual", "line", "base")


@query(
    "ag12_error_metrics",
    sql(
        "predictions",
        "SELECT league, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(baseline_mae, 6) AS baseline_mae, "
        "round(baseline_mae - mae, 6) AS delta FROM e",
        e=ERRORS,
    ),
)
def errors(d):
    return rounded(_errors(d), "mae", "rmse", "baseline_mae", "delta")


@query(
    "ag12_overall_errors",
    sql(
        "predictions",
        """
        SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(mae * n) / sum(n), 6) AS mae, round(sum(rmse * n) / sum(n), 6) AS rmse,
               round(sum(baseline_mae * n) / sum(n), 6) AS baseline_mae,
               round(sum(baseline_mae * n) / sum(n) - sum(mae * n) / sum(n), 6) AS delta FROM e
        """,
        e=ERRORS,
    ),
)
def overall(d):
    return rounded(metrics.overall_errors(_errors(d)), "mae", "rmse", "baseline_mae", "delta")


# -- grid tables: a cell is (league, market segment of the buyer) --------------------------------

CELLS = """
SELECT p.league, c.c_mktsegment AS combo, p.match_id, p.prob, p.actual, p.line,
       CASE WHEN actual > line THEN 1 ELSE 0 END AS y
FROM predictions p JOIN orders o ON o.o_orderkey = p.match_id JOIN customer c ON c.c_custkey = o.o_custkey
"""
CELL_REPORT = REPORT.replace("league, threshold", "league, combo, threshold")
CELL_SETTLED = ALL_SETTLED.replace("FROM predictions p", "FROM cells p")
CELL_BEST = """
SELECT k.league, k.combo, round(b.roi, 2) AS best_roi, b.threshold AS best_thr, coalesce(b.n, 0) AS best_bets
FROM (SELECT DISTINCT league, combo FROM cells) k LEFT JOIN (
    SELECT *, row_number() OVER (PARTITION BY league, combo ORDER BY roi DESC, threshold) AS r
    FROM report WHERE n >= 60) b ON b.league = k.league AND b.combo = k.combo AND b.r = 1
"""
CELL_METRICS = """
SELECT league, combo, count(*) AS n_test, round(avg(-(y * ln(prob) + (1 - y) * ln(1 - prob))), 4) AS log_loss
FROM cells GROUP BY league, combo
"""
GRID_THR = (0.54, 0.56, 0.58)


def _cells(d):
    orders = d.table("orders").select(F.col("o_orderkey").alias("match_id"), "o_custkey")
    segment = d.table("customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("combo")
    )
    rows = d.predictions.join(orders, "match_id").join(segment, "o_custkey")
    return rows.withColumn("y", (F.col("actual") > F.col("line")).cast("int"))


def _full(d):
    cells = _cells(d)
    rep = settle.sweep(cells, ["league", "combo"])
    quality = cells.groupBy("league", "combo").agg(
        F.count("*").alias("n_test"),
        F.round(metrics.log_loss(F.col("y"), F.col("prob")), 4).alias("log_loss"),
    )
    return grid.full_table(rep, quality, 60, GRID_THR)


GRID_VIEWS = dict(cells=CELLS, settled=CELL_SETTLED, report=CELL_REPORT, best=CELL_BEST, quality=CELL_METRICS)


@query(
    "ev5_grid_table",
    sql(
        "predictions",
        "SELECT b.*, q.n_test, q.log_loss, "
        + ", ".join(
            f'max(CASE WHEN abs(r.threshold - {t}) < 1e-6 AND r.n >= 60 THEN round(r.roi, 2) END) AS "roi_{t:.2f}", '
            f'max(CASE WHEN abs(r.threshold - {t}) < 1e-6 THEN r.n END) AS "bets_{t:.2f}"'
            for t in GRID_THR
        )
        + " FROM best b JOIN quality q ON q.league = b.league AND q.combo = b.combo "
        "JOIN report r ON r.league = b.league AND r.combo = b.combo GROUP BY ALL",
        **GRID_VIEWS,
    ),
)
def grid_table(d):
    return _full(d)


@query(
    "wn13_best_per_league",
    sql(
        "predictions",
        """
        SELECT league, CASE WHEN best_roi IS NOT NULL THEN combo END AS winner_combo, best_roi, best_thr, best_bets,
               CASE WHEN best_roi IS NOT NULL THEN log_loss END AS log_loss
        FROM (SELECT b.*, q.log_loss, row_number() OVER (PARTITION BY b.league
                     ORDER BY best_roi DESC NULLS LAST, best_bets DESC, b.combo) AS r
              FROM best b JOIN quality q ON q.league = b.league AND q.combo = b.combo) WHERE r = 1
        """,
        **GRID_VIEWS,
    ),
)
def best_per_league(d):
    full = _full(d).withColumn("roc_auc", F.lit(None).cast("double"))
    return grid.winners(full).drop("roc_auc")


@query(
    "sl4_null_return_last",
    sql(
        "predictions",
        """
        SELECT CAST(row_number() OVER (ORDER BY best_roi DESC NULLS LAST, league, combo) AS BIGINT) AS place,
               league, combo, best_roi FROM best
        """,
        **{k: v for k, v in GRID_VIEWS.items() if k != "quality"},
    ),
)
def null_return_last(d):
    from pyspark.sql import Window

    best = grid.best_threshold(settle.sweep(_cells(d), ["league", "combo"]), ["league", "combo"], 60)
    # one row per grid cell
    by = Window.orderBy(F.col("best_roi").desc_nulls_last(), "league", "combo")
    return best.select(
        F.row_number().over(by).cast("bigint").alias("place"), "league", "combo", "best_roi"
    )


@query(
    "sl5_two_key_order",
    sql(
        "contests",
        "SELECT league, season_type, count(*) AS n FROM contests GROUP BY 1, 2 ORDER BY 1, 2",
    ),
)
def two_key_order(d):
    return (
        d.contests.groupBy("league", "season_type").agg(F.count("*").alias("n")).orderBy("league", "season_type")
    )


@query(
    "jn12_league_by_combo",
    sql(
        "contests",
        f"""
        SELECT league, combo, threshold, count(*) AS n
        FROM contests, (VALUES {', '.join(f"('{c}')" for c in COMBOS)}) c(combo),
             (VALUES {', '.join(f'({t}E0)' for t in GRID_THRESHOLDS)}) t(threshold)
        GROUP BY 1, 2, 3
        """,
    ),
)
def league_by_combo(d):
    """The whole grid: every league, combination and threshold."""
    counts = d.contests.groupBy("league").agg(F.count("*").alias("n"))
    crossed = grid.cross(counts, list(COMBOS), "combo")
    return crossed.withColumn("threshold", F.explode(F.array(*map(F.lit, GRID_THRESHOLDS))))


IMPORTANCE = """
SELECT o_orderpriority AS league, c_mktsegment AS feature, 100 * sum(o_totalprice) / sum(sum(o_totalprice)) OVER (
    PARTITION BY o_orderpriority) AS importance
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2
"""


def _importance(d):
    joined = d.table("orders").join(d.table("customer"), F.col("c_custkey") == F.col("o_custkey"))
    part = joined.groupBy(
        F.col("o_orderpriority").alias("league"), F.col("c_mktsegment").alias("feature")
    ).agg(F.sum("o_totalprice").alias("v"))
    whole = part.groupBy("league").agg(F.sum("v").alias("all"))
    return part.join(whole, "league").select(
        "league", "feature", (F.col("v") / F.col("all") * 100).alias("importance")
    )


@query(
    "jn11_dead_weight",
    f"""
    SELECT feature, round(max(importance), 6) AS max_importance FROM ({IMPORTANCE}) GROUP BY feature
    HAVING max(importance) < 22 AND count(DISTINCT league) = 5
    """,
)
def dead_weight(d):
    return rounded(grid.dead_weight(_importance(d), 22.0), "max_importance")


@query(
    "sl3_top_features",
    f"SELECT league, feature, round(importance, 6) AS importance FROM ({IMPORTANCE}) ORDER BY importance DESC, feature LIMIT 10",
)
def top_features(d):
    return rounded(grid.top_features(_importance(d), 10), "importance")


@query(
    "ev7_blind_choice",
    sql(
        "predictions",
        """
        SELECT v.league, v.threshold AS blind_thr, t.threshold AS peek_thr, round(bt.roi, 6) AS blind_roi,
               round(t.roi, 6) AS peek_roi, round(t.roi - bt.roi, 6) AS optimism
        FROM vb v JOIN tb t ON t.league = v.league
        LEFT JOIN treport bt ON bt.league = v.league AND bt.threshold = v.threshold
        """,
        part="""
        SELECT *, CASE WHEN r <= CAST(floor(n * 0.6E0) AS BIGINT) THEN 'train'
               WHEN r <= CAST(floor(n * (0.6E0 + 0.2E0)) AS BIGINT) THEN 'validation' ELSE 'test' END AS split
        FROM (SELECT *, row_number() OVER (ORDER BY scheduled_at, match_id) AS r, count(*) OVER () AS n FROM predictions)
        """,
        vsettled=ALL_SETTLED.replace("FROM predictions p", "FROM (SELECT * FROM part WHERE split = 'validation') p"),
        tsettled=ALL_SETTLED.replace("FROM predictions p", "FROM (SELECT * FROM part WHERE split = 'test') p"),
        vreport=RAW_RETURNS.format("vsettled"),
        treport=RAW_RETURNS.format("tsettled"),
        vb="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY league ORDER BY roi DESC, threshold) AS r FROM vreport WHERE n >= 10) WHERE r = 1",
        tb="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY league ORDER BY roi DESC, threshold) AS r FROM treport WHERE n >= 10) WHERE r = 1",
    ),
)
def blind_choice(d):
    split = splits.split_three_ways(d.predictions, 0.6, 0.2)
    rep = settle.sweep(split.where("split <> 'train'"), ["league", "split"])
    out = grid.optimism(
        rep.where("split = 'validation'").drop("split"),
        rep.where("split = 'test'").drop("split"),
        ["league"],
        10,
    )
    out = out.select("league", "blind_thr", "peek_thr", "blind_roi", "peek_roi", "optimism")
    return rounded(out, "blind_roi", "peek_roi", "optimism")
