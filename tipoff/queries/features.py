"""Whole feature tables and model runs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipoff.config import FEATURES
from tipoff.operators import periods, settle
from tipoff.plans import backtest, columns, features
from tipoff.queries.aggregates import ALL_SETTLED, QUARTERS, REPORT, WIDE
from tipoff.queries.registry import as_long, query, rounded
from tipoff.queries.views import sql
from tipoff.queries.windows import GAP, W, ema_sql
from tipoff.session import drop_staged, free_shuffles, staged_in_slices, staged_tables
from tipoff.sources import tables

# -- the score feature table in SQL ---------------------------------------------------------------

STATS = {
    "pts_scored_q1": ("h_q1", "a_q1"),
    "pts_allowed_q1": ("a_q1", "h_q1"),
    "pts_scored_h1": ("h1h", "h1a"),
    "pts_allowed_h1": ("h1a", "h1h"),
    "pts_scored_h2": ("home_score_final - h1h", "away_score_final - h1a"),
    "pts_allowed_h2": ("away_score_final - h1a", "home_score_final - h1h"),
    "pts_scored_game": ("home_score_final", "away_score_final"),
    "pts_allowed_game": ("away_score_final", "home_score_final"),
    "win": (
        "CASE WHEN home_score_final > away_score_final THEN 1.0E0 ELSE 0.0E0 END",
        "CASE WHEN away_score_final > home_score_final THEN 1.0E0 ELSE 0.0E0 END",
    ),
    "pace": ("home_pace", "away_pace"),
    "ortg": ("home_score_final / hp * 100", "away_score_final / ap * 100"),
    "drtg": ("away_score_final / ap * 100", "home_score_final / hp * 100"),
    "tov_rate": ("ht / hp * 100", "at_ / ap * 100"),
    "true_pace": ("hp", "ap"),
    "box_ortg": ("home_offensive_rating", "away_offensive_rating"),
    "box_drtg": ("home_defensive_rating", "away_defensive_rating"),
    "box_true_pace": ("coalesce(home_possessions, hp)", "coalesce(away_possessions, ap)"),
    "box_tpa": ("home_tpa", "away_tpa"),
    "box_tpa_rate": (
        "home_tpa / nullif(coalesce(home_possessions, hp), 0) * 100",
        "away_tpa / nullif(coalesce(away_possessions, ap), 0) * 100",
    ),
}
PLAN = {c: ((3, 5), 5) for c in (*columns.SCORE_STATS, *columns.EXTRA_STATS)}
PLAN |= {c: ((3,), 5) for c in columns.RATING_STATS}
PLAN |= {c: ((5,), 5) for c in columns.BOX_STATS}
OUTPUTS = [f"{c}_{e}" for c, (ks, span) in PLAN.items() for e in columns.suffixes(ks, span)]
FILLED = columns.sided((*columns.SCORE_STATS, *columns.EXTRA_STATS), columns.suffixes((3, 5), 5))


def _side_rows(i: int) -> str:
    cols = ", ".join(f"CAST({pair[i]} AS DOUBLE) AS {c}" for c, pair in STATS.items())
    side = ("home", "away")[i]
    return (
        f"SELECT match_id, scheduled_at, {side}_team_id AS team_id, {'true' if i else 'false'} AS is_road, {cols} FROM base"
    )


def _rolled() -> str:
    out = []
    for c, (ks, _) in PLAN.items():
        out += [f"avg({c}) OVER ({W} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS {c}_L{k}" for k in ks]
        out.append(ema_sql(c, f"{c}_EMA5"))
    return (
        "SELECT match_id, is_road, rest, b2b, short, long_, streak, "
        "last_value(CASE WHEN NOT is_road THEN form END IGNORE NULLS) OVER f "
        "- last_value(CASE WHEN is_road THEN form END IGNORE NULLS) OVER f AS gap_, "
        + ", ".join(out)
        + f" FROM timed WINDOW f AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )


LEVELLED = {
    "home_attack_strength": "h.pts_scored_game_L5 / l.pts",
    "away_attack_strength": "a.pts_scored_game_L5 / l.pts",
    "home_defense_strength": "h.pts_allowed_game_L5 / l.pts",
    "away_defense_strength": "a.pts_allowed_game_L5 / l.pts",
    "win_rate_diff_L5": "h.win_L5 - a.win_L5",
    "expected_matchup_pace": "h.pace_L5 + a.pace_L5 - l.pace",
}
PLAIN = {
    "home_days_rest": "h.rest",
    "away_days_rest": "a.rest",
    "is_playoff": "CAST(lower(season_type) = 'playoffs' AS BIGINT)",
    "home_is_b2b": "h.b2b",
    "away_is_b2b": "a.b2b",
    "home_games_last_short": "h.short",
    "away_games_last_short": "a.short",
    "home_games_last_long": "h.long_",
    "away_games_last_long": "a.long_",
    "home_is_high_density": "CAST(h.short >= 3 AS BIGINT)",
    "away_is_high_density": "CAST(a.short >= 3 AS BIGINT)",
    "away_consecutive_road": "a.streak",
    "rest_diff": "h.rest - a.rest",
    "has_boxscore": "CAST(coalesce(b.hp >= 1, false) AS BIGINT)",
    "home_fortress_index": "h.gap_",
    "away_vulnerability_index": "a.gap_",
    "game_total": "home_score_final + away_score_final",
    "q1_total": "h_q1 + a_q1",
    "h1_total": "h1h + h1a",
    "total_line": "total_line",
}
SIDED = {f"{s}_{c}": f"{t}.{c}" for s, t in (("home", "h"), ("away", "a")) for c in OUTPUTS}
ROUNDED = [*SIDED, *LEVELLED, "home_fortress_index", "away_vulnerability_index"]


def _filled(name: str) -> str:
    if name in FILLED or name in LEVELLED:
        return f"round(coalesce({name}, avg({name}) OVER ()), 6) AS {name}"
    if name in columns.TEAM_ADVANCED:
        return f"round(coalesce({name}, avg({name}) OVER (PARTITION BY league)), 6) AS {name}"
    if name in ROUNDED:
        return f"round({name}, 6) AS {name}"
    return name


WIDE_COLUMNS = {**SIDED, **LEVELLED, **PLAIN}
FEATURE_VIEWS = dict(
    wide_q=WIDE,
    box=f"SELECT match_id, avg(home_pace) AS home_pace, avg(away_pace) AS away_pace, "
    f"sum(home_possessions) AS h, sum(away_possessions) AS a, sum(home_turnovers) AS ht, "
    f"sum(away_turnovers) AS at_ FROM periods WHERE {QUARTERS} GROUP BY match_id",
    base="""
    SELECT c.*, w.* EXCLUDE (match_id), b.* EXCLUDE (match_id),
           CASE WHEN b.h >= 1 THEN b.h END AS hp, CASE WHEN b.a >= 1 THEN b.a END AS ap,
           coalesce(h_q1, 0) + coalesce(h_q2, 0) AS h1h, coalesce(a_q1, 0) + coalesce(a_q2, 0) AS h1a,
           ha.possessions AS home_possessions, aa.possessions AS away_possessions,
           ha.offensive_rating AS home_offensive_rating, aa.offensive_rating AS away_offensive_rating,
           ha.defensive_rating AS home_defensive_rating, aa.defensive_rating AS away_defensive_rating,
           ha.three_pointers_attempted AS home_tpa, aa.three_pointers_attempted AS away_tpa
    FROM contests c LEFT JOIN wide_q w ON w.match_id = c.match_id LEFT JOIN box b ON b.match_id = c.match_id
    LEFT JOIN advanced ha ON ha.match_id = c.match_id AND ha.team_id = c.home_team_id
    LEFT JOIN advanced aa ON aa.match_id = c.match_id AND aa.team_id = c.away_team_id
    """,
    rows_=f"{_side_rows(0)} UNION ALL {_side_rows(1)}",
    numbered=f"SELECT *, row_number() OVER ({W}) AS rn, {GAP} AS gap, "
    "avg(win) OVER (PARTITION BY team_id, is_road ORDER BY scheduled_at, match_id "
    "ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS form FROM rows_",
    island=f"SELECT *, sum(CASE WHEN NOT is_road OR gap > 21 OR gap IS NULL THEN 1 ELSE 0 END) OVER "
    f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM numbered",
    timed="""
    SELECT *, least(greatest(coalesce(gap, 7), 0), 21) AS rest, CAST(coalesce(gap = 1, false) AS BIGINT) AS b2b,
           CAST(rn - (SELECT count(*) FROM numbered b WHERE b.team_id = n.team_id
                AND b.scheduled_at < n.scheduled_at - INTERVAL 4 DAY) AS BIGINT) AS short,
           CAST(rn - (SELECT count(*) FROM numbered b WHERE b.team_id = n.team_id
                AND b.scheduled_at < n.scheduled_at - INTERVAL 7 DAY) AS BIGINT) AS long_,
           CAST(CASE WHEN is_road THEN sum(CASE WHEN is_road THEN 1 ELSE 0 END) OVER (
               PARTITION BY team_id, isl ORDER BY scheduled_at, match_id) ELSE 0 END AS BIGINT) AS streak
    FROM island n
    """,
    rolled=_rolled(),
    levels="SELECT league, (sum(home_score_final) + sum(away_score_final)) / (2.0E0 * count(*)) AS pts, "
    "avg(home_pace) AS pace FROM base GROUP BY league",
    joined=f"""
    SELECT b.match_id, b.league, {', '.join(f'{e} AS {n}' for n, e in WIDE_COLUMNS.items())}
    FROM base b JOIN rolled h ON h.match_id = b.match_id AND NOT h.is_road
    JOIN rolled a ON a.match_id = b.match_id AND a.is_road LEFT JOIN levels l ON l.league = b.league
    """,
)
FEATURE_SQL = sql(
    "contests periods advanced",
    f"SELECT match_id, league, {', '.join(_filled(n) for n in WIDE_COLUMNS)} FROM joined",
    **FEATURE_VIEWS,
)


def _score_tables(d) -> tuple[DataFrame, DataFrame]:
    contests = tables.join_sides(d.contests, d.advanced, tables.ADVANCED_COLUMNS)
    return contests, periods.regulation_periods(d.periods)


def score_table(d) -> DataFrame:
    return features.score_features(*_score_tables(d))


_KEPT: dict[tuple[str, str], DataFrame] = {}


def kept_score_table(d) -> DataFrame:
    """The feature table written once per session and folder, for the model queries.

    Each task writes its rows by league, so that a read of one league skips the pages of the others.
    The two sides of the contests are joined in slices, so that a part of them is shuffled at a time.
    What was stored on the way to the table is removed when it is there.
    """
    key = (d.spark.sparkContext.applicationId, d.sf_dir)
    if key not in _KEPT:
        before = set(staged_tables(d.spark))
        table = score_table(d)
        on_the_way = set(staged_tables(d.spark)) - before
        _KEPT[key] = staged_in_slices(table.sortWithinPartitions("league"), "features", "match_id")
        drop_staged(d.spark, on_the_way)
        free_shuffles(d.spark)
    return _KEPT[key]


def read_once(d) -> DataFrame:
    """The feature table for a query that goes over it once: the stored one if it is there, else unstored."""
    kept = _KEPT.get((d.spark.sparkContext.applicationId, d.sf_dir))
    return score_table(d) if kept is None else kept


def score_table_by_parts(d) -> DataFrame:
    """The feature table for a query of nearly all its columns, which would shuffle both sides of all
    contests whole: made and stored part by part, once per session and folder."""
    key = (d.spark.sparkContext.applicationId, d.sf_dir)
    if key not in _KEPT:
        _KEPT[key] = features.stored_score_features(*_score_tables(d))
    return _KEPT[key]


@query("features_score_table", FEATURE_SQL)
def score_table_checked(d):
    out = score_table_by_parts(d).select("match_id", "league", *WIDE_COLUMNS)
    flags = ("is_playoff", "home_is_b2b", "away_is_b2b", "home_is_high_density", "away_is_high_density", "has_boxscore")
    return rounded(as_long(out, *flags), *ROUNDED)


#: Leagues of the tables, and whose column groups each of them stands in for.
STAND_INS = {"1-URGENT": "LegaA", "2-HIGH": "NBA", "3-MEDIUM": "LNB", "4-NOT SPECIFIED": "BBL", "5-LOW": None}
#: The columns that the model of each league may see.
ALLOWED = {x: columns.inputs_of(columns.league_groups(key), WIDE_COLUMNS) for x, key in STAND_INS.items()}
INPUT_COLUMNS = list(dict.fromkeys(c for cols in ALLOWED.values() for c in cols))
ALLOWED_SQL = ", ".join(f"('{x}', '{c}')" for x, cols in ALLOWED.items() for c in cols)
INPUTS_SQL = f"""
SELECT league, feature, v FROM (
  UNPIVOT (SELECT league, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in INPUT_COLUMNS)} FROM ({FEATURE_SQL}))
  ON {', '.join(INPUT_COLUMNS)} INTO NAME feature VALUE v)
WHERE (league, feature) IN (VALUES {ALLOWED_SQL})
"""


def _allowed() -> Column:
    out = F.lit(False)
    for league, cols in ALLOWED.items():
        out = out | ((F.col("league") == league) & F.col("feature").isin(cols))
    return out


@query("pf9_model_inputs", f"SELECT league, feature, count(v) AS n, round(sum(v), 3) AS total FROM ({INPUTS_SQL}) GROUP BY 1, 2")
def model_inputs(d):
    """Every input of every league's model: how often it is known, and its sum."""
    sums = [F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), F.sum(F.col(c).cast("double")).alias("total")) for c in INPUT_COLUMNS]

    def summed(table: DataFrame) -> DataFrame:
        table = rounded(table, *(c for c in INPUT_COLUMNS if c in ROUNDED))
        return table.groupBy("league").agg(F.array(*sums).alias("x")).select("league", F.inline("x"))

    kept = _KEPT.get((d.spark.sparkContext.applicationId, d.sf_dir))
    # both sides of all contests are not shuffled whole: a part of them is joined and summed up at a time
    parts = features.stored_score_features(*_score_tables(d), then=summed) if kept is None else summed(kept)
    out = parts.groupBy("league", "feature").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return out.where(_allowed() & (F.col("n") > 0)).withColumn("total", F.round("total", 3))


@query("pf10_group_columns", f"SELECT league, feature, count(v) AS n_known FROM ({INPUTS_SQL}) GROUP BY 1, 2")
def group_columns(d):
    """Known values of all columns that each league's model may see, from a table cut to them."""
    table = read_once(d)
    seen = {
        league: [c for c in columns.inputs_of(columns.league_groups(key), table.columns) if c not in columns.CATEGORIES]
        for league, key in STAND_INS.items()
    }
    every = list(dict.fromkeys(c for cols in seen.values() for c in cols))
    rows = table.where(F.col("league").isin(list(seen))).select("league", *every)
    known = rows.groupBy("league").agg(*[F.count(c).alias(c) for c in every])
    named = known.unpivot(["league"], every, "feature", "n_known").where("n_known > 0")
    allowed = F.lit(False)
    for league, cols in seen.items():
        allowed = allowed | ((F.col("league") == league) & F.col("feature").isin(cols))
    return named.where(allowed)


# -- the pace feature table -----------------------------------------------------------------------


def pace_table(d) -> DataFrame:
    contests = d.contests.withColumnRenamed("league", "tournament_name").drop("total_line", "total_line_open", "season_type")
    return features.pace_features(contests, d.periods, replace(FEATURES, playoff_start="1999-04-19"))


PACE_SUMS = ", ".join(
    f"coalesce(sum(CASE WHEN period_type = 'QUARTER' THEN {src} END), 0) AS q_{out}, "
    f"max(CASE WHEN period_type = 'GAME' THEN {src} END) AS g_{out}"
    for out, src in periods.BOX_COLUMNS.items()
)
PACE_Q = ", ".join(
    f"max(CASE WHEN period_type = 'QUARTER' AND period_number = {p} THEN {s}_pace END) AS q{p}_{s}_pace"
    for p in range(1, 5)
    for s in ("home", "away")
)


def _mean4(template: str) -> str:
    terms = [template.format(p) for p in range(1, 5)]
    return (
        f"({' + '.join(f'coalesce({t}, 0)' for t in terms)}) / "
        f"nullif({' + '.join(f'CASE WHEN {t} IS NULL THEN 0 ELSE 1 END' for t in terms)}, 0)"
    )


PACE_STATS_SQL = {
    "pace": ("home_pace", "away_pace"),
    "opp_pace": ("away_pace", "home_pace"),
    "ft_rate": ("home_fta / nullif(home_poss, 0)", "away_fta / nullif(away_poss, 0)"),
    "to_rate": ("home_to / nullif(home_poss, 0)", "away_to / nullif(away_poss, 0)"),
    "oreb_rate": ("home_off_reb / nullif(home_fga, 0)", "away_off_reb / nullif(away_fga, 0)"),
    "pts_per_poss": ("home_score_final / nullif(home_poss, 0)", "away_score_final / nullif(away_poss, 0)"),
    "pts_scored": ("home_score_final", "away_score_final"),
    "pts_allowed": ("away_score_final", "home_score_final"),
    "win": STATS["win"],
}


def _pace_side(i: int) -> str:
    cols = ", ".join(f"CAST({pair[i]} AS DOUBLE) AS {c}" for c, pair in PACE_STATS_SQL.items())
    side = ("home", "away")[i]
    return f"SELECT match_id, scheduled_at, {side}_team_id AS team_id, {'true' if i else 'false'} AS is_road, {cols} FROM stats"


PACE_OUT = [f"{c}_L{k}" for c in PACE_STATS_SQL for k in (3, 5, 10)]
PACE_SIDED = {f"{s}_{c}": f"{t}.{c}" for s, t in (("home", "h"), ("away", "a")) for c in PACE_OUT}
PACE_EXTRA = {
    "home_attack_strength": "h.pts_scored_L5 / l.pts",
    "away_attack_strength": "a.pts_scored_L5 / l.pts",
    "home_defense_strength": "h.pts_allowed_L5 / l.pts",
    "away_defense_strength": "a.pts_allowed_L5 / l.pts",
    "win_rate_diff_L5": "h.win_L5 - a.win_L5",
    "expected_matchup_pace": "h.pace_L5 + a.pace_L5 - l.pace",
    "q1_avg_pace": "q1_avg_pace",
    "game_avg_pace": "game_avg_pace",
}
PACE_COLUMNS = [*PACE_SIDED, *(c for c in PACE_EXTRA if c != "q1_avg_pace"), "is_playoff", "home_days_rest", "away_days_rest"]
PACE_VIEWS = dict(
    g=f"SELECT match_id, max(CASE WHEN period_type = 'QUARTER' THEN 1 ELSE 0 END) AS has_q, {PACE_SUMS}, {PACE_Q}, "
    "max(CASE WHEN period_type = 'GAME' THEN home_pace END) AS hg, max(CASE WHEN period_type = 'GAME' THEN away_pace END) AS ag "
    "FROM periods WHERE period_type IN ('QUARTER', 'GAME') GROUP BY match_id",
    stats="SELECT *, coalesce(q1_raw, game_avg_pace) AS q1_avg_pace FROM (SELECT c.*, "
    + ", ".join(f"CASE WHEN has_q = 1 THEN q_{o} ELSE g_{o} END AS {o}" for o in periods.BOX_COLUMNS)
    + f", coalesce({_mean4('q{}_home_pace')}, hg) AS home_pace, coalesce({_mean4('q{}_away_pace')}, ag) AS away_pace, "
    f"coalesce({_mean4('((q{0}_home_pace + q{0}_away_pace) / 2)')}, (hg + ag) / 2) AS game_avg_pace, "
    "(q1_home_pace + q1_away_pace) / 2 AS q1_raw FROM contests c LEFT JOIN g ON g.match_id = c.match_id)",
    rows_=f"{_pace_side(0)} UNION ALL {_pace_side(1)}",
    rolled=f"SELECT match_id, is_road, {GAP} AS rest, "
    + ", ".join(
        f"avg({c}) OVER ({W} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS {c}_L{k}"
        for c in PACE_STATS_SQL
        for k in (3, 5, 10)
    )
    + " FROM rows_",
    levels="SELECT league, (sum(home_score_final) + sum(away_score_final)) / (2.0E0 * count(*)) AS pts, "
    "avg(home_pace) AS pace FROM stats GROUP BY league",
)
PACE_SQL = sql(
    "contests periods",
    "SELECT s.match_id, h.rest AS home_days_rest, a.rest AS away_days_rest, "
    "CAST(s.scheduled_at >= TIMESTAMP '1999-04-19 00:00:00' AS BIGINT) AS is_playoff, "
    + ", ".join(f"round({e}, 6) AS {n}" for n, e in {**PACE_SIDED, **PACE_EXTRA}.items())
    + " FROM stats s JOIN rolled h ON h.match_id = s.match_id AND NOT h.is_road "
    "JOIN rolled a ON a.match_id = s.match_id AND a.is_road JOIN levels l ON l.league = s.league",
    **PACE_VIEWS,
)


@query("features_pace_table", PACE_SQL)
def pace_table_checked(d):
    cols = [*PACE_SIDED, *PACE_EXTRA]
    out = pace_table(d).select("match_id", "home_days_rest", "away_days_rest", "is_playoff", *cols)
    return rounded(as_long(out, "is_playoff"), *cols)


@query(
    "pf12_complete_cases",
    f"""
    SELECT count(*) AS n, round(sum(q1_avg_pace), 4) AS s_target, round(sum(home_pace_L10), 4) AS s_pace FROM ({PACE_SQL})
    WHERE q1_avg_pace IS NOT NULL AND home_days_rest IS NOT NULL AND away_days_rest IS NOT NULL
      AND {' AND '.join(f'{c} IS NOT NULL' for c in [*PACE_SIDED, *PACE_EXTRA])}
    """,
)
def complete_cases(d):
    out = features.complete_cases(pace_table(d))
    return out.agg(
        F.count("*").alias("n"),
        F.round(F.sum("q1_avg_pace"), 4).alias("s_target"),
        F.round(F.sum("home_pace_L10"), 4).alias("s_pace"),
    )


@query(
    "pf13_column_helpers",
    f"""
    SELECT unnest([{', '.join(f"'{c}'" for c in PACE_COLUMNS)}]) AS name, unnest([{', '.join(f'count({c})' for c in PACE_COLUMNS)}]) AS n_known
    FROM ({PACE_SQL})
    """,
)
def column_helpers(d):
    table = pace_table(d)
    inputs = columns.pace_inputs(table.columns)
    targets = [t for t in columns.target_columns()["game"] if t in table.columns and t != "game_total"]
    counts = table.agg(*[F.count(c).alias(c) for c in (*inputs, *targets)])
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n_known")) for c in (*inputs, *targets)]))
    return counts.select(named.alias("r")).select("r.name", "r.n_known")


def _dataset(d):
    return backtest.dataset(read_once(d))


@query(
    "pf3_pipeline_specs_settled",
    sql(
        "predictions",
        REPORT.replace("league, threshold", "spec, threshold"),
        specced="SELECT *, CASE league WHEN '1-URGENT' THEN 'one' ELSE 'rest' END AS spec "
        "FROM predictions WHERE actual <> line",
        settled=ALL_SETTLED.replace("FROM predictions p", "FROM specced p"),
    ),
)
def specs_settled(d):
    """Report of a fixed score over two league specs of the feature table."""
    rows = _dataset(d).select("match_id", "league").join(d.predictions.drop("league"), "match_id")
    rest = tables.apply_spec(rows, (), ("1-URGENT",)).withColumn("spec", F.lit("rest"))
    one = tables.apply_spec(rows, ("1-URGENT",)).withColumn("spec", F.lit("one"))
    return rounded(settle.sweep(one.unionByName(rest), ["spec"]), "profit", "winrate", "roi")
