"""The contest tables as views over the given star-schema tables.

An order plays the contest and its line items the periods. Each view is a list of column
expressions that Spark and the checking SQL engine read alike; ``sql`` renders the views a
query needs as common table expressions.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOME_ID = "o_custkey % 150"
AWAY_ID = "(o_custkey % 150 + 1 + o_orderkey % 149) % 150"
HOME_SCORE = "70 + CAST(floor(o_totalprice) AS BIGINT) % 60"
AWAY_SCORE = "70 + CAST(floor(o_totalprice / 7) AS BIGINT) % 60"
SEASON_TYPE = (
    "CASE o_orderstatus WHEN 'F' THEN 'PLAYOFFS' WHEN 'P' THEN 'PRESEASON' ELSE 'REGULAR' END"
)
LINE = "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 180.0E0 + (o_orderkey % 41) END"
LINE_OPEN = "CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE 178.0E0 + (o_orderkey % 43) END"

CONTESTS = {
    "match_id": "o_orderkey",
    "scheduled_at": "CAST(o_orderdate AS TIMESTAMP)",
    "home_team_id": HOME_ID,
    "away_team_id": AWAY_ID,
    "home_score_final": HOME_SCORE,
    "away_score_final": AWAY_SCORE,
    "league": "o_orderpriority",
    "season_type": SEASON_TYPE,
    "total_line": LINE,
    "total_line_open": LINE_OPEN,
}

# contests as they are stored, with the gaps a store has
MATCHES = {
    **{k: v for k, v in CONTESTS.items() if k not in ("league", "home_score_final", "away_score_final")},
    "home_score_final": f"CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE {HOME_SCORE} END",
    "away_score_final": f"CASE WHEN o_orderkey % 193 = 0 THEN NULL ELSE {AWAY_SCORE} END",
    "tournament_name": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END",
    "season": "CASE o_orderkey % 4 WHEN 0 THEN 'Cup 25/26' WHEN 1 THEN 'Cup 24/25' "
    "WHEN 2 THEN 'Cup 23/24' ELSE 'Cup 2022' END",
    "external_id": "CASE WHEN o_orderkey % 3 = 0 THEN concat('fs_', o_orderkey) "
    "WHEN o_orderkey % 29 = 1 THEN NULL ELSE concat('', o_orderkey) END",
    "listing_id": "CASE WHEN o_orderkey % 5 = 2 THEN NULL ELSE concat('L', o_orderkey) END",
    "has_quarter_breakdown": "o_orderkey % 7 <> 0",
    "went_to_overtime": "o_orderkey % 19 = 0",
}

TEAMS = {"team_id": "c_custkey % 150", "name": "min(c_name)"}

# (l_orderkey, l_linenumber) repeats in the data: order-free aggregates make it a key
LINES = {
    "match_id": "l_orderkey",
    "n": "l_linenumber",
    "q": "CAST(max(l_quantity) AS BIGINT)",
    "x": "CAST(floor(max(l_extendedprice)) AS BIGINT)",
    "k": "max(l_partkey)",
    "s": "max(l_suppkey)",
    "rmax": "max(l_returnflag)",
    "rmin": "min(l_returnflag)",
}

PERIOD_BOX = {
    "match_id": "match_id",
    "period_number": "CASE WHEN n <= 4 THEN n WHEN n <= 6 THEN n - 4 ELSE 1 END",
    "period_type": "CASE WHEN n <= 4 THEN 'QUARTER' WHEN n <= 6 THEN 'OVERTIME' ELSE 'GAME' END",
    "home_score": "q",
    "away_score": "x % 40",
    "home_fga": "CASE WHEN rmax = 'R' THEN NULL ELSE 15 + q % 12 END",
    "away_fga": "CASE WHEN rmin = 'A' THEN NULL ELSE 15 + k % 12 END",
    "home_fta": "2 + x % 7",
    "away_fta": "2 + s % 7",
    "home_off_reb": "q % 5",
    "away_off_reb": "k % 5",
    "home_turnovers": "CASE WHEN rmax = 'R' THEN NULL ELSE x % 6 END",
    "away_turnovers": "s % 6",
    "pace_factor": "CASE WHEN n <= 4 THEN 4.0E0 WHEN n <= 6 THEN 8.0E0 ELSE 1.0E0 END",
}

_POSS = "({0}_fga + 0.44E0 * {0}_fta - {0}_off_reb + {0}_turnovers)"
PERIODS = {
    **{k: k for k in PERIOD_BOX if k != "pace_factor"},
    "home_possessions": _POSS.format("home"),
    "away_possessions": _POSS.format("away"),
    "home_pace": f"{_POSS.format('home')} * pace_factor",
    "away_pace": f"{_POSS.format('away')} * pace_factor",
}


def _advanced(side: str, other: str, modulus: int) -> dict[str, str]:
    poss = f"(90.0E0 + match_id % {modulus})"
    return {
        "match_id": "match_id",
        "team_id": f"{side}_team_id",
        "possessions": poss,
        "turnovers": "match_id % 15",
        "three_pointers_made": "match_id % 10",
        "three_pointers_attempted": f"20 + match_id % {modulus}",
        "offensive_rating": f"{side}_score_final / {poss} * 100",
        "defensive_rating": f"{other}_score_final / {poss} * 100",
    }


ADVANCED = (_advanced("home", "away", 20), _advanced("away", "home", 17))
HAS_ADVANCED = "match_id % 3 = 0"

APPEARANCES = (
    {
        "match_id": "match_id",
        "team_id": "home_team_id",
        "scheduled_at": "scheduled_at",
        "league": "league",
        "is_road": "false",
        "pts": "home_score_final",
        "opp": "away_score_final",
    },
    {
        "match_id": "match_id",
        "team_id": "away_team_id",
        "scheduled_at": "scheduled_at",
        "league": "league",
        "is_road": "true",
        "pts": "away_score_final",
        "opp": "home_score_final",
    },
)

PREDICTIONS = {
    "match_id": "match_id",
    "league": "league",
    "scheduled_at": "scheduled_at",
    "prob": "0.30E0 + (match_id * 7919 % 41) / 100.0E0",
    "actual": "home_score_final + away_score_final",
    "line": "total_line",
}


def _cols(columns: dict[str, str]) -> list[str]:
    return [f"{expr} AS {name}" for name, expr in columns.items()]


def _select(columns: dict[str, str], source: str, tail: str = "") -> str:
    return f"SELECT {', '.join(_cols(columns))} FROM {source} {tail}".strip()


_VIEW_SQL = {
    "contests": (_select(CONTESTS, "orders"), ()),
    "matches": (_select(MATCHES, "orders"), ()),
    "teams": (_select(TEAMS, "customer", "GROUP BY c_custkey % 150"), ()),
    "lines": (_select(LINES, "lineitem", "GROUP BY l_orderkey, l_linenumber"), ()),
    "period_box": (_select(PERIOD_BOX, "lines"), ("lines",)),
    "periods": (_select(PERIODS, "period_box"), ("period_box",)),
    "advanced": (
        " UNION ALL ".join(_select(a, "contests", f"WHERE {HAS_ADVANCED}") for a in ADVANCED),
        ("contests",),
    ),
    "appearances": (" UNION ALL ".join(_select(a, "contests") for a in APPEARANCES), ("contests",)),
    "predictions": (_select(PREDICTIONS, "contests", "WHERE total_line IS NOT NULL"), ("contests",)),
}


def sql(views: str, body: str, **more: str) -> str:
    """``body`` preceded by the views it names and by further expressions in order."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for dep in _VIEW_SQL[name][1]:
            need(dep)
        if name not in ordered:
            ordered.append(name)

    for name in views.split():
        need(name)
    parts = [f"{name} AS ({_VIEW_SQL[name][0]})" for name in ordered]
    parts += [f"{name} AS ({text})" for name, text in more.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


class Data:
    """The given tables of one folder and the contest views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def contests(self) -> DataFrame:
        return self.table("orders").selectExpr(*_cols(CONTESTS))

    @cached_property
    def matches(self) -> DataFrame:
        return self.table("orders").selectExpr(*_cols(MATCHES))

    @cached_property
    def teams(self) -> DataFrame:
        keyed = self.table("customer").selectExpr("c_custkey % 150 AS team_id", "c_name")
        return keyed.groupBy("team_id").agg(F.min("c_name").alias("name"))

    @cached_property
    def lines(self) -> DataFrame:
        aggs = [
            F.expr(expr).alias(name) for name, expr in LINES.items() if name not in ("match_id", "n")
        ]
        # dealt by order, so that what groups or joins the lines of a contest moves them no second time
        return (
            self.table("lineitem")
            .repartition("l_orderkey")
            .groupBy(F.col("l_orderkey").alias("match_id"), F.col("l_linenumber").alias("n"))
            .agg(*aggs)
        )

    @cached_property
    def periods(self) -> DataFrame:
        return self.lines.selectExpr(*_cols(PERIOD_BOX)).selectExpr(*_cols(PERIODS))

    @cached_property
    def advanced(self) -> DataFrame:
        rows = self.contests.where(HAS_ADVANCED)
        home, away = (rows.selectExpr(*_cols(a)) for a in ADVANCED)
        return home.unionByName(away)

    @cached_property
    def predictions(self) -> DataFrame:
        return self.contests.where("total_line IS NOT NULL").selectExpr(*_cols(PREDICTIONS))

    def appearances(self, *stats: str, keep: tuple[str, ...] = ()) -> DataFrame:
        from tipoff.operators.timeline import appearances

        own, opp = F.col("home_score_final"), F.col("away_score_final")
        known = {
            "pts": (own, opp),
            "opp": (opp, own),
            "win": ((own > opp).cast("double"), (opp > own).cast("double")),
        }
        return appearances(self.contests, {s: known[s] for s in stats}, keep)
