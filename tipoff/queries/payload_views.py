"""Landed payloads derived from the given tables: one box score, event and set of odds per order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# block label per line number; 7 is a label no mapping knows
LABELS = {1: "1ST", 2: "2ND", 3: "3RD", 4: "4th", 5: "OT", 6: "ALL", 7: "1H"}

# display text per metric and side, over the columns of the ``lines`` view
TEXTS = {
    "Field Goals": (
        "CASE WHEN rmax = 'R' THEN '' ELSE concat(q % 15, '/', 15 + q % 12, ' (5%)') END",
        "CASE WHEN rmin = 'A' THEN '' ELSE concat(k % 16, '/', 15 + k % 12) END",
    ),
    "Free throws": (
        "concat(1 + x % 5, ' / ', 2 + x % 7, ' (9%)')",
        "concat(s % 3, '/', 2 + s % 7)",
    ),
    "3-Pointers": ("concat(x % 12, '/', x % 17)", "concat(s % 5, '/', 5 + s % 17)"),
    "Offensive rebounds": ("concat(' ', q % 5, ' ')", "concat('', k % 5)"),
    "Turnovers": ("CASE WHEN rmax = 'R' THEN 'n/a' ELSE concat('', x % 6) END", "concat('', s % 6)"),
    "Defensive rebounds": ("concat('', 20 + q % 9)", "concat('', 20 + k % 9)"),
}
GROUPS = (("Shooting", ("Field Goals", "Free throws", "3-Pointers")),
          ("Other", ("Offensive rebounds", "Turnovers", "Defensive rebounds")))


def _label() -> Column:
    pairs = [F.lit(x) for item in LABELS.items() for x in item]
    return F.element_at(F.create_map(*pairs), F.col("n"))


def statistics(lines: DataFrame) -> DataFrame:
    """(match_id, payload): statistics JSON with one block per period, first to last line."""

    def item(name: str) -> Column:
        home, away = TEXTS[name]
        return F.struct(
            F.lit(name).alias("name"), F.expr(home).alias("home"), F.expr(away).alias("away")
        )

    groups = F.array(
        *[
            F.struct(
                F.lit(group).alias("groupName"),
                F.array(*[item(m) for m in names]).alias("statisticsItems"),
            )
            for group, names in GROUPS
        ]
    )
    block = F.struct("n", _label().alias("period"), groups.alias("groups"))
    # at most seven blocks per match
    blocks = lines.groupBy("match_id").agg(F.sort_array(F.collect_list(block)).alias("b"))
    plain = F.transform("b", lambda b: F.struct(b["period"].alias("period"), b["groups"].alias("groups")))
    return blocks.select("match_id", F.to_json(F.struct(plain.alias("statistics"))).alias("payload"))


SCORES = {
    **{f"period{p}": f"max(CASE WHEN n = {p} THEN {{0}} END)" for p in range(1, 8)},
    "overtime": "max(CASE WHEN n = 5 THEN {0} END)",
}
SIDE_SCORE = {"home": "q", "away": "x % 40"}

EVENT_FIELDS = {
    "home_name": "CASE WHEN match_id % 23 = 0 THEN '' ELSE concat('Team ', home_team_id) END",
    "away_name": "concat('Real Club ', away_team_id, ' FC')",
    "home_short": "CASE WHEN match_id % 4 = 0 THEN NULL ELSE concat('T', home_team_id) END",
    "start": "CASE WHEN match_id % 31 = 0 THEN 0 ELSE 788918400 + match_id * 3607 END",
    "season_name": "CASE WHEN match_id % 13 = 0 THEN NULL ELSE season_type END",
    "status_type": "CASE match_id % 5 WHEN 3 THEN 'inprogress' WHEN 4 THEN 'postponed' ELSE 'finished' END",
    "home_normal": "home_score_final - match_id % 3",
    "away_normal": "away_score_final - match_id % 3",
}


def events(contests: DataFrame, lines: DataFrame) -> DataFrame:
    """(match_id, payload): event JSON with teams, score objects, start, season and status."""
    aggs = [
        F.expr(text.format(expr)).alias(f"{side}_{name}")
        for side, expr in SIDE_SCORE.items()
        for name, text in SCORES.items()
    ]
    scores = lines.groupBy("match_id").agg(*aggs)
    df = contests.join(scores, "match_id", "left").withColumns(
        {name: F.expr(expr) for name, expr in EVENT_FIELDS.items()}
    )

    def score(side: str) -> Column:
        parts = [F.col(f"{side}_{name}").alias(name) for name in SCORES]
        return F.struct(
            F.col(f"{side}_score_final").alias("current"),
            F.col(f"{side}_normal").alias("normaltime"),
            *parts,
        )

    def team(side: str) -> Column:
        short = [F.col("home_short").alias("shortName")] if side == "home" else []
        return F.struct(
            F.col(f"{side}_team_id").alias("id"), F.col(f"{side}_name").alias("name"), *short
        )

    event = F.struct(
        F.col("match_id").alias("id"),
        team("home").alias("homeTeam"),
        team("away").alias("awayTeam"),
        score("home").alias("homeScore"),
        score("away").alias("awayScore"),
        F.col("start").alias("startTimestamp"),
        F.struct(F.col("season_name").alias("name")).alias("season"),
        F.struct(F.col("status_type").alias("type")).alias("status"),
    )
    return df.select("match_id", F.to_json(F.struct(event.alias("event"))).alias("payload"))


# one opportunity per line item; its place in the answer follows these columns
ODDS = {
    "bookmaker": "l_linenumber % 3",
    "over": "CASE WHEN l_tax = 0 THEN 'n/a' ELSE concat('', 1.5E0 + (CAST(l_quantity AS BIGINT) % 10) / 10.0E0) END",
    "under": "concat('', 1.5E0 + (l_partkey % 10) / 10.0E0)",
    "handicap": "concat('', 180.5E0 + l_suppkey % 20)",
}
ODDS_ORDER = ("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_tax", "l_discount")


def lines_payload(lineitem: DataFrame) -> DataFrame:
    """(match_id, payload): one odds answer JSON per order and bookmaker."""

    def value(name: str) -> Column:
        return F.struct(F.expr(ODDS[name]).alias("value")).alias(name)

    opp = F.struct(*[F.col(c) for c in ODDS_ORDER], F.struct(value("over"), value("under"), value("handicap")).alias("o"))
    keyed = lineitem.withColumn("bookmaker", F.expr(ODDS["bookmaker"]))
    # line items of one order
    rows = keyed.groupBy(F.col("l_orderkey").alias("match_id"), "bookmaker").agg(
        F.sort_array(F.collect_list(opp)).alias("p")
    )
    answer = F.struct(
        F.col("bookmaker").cast("string").alias("bookmakerId"),
        F.transform("p", lambda p: p["o"]).alias("opportunities"),
    )
    data = F.struct(F.struct(answer.alias("findPrematchOddsForBookmaker")).alias("data"))
    return rows.select("match_id", F.to_json(data).alias("payload"))
