"""Text, payload, linking and stream queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tipoff.config import PERIOD_LABELS, STATUS_BY_SOURCE
from tipoff.functions import boxmath, parse, text
from tipoff.operators import linking
from tipoff.queries import payload_views as views
from tipoff.queries.registry import as_long, query, rounded
from tipoff.queries.views import sql
from tipoff.session import fresh_path
from tipoff.sources import payloads, sinks
from tipoff.streaming import enrichment

# -- names -------------------------------------------------------------------------------------

FOLDED = "replace(lower(strip_accents({0})), 'ß', 'ss')"


def _norm_sql(column: str) -> str:
    out = FOLDED.format(column)
    out = rf"regexp_replace({out}, '\bla\b', 'los angeles', 'g')"
    out = rf"regexp_replace({out}, '\b({text.STOP_WORDS})\b', ' ', 'g')"
    out = rf"regexp_replace({out}, '\b\d+\b', ' ', 'g')"
    out = f"regexp_replace({out}, '[^a-z0-9 ]', ' ', 'g')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


@query(
    "fn1_normalise_documents",
    f"SELECT doc_id, {_norm_sql('text')} AS norm FROM documents",
)
def normalise_documents(d):
    return d.table("documents").select("doc_id", text.normalise_name(F.col("text")).alias("norm"))


@query(
    "fn1_normalise_exact",
    f"SELECT conv_id, turn, {_norm_sql('text')} AS norm FROM conversations",
)
def normalise_exact(d):
    norm = text.normalise_name(F.col("text"))
    return d.table("conversations").select("conv_id", "turn", norm.alias("norm"))


SIM = """
CASE WHEN least(len({0}), len({1})) = 0 THEN 0.0E0
     WHEN len(list_intersect({0}, {1})) = least(len({0}), len({1})) THEN
       greatest(len(list_intersect({0}, {1})) / greatest(len({0}), len({1}))::DOUBLE,
                0.5E0 + 0.25E0 * (least(len({0}), len({1})) / greatest(len({0}), len({1}))::DOUBLE))
     ELSE len(list_intersect({0}, {1})) / greatest(len({0}), len({1}))::DOUBLE END
"""


def _tokens_sql(column: str) -> str:
    return f"list_distinct(list_filter(string_split({column}, ' '), lambda t: t <> ''))"


@query(
    "fn2_token_similarity",
    f"""
    SELECT doc_id, round({SIM.format('a', 'b')}, 6) AS sim
    FROM (SELECT x.doc_id, {_tokens_sql('x.n')} AS a, {_tokens_sql('y.n')} AS b
          FROM (SELECT doc_id, {_norm_sql('text')} AS n FROM documents) x
          JOIN (SELECT doc_id - 1 AS doc_id, {_norm_sql('text')} AS n FROM documents) y ON y.doc_id = x.doc_id)
    """,
)
def token_similarity(d):
    docs = d.table("documents").select(
        "doc_id", text.tokens(text.normalise_name(F.col("text"))).alias("a")
    )
    shifted = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    sim = text.token_similarity(F.col("a"), F.col("b"))
    return rounded(docs.join(shifted, "doc_id").select("doc_id", sim.alias("sim")), "sim")


@query(
    "fn3_pair_score",
    f"""
    SELECT p_partkey, round(({SIM.format('hn', 'hm')} + {SIM.format('an', 'am')}) / 2, 6) AS score
    FROM (SELECT x.p_partkey, {_tokens_sql('x.p_name')} AS hn, {_tokens_sql('y.p_name')} AS hm,
                 {_tokens_sql('lower(x.p_type)')} AS an, {_tokens_sql('lower(y.p_type)')} AS am
          FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1)
    """,
)
def pair_score(d):
    part = d.table("part").select("p_partkey", "p_name", F.lower("p_type").alias("p_type"))
    nxt = part.select(
        (F.col("p_partkey") - 1).alias("p_partkey"),
        F.col("p_name").alias("n2"),
        F.col("p_type").alias("t2"),
    )
    score = linking.direct_score(F.col("p_name"), F.col("p_type"), F.col("n2"), F.col("t2"))
    return rounded(part.join(nxt, "p_partkey").select("p_partkey", score.alias("score")), "score")


# -- display text ------------------------------------------------------------------------------

TODAY = dt.date(2001, 8, 15)
LISTING = """
CASE o_orderkey % 5
  WHEN 0 THEN concat(lpad(concat('', day(o_orderdate)), 2, '0'), '.', lpad(concat('', month(o_orderdate)), 2, '0'),
                     '.', year(o_orderdate), ' 19:', lpad(concat('', o_orderkey % 60), 2, '0'))
  WHEN 1 THEN concat(' ', day(o_orderdate), '.', month(o_orderdate), '.', year(o_orderdate))
  WHEN 2 THEN concat(day(o_orderdate), '.', month(o_orderdate), '. 08:30')
  WHEN 3 THEN concat(day(o_orderdate), '.', month(o_orderdate), '.')
  ELSE concat('32.', month(o_orderdate), '.', year(o_orderdate), ' finished') END
"""


def _on(year: int, clock: str) -> str:
    return f"concat('{year}-', month(o_orderdate), '-', day(o_orderdate), ' {clock}')"


RECENT = """
(CASE WHEN try_cast(concat('2001-', month(o_orderdate), '-', day(o_orderdate)) AS DATE) <= DATE '2001-08-15'
      THEN try_cast(concat('2001-', month(o_orderdate), '-', day(o_orderdate)) AS DATE)
      WHEN DATE '2001-08-15' - try_cast(concat('2000-', month(o_orderdate), '-', day(o_orderdate)) AS DATE) <= 540
      THEN try_cast(concat('2000-', month(o_orderdate), '-', day(o_orderdate)) AS DATE) END)
"""


@query(
    "fn4_listing_timestamp",
    f"""
    SELECT o_orderkey AS match_id, CAST(epoch(CASE o_orderkey % 5
        WHEN 0 THEN date_trunc('day', o_orderdate) + INTERVAL 19 HOUR + to_minutes(o_orderkey % 60)
        WHEN 1 THEN date_trunc('day', o_orderdate) + INTERVAL 12 HOUR
        WHEN 2 THEN {RECENT} + INTERVAL 510 MINUTE
        WHEN 3 THEN {RECENT} + INTERVAL 12 HOUR END) AS BIGINT) AS at
    FROM orders
    """.replace(" AS at", ' AS "at"'),
)
def listing_timestamp(d):
    shown = d.table("orders").select("o_orderkey", F.expr(LISTING).alias("shown"))
    at = parse.listing_timestamp(F.col("shown"), TODAY)
    return shown.select(F.col("o_orderkey").alias("match_id"), F.unix_seconds(at).alias("at"))


@query(
    "fn5_season_date",
    f"""
    SELECT o_orderkey AS match_id, CASE WHEN o_orderkey % 2 = 0 THEN {RECENT} ELSE try_cast(concat(
        CASE WHEN month(o_orderdate) >= 7 THEN year(o_orderdate) ELSE year(o_orderdate) + 1 END, '-',
        month(o_orderdate), '-', day(o_orderdate)) AS DATE) END AS match_date
    FROM orders
    """,
)
def season_date(d):
    rows = d.table("orders").select(
        "o_orderkey",
        F.expr("concat(day(o_orderdate), '.', month(o_orderdate), '. 20:00')").alias("shown"),
        F.expr(
            "CASE WHEN o_orderkey % 2 = 0 THEN '/cup/results/' ELSE concat('/cup-', year(o_orderdate), "
            "'-', year(o_orderdate) + 1, '/results/') END"
        ).alias("url"),
    )
    day = parse.listing_date(F.col("shown"), F.col("url"), TODAY)
    return rows.select(F.col("o_orderkey").alias("match_id"), day.alias("match_date"))


@query(
    "fn6_abbreviation",
    """
    SELECT p_partkey, upper(list_aggregate(list_transform(string_split(p_name, ' ')[1:3], lambda t: t[1]),
           'string_agg', '')) AS abbr, upper(substring(p_type, 1, 3)) AS type_abbr FROM part
    """,
)
def abbreviations(d):
    return d.table("part").select(
        "p_partkey",
        text.abbreviation(F.col("p_name")).alias("abbr"),
        text.abbreviation(F.col("p_type")).alias("type_abbr"),
    )


SHOT = """
CASE l_linenumber WHEN 1 THEN concat(CAST(l_quantity AS BIGINT), '/', l_suppkey % 40, ' (5%)')
  WHEN 2 THEN concat(' ', CAST(l_quantity AS BIGINT), ' / ', l_suppkey % 40) WHEN 3 THEN concat('', l_suppkey)
  WHEN 4 THEN concat(CAST(l_quantity AS BIGINT), '/', l_suppkey % 40, '(5%)') WHEN 5 THEN 'x/y'
  WHEN 6 THEN '' ELSE concat(CAST(l_quantity AS BIGINT), '/', l_suppkey % 40, '/1') END
"""


@query(
    "fn7_shot_text",
    """
    SELECT l_orderkey, l_linenumber, CAST(sum(lm) AS BIGINT) AS lenient_made, CAST(sum(lt) AS BIGINT) AS lenient_tried,
           CAST(sum(att) AS BIGINT) AS attempts, CAST(sum(sm) AS BIGINT) AS strict_made,
           CAST(sum(st) AS BIGINT) AS strict_tried
    FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
        CASE WHEN l_linenumber IN (1, 2, 7) THEN q ELSE 0 END AS lm,
        CASE WHEN l_linenumber IN (1, 2, 7) THEN t ELSE 0 END AS lt,
        CASE WHEN l_linenumber IN (1, 2, 7) THEN t WHEN l_linenumber = 3 THEN l_suppkey END AS att,
        CASE WHEN l_linenumber IN (1, 2, 4) AND q <= t THEN q END AS sm,
        CASE WHEN l_linenumber IN (1, 2, 4) AND q <= t THEN t END AS st
      FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q, l_suppkey % 40 AS t FROM lineitem)) GROUP BY 1, 2
    """,
)
def shot_text(d):
    rows = d.table("lineitem").withColumn("shown", F.expr(SHOT))
    lenient, strict = parse.shot_lenient(F.col("shown")), parse.shot_strict(F.col("shown"))
    return rows.groupBy("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber")).agg(
        F.sum(lenient[0]).alias("lenient_made"),
        F.sum(lenient[1]).alias("lenient_tried"),
        F.sum(parse.shot_attempts(F.col("shown"))).alias("attempts"),
        F.sum(strict[0]).alias("strict_made"),
        F.sum(strict[1]).alias("strict_tried"),
    )


@query(
    "fn8_safe_integers",
    """
    SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CAST(floor(c_acctbal) AS BIGINT) WHEN 1 THEN c_custkey END AS n,
           CASE c_custkey % 4 WHEN 0 THEN CASE WHEN floor(c_acctbal) >= 0 THEN CAST(floor(c_acctbal) AS BIGINT) END
                              WHEN 1 THEN c_custkey END AS n_count
    FROM customer
    """,
)
def safe_integers(d):
    shown = F.expr(
        "CASE c_custkey % 4 WHEN 0 THEN concat(' ', CAST(floor(c_acctbal) AS BIGINT), ' ') "
        "WHEN 1 THEN concat('+', c_custkey) WHEN 2 THEN concat(c_custkey, '.5') ELSE c_name END"
    )
    return d.table("customer").select(
        "c_custkey",
        parse.integer(shown).cast("bigint").alias("n"),
        parse.count_of(shown).cast("bigint").alias("n_count"),
    )


@query(
    "fn9_possessions",
    sql(
        "periods",
        "SELECT match_id, period_type, CAST(period_number AS BIGINT) AS period_number, "
        "round(home_possessions, 6) AS home_possessions, round(away_possessions, 6) AS away_possessions FROM periods",
    ),
)
def possessions(d):
    sides = {
        f"{side}_possessions": boxmath.possessions(*[F.col(f"{side}_{c}") for c in ("fga", "fta", "off_reb", "turnovers")])
        for side in ("home", "away")
    }
    out = d.periods.select("match_id", "period_type", "period_number", *[v.alias(k) for k, v in sides.items()])
    return as_long(rounded(out, *sides), "period_number")


@query(
    "fn10_pace",
    sql(
        "periods",
        "SELECT match_id, period_type, CAST(period_number AS BIGINT) AS period_number, "
        + ", ".join(
            f"round({side}_possessions / CASE period_type WHEN 'QUARTER' THEN 10 WHEN 'OVERTIME' THEN 5 ELSE 40 END * 40, 2) AS {side}_pace"
            for side in ("home", "away")
        )
        + " FROM periods",
    ),
)
def pace(d):
    sides = [boxmath.pace(F.col(f"{s}_possessions"), F.col("period_type")).alias(f"{s}_pace") for s in ("home", "away")]
    return as_long(d.periods.select("match_id", "period_type", "period_number", *sides), "period_number")


@query(
    "fn18_prefixed_keys",
    "SELECT o_orderkey AS match_id, concat('fs_', o_orderkey) AS external_id, "
    "substring(concat('fs_', o_orderkey, '-', o_orderpriority), 1, 8) AS short_id FROM orders",
)
def prefixed_keys(d):
    long_id = F.concat(F.col("o_orderkey").cast("string"), F.lit("-"), F.col("o_orderpriority"))
    return d.table("orders").select(
        F.col("o_orderkey").alias("match_id"),
        text.prefixed_id("fs_", F.col("o_orderkey")).alias("external_id"),
        text.prefixed_id("fs_", long_id, 8).alias("short_id"),
    )


@query(
    "fn19_epoch_seconds",
    "SELECT o_orderkey AS match_id, CAST(to_timestamp(788918400 + o_orderkey * 3607) AT TIME ZONE 'UTC' AS DATE) AS day FROM orders",
)
def epoch_seconds(d):
    at = parse.event_time(F.lit(788918400) + F.col("o_orderkey") * 3607)
    return d.table("orders").select(F.col("o_orderkey").alias("match_id"), F.to_date(at).alias("day"))


# -- box-score payloads ------------------------------------------------------------------------

#: Landed files are text that says the same words in every line.
LANDED = "gzip"


def statistics(d):
    rows = views.statistics(d.lines)
    return rows.withColumn("statistics", payloads.parse_statistics(F.col("payload")))


def event_payloads(d):
    rows = views.events(d.contests, d.lines)
    return rows.withColumn("event", payloads.parse_event(F.col("payload")))


def _with_scores(d):
    events = event_payloads(d).select(
        F.col("match_id").alias("event_id"),
        F.col("event.homeScore").alias("home_score"),
        F.col("event.awayScore").alias("away_score"),
    )
    stats = statistics(d).select(F.col("match_id").alias("event_id"), "statistics")
    return stats.join(events, "event_id")


@query(
    "src4_nested_payload",
    sql(
        "lines",
        "SELECT match_id, count(*) AS n_blocks, count(*) * 6 AS n_items FROM lines GROUP BY match_id",
    ),
)
def nested_payload(d):
    path = fresh_path(d.spark, "landing")
    views.statistics(d.lines).select("match_id", F.from_json("payload", "statistics variant").alias("p")).select(
        "match_id", F.to_json("p").alias("payload")
    ).write.option("compression", LANDED).json(path)
    rows = payloads.read_json(d.spark, path, "match_id bigint, payload string")
    rows = rows.select("match_id", payloads.parse_statistics(F.col("payload")).alias("statistics"))
    blocks = F.col("statistics")
    items = F.aggregate(
        blocks,
        F.lit(0),
        lambda acc, b: acc + F.size(F.flatten(F.transform(b["groups"], lambda g: g["statisticsItems"]))),
    )
    return rows.select(
        "match_id",
        F.size(blocks).cast("bigint").alias("n_blocks"),
        items.cast("bigint").alias("n_items"),
    )


@query(
    "fn11_metric_lookup",
    sql(
        "lines",
        """
        SELECT match_id, CAST(n AS BIGINT) AS block, CASE WHEN rmax = 'R' THEN '' ELSE concat(q % 15, '/', 15 + q % 12, ' (5%)') END AS home_fg,
               concat('', s % 6) AS away_turnovers FROM lines
        """,
    ),
)
def metric_lookup(d):
    codes = {label: n for n, label in views.LABELS.items()}
    number = F.element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), F.col("b.period"))
    rows = statistics(d).select("match_id", F.explode("statistics").alias("b"))
    return rows.select(
        "match_id",
        number.cast("bigint").alias("block"),
        payloads.metric(payloads.metric_items(F.col("b")), "field goals", "home").alias("home_fg"),
        payloads.metric(payloads.metric_items(F.col("b")), "turnovers", "away").alias("away_turnovers"),
    )


LABEL_VALUES = ", ".join(f"('{label}', {n}, '{kind}', '{key}')" for label, n, kind, key in PERIOD_LABELS)


@query(
    "fn12_period_labels",
    sql(
        "lines",
        f"""
        SELECT l.match_id, t.label, CAST(v.num AS BIGINT) AS period_number, v.kind AS period_type, v.k AS score_key
        FROM lines l JOIN (VALUES (1, '1st'), (2, '2Q'), (3, '3RD'), (4, '4TH'), (5, 'ot2'), (6, 'ALL'), (7, '3OT')) t(n, label)
             ON t.n = l.n LEFT JOIN (VALUES {LABEL_VALUES}) v(label, num, kind, k) ON v.label = upper(t.label)
        """,
    ),
)
def period_labels(d):
    shown = {1: "1st", 2: "2Q", 3: "3RD", 4: "4TH", 5: "ot2", 6: "ALL", 7: "3OT"}
    label = F.element_at(F.create_map(*[F.lit(x) for kv in shown.items() for x in kv]), F.col("n"))
    rows = d.lines.select("match_id", label.alias("label"))
    return rows.select(
        "match_id",
        "label",
        payloads.period_number(F.col("label")).cast("bigint").alias("period_number"),
        payloads.period_type(F.col("label")).alias("period_type"),
        payloads.score_key(F.col("label")).alias("score_key"),
    )


@query(
    "fn13_period_rows",
    sql(
        "contests lines period_box",
        """
        SELECT event_id, CAST(period_number AS BIGINT) AS period_number, period_type, home_score, away_score,
               home_fga, away_fta, round(hp, 6) AS home_possessions, round(ap, 6) AS away_possessions, breakdown AS has_quarter_breakdown
        FROM (
          SELECT b.match_id AS event_id, l.n,
                 CASE WHEN l.n <= 4 THEN l.n ELSE 1 END AS period_number,
                 CASE WHEN l.n <= 4 THEN 'QUARTER' WHEN l.n = 5 THEN 'OVERTIME' ELSE 'GAME' END AS period_type,
                 CASE WHEN l.n <= 5 THEN l.q ELSE c.home_score_final END AS home_score,
                 CASE WHEN l.n <= 5 THEN l.x % 40 ELSE c.away_score_final END AS away_score,
                 b.home_fga, b.away_fta, min(l.n) OVER (PARTITION BY l.match_id) <= 5 AS breakdown,
                 b.home_fga + 0.44E0 * b.home_fta - b.home_off_reb + b.home_turnovers AS hp,
                 b.away_fga + 0.44E0 * b.away_fta - b.away_off_reb + b.away_turnovers AS ap
          FROM lines l JOIN contests c ON c.match_id = l.match_id
          JOIN (SELECT *, CASE period_type WHEN 'QUARTER' THEN period_number WHEN 'OVERTIME' THEN period_number + 4 ELSE 7 END AS n
                FROM period_box) b ON b.match_id = l.match_id AND b.n = l.n)
        WHERE n <= 5 OR (n = 6 AND NOT breakdown AND (hp IS NOT NULL OR ap IS NOT NULL))
        """,
    ),
)
def period_rows(d):
    out = payloads.period_rows(_with_scores(d)).select(
        "event_id",
        "period_number",
        "period_type",
        "home_score",
        "away_score",
        "home_fga",
        "away_fta",
        "home_possessions",
        "away_possessions",
        "has_quarter_breakdown",
    )
    out = as_long(out, "period_number", "home_score", "away_score", "home_fga", "away_fta")
    return rounded(out, "home_possessions", "away_possessions")


@query(
    "fn14_score_rows",
    sql(
        "contests lines",
        """
        SELECT l.match_id AS event_id, CAST(CASE WHEN n <= 4 THEN n ELSE n - 4 END AS BIGINT) AS period_number,
               CASE WHEN n <= 4 THEN 'QUARTER' ELSE 'OVERTIME' END AS period_type, q AS home_score, x % 40 AS away_score
        FROM (SELECT *, max(CASE WHEN n = 5 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id) AS has5,
                     max(CASE WHEN n = 6 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id) AS has6 FROM lines) l
        JOIN contests c ON c.match_id = l.match_id
        WHERE n <= 5 OR (n = 6 AND has5 = 1) OR (n = 7 AND has5 = 1 AND has6 = 1)
        """,
    ),
)
def score_rows(d):
    out = payloads.score_rows(
        event_payloads(d).select(
            F.col("match_id").alias("event_id"),
            F.col("event.homeScore").alias("home_score"),
            F.col("event.awayScore").alias("away_score"),
        )
    )
    return as_long(out, "period_number", "home_score", "away_score")


@query(
    "fn15_game_attempts",
    sql(
        "lines",
        """
        SELECT match_id AS event_id, CASE WHEN rmax = 'R' THEN NULL ELSE 15 + q % 12 END AS home_fga,
               CASE WHEN rmin = 'A' THEN NULL ELSE 15 + k % 12 END AS away_fga, 2 + x % 7 AS home_fta,
               2 + s % 7 AS away_fta FROM lines WHERE n = 6
        """,
    ),
)
def game_attempts(d):
    rows = statistics(d).withColumnRenamed("match_id", "event_id")
    out = payloads.game_attempts(rows).select("event_id", "home_fga", "away_fga", "home_fta", "away_fta")
    return as_long(out, "home_fga", "away_fga", "home_fta", "away_fta")


STRICT = """
SELECT match_id, q, x, k, s, CASE WHEN b.n IS NULL THEN 'no full-game block'
       WHEN rmax = 'R' THEN 'home: field goals' WHEN x % 12 > x % 17 THEN 'home: 3 pointers'
       WHEN 1 + x % 5 > 2 + x % 7 THEN 'home: free throws'
       WHEN rmin = 'A' THEN 'away: field goals' END AS reject_reason
FROM (SELECT DISTINCT match_id FROM lines) m LEFT JOIN (SELECT * FROM lines WHERE n = 6) b USING (match_id)
"""


#: All columns of the strict box score, over the columns of the ``lines`` view.
BOX = {
    "home_fg_made": "q % 15",
    "home_fg_attempted": "15 + q % 12",
    "home_three_made": "x % 12",
    "home_three_attempted": "x % 17",
    "home_ft_made": "1 + x % 5",
    "home_ft_attempted": "2 + x % 7",
    "home_off_reb": "q % 5",
    "home_def_reb": "20 + q % 9",
    "home_turnovers": "x % 6",
    "away_fg_made": "k % 16",
    "away_fg_attempted": "15 + k % 12",
    "away_three_made": "s % 5",
    "away_three_attempted": "5 + s % 17",
    "away_ft_made": "s % 3",
    "away_ft_attempted": "2 + s % 7",
    "away_off_reb": "k % 5",
    "away_def_reb": "20 + k % 9",
    "away_turnovers": "s % 6",
}


@query(
    "fn16_strict_statistics",
    sql(
        "lines",
        "SELECT match_id, reject_reason, "
        + ", ".join(f"CASE WHEN reject_reason IS NULL THEN {e} END AS {c}" for c, e in BOX.items())
        + " FROM strict",
        strict=STRICT,
    ),
)
def strict_statistics(d):
    box = payloads.match_statistics(statistics(d).drop("payload"))
    good = F.col("reject_reason").isNull()
    return as_long(box.select("match_id", "reject_reason", *[F.when(good, F.col(c)).alias(c) for c in BOX]), *BOX)


ADVANCED_FROM_BOX = """
SELECT s.match_id, c.home_team_id AS team_id, c.home_score_final AS scored, c.away_score_final AS allowed,
       15 + q % 12 + 0.44E0 * (2 + x % 7) - q % 5 + x % 6 AS poss, x % 12 AS tpm, x % 17 AS tpa
FROM strict s JOIN contests c ON c.match_id = s.match_id WHERE reject_reason IS NULL
UNION ALL
SELECT s.match_id, c.away_team_id, c.away_score_final, c.home_score_final,
       15 + k % 12 + 0.44E0 * (2 + s % 7) - k % 5 + s % 6, s % 5, 5 + s % 17
FROM strict s JOIN contests c ON c.match_id = s.match_id WHERE reject_reason IS NULL
"""
ADVANCED_SQL = sql(
    "contests lines",
    """
    SELECT match_id, team_id, round(poss, 6) AS possessions, round(scored / poss * 100, 6) AS offensive_rating,
           round(allowed / poss * 100, 6) AS defensive_rating, tpm AS three_pointers_made, tpa AS three_pointers_attempted
    FROM a WHERE poss > 0
    """,
    strict=STRICT,
    a=ADVANCED_FROM_BOX.replace("FROM strict s JOIN", "FROM strict st JOIN")
    .replace("SELECT s.match_id", "SELECT st.match_id")
    .replace("c.match_id = s.match_id", "c.match_id = st.match_id"),
)


def _advanced_columns(df):
    out = df.select(
        "match_id",
        "team_id",
        "possessions",
        "offensive_rating",
        "defensive_rating",
        "three_pointers_made",
        "three_pointers_attempted",
    )
    out = as_long(out, "three_pointers_made", "three_pointers_attempted")
    return rounded(out, "possessions", "offensive_rating", "defensive_rating")


@query("pf18_box_score_ratings", ADVANCED_SQL)
def box_score_ratings(d):
    box = payloads.match_statistics(statistics(d).drop("payload"))
    facts = d.contests.select(
        "match_id", "home_team_id", "away_team_id", "home_score_final", "away_score_final"
    )
    return _advanced_columns(payloads.advanced_rows(box.join(facts, "match_id")))


@query("ss1_stream_enrichment", ADVANCED_SQL)
def stream_enrichment(d):
    landing, root = fresh_path(d.spark, "stream-landing"), fresh_path(d.spark, "stream-table")
    # Newer answers land first; an older one of every third contest comes in a later file. Each
    # landing is one batch, of as many files as there were tasks to write it.
    newer = views.statistics(d.lines).withColumn("seq", F.lit(2).cast("bigint"))
    older = newer.where("match_id % 3 = 0").withColumn("seq", F.lit(1).cast("bigint"))
    newer.write.option("compression", LANDED).json(f"{landing}/a")
    matches = d.contests
    state = fresh_path(d.spark, "stream-state")
    enrichment.run_available(d.spark, f"{landing}/*", matches, root, state)
    # the older answer has other numbers
    changed = older.withColumn("payload", F.translate("payload", "13579", "24680"))
    changed.write.option("compression", LANDED).json(f"{landing}/b")
    enrichment.run_available(d.spark, f"{landing}/*", matches, root, state)
    return _advanced_columns(enrichment.stored(d.spark, root))


@query(
    "ss1_run_counts",
    sql(
        "contests lines",
        """
        SELECT reject_reason AS outcome, count(*) AS n FROM strict WHERE reject_reason IS NOT NULL GROUP BY 1
        UNION ALL SELECT 'malformed line', count(DISTINCT match_id) FROM lines WHERE match_id % 50 = 7
        UNION ALL SELECT 'enriched', count(*) FROM a WHERE poss > 0
        """,
        strict=STRICT,
        a=ADVANCED_FROM_BOX.replace("FROM strict s JOIN", "FROM strict st JOIN")
        .replace("SELECT s.match_id", "SELECT st.match_id")
        .replace("c.match_id = s.match_id", "c.match_id = st.match_id"),
    ),
)
def run_counts(d):
    """Rows stored and payloads refused by reason, among them lines that break off."""
    landing, root, state, rejects = (fresh_path(d.spark, f"run-{n}") for n in ("landing", "table", "state", "rejects"))
    rows = views.statistics(d.lines).withColumn("seq", F.lit(1).cast("bigint"))
    whole = rows.select(F.to_json(F.struct("match_id", "seq", "payload")).alias("value"))
    broken = rows.where("match_id % 50 = 7").select(F.concat(F.lit('{"match_id": '), "match_id", F.lit(', "seq": 1, "payload": "{')).alias("value"))
    whole.unionByName(broken).write.option("compression", LANDED).text(landing)
    enrichment.run_available(d.spark, landing, d.contests, root, state, rejects=rejects)
    counts = enrichment.run_counts(d.spark, root, rejects)
    return d.spark.createDataFrame(sorted(counts.items()), "outcome string, n long")


@query(
    "src4_malformed_lines",
    sql(
        "lines",
        """
        SELECT count(DISTINCT match_id) AS n_whole, count(DISTINCT match_id) FILTER (WHERE match_id % 50 = 7) AS n_broken
        FROM lines
        """,
    ),
)
def malformed_lines(d):
    """Landed lines read whole, and those kept as text."""
    path = fresh_path(d.spark, "broken-landing")
    rows = views.statistics(d.lines)
    whole = rows.select(F.to_json(F.struct("match_id", "payload")).alias("value"))
    broken = rows.where("match_id % 50 = 7").select(F.concat(F.lit('{"match_id": "'), "match_id", F.lit('x", ')).alias("value"))
    whole.unionByName(broken).write.option("compression", LANDED).text(path)
    read = payloads.read_json(d.spark, path, "match_id bigint, payload string", "malformed")
    good, bad = payloads.split_malformed(read, "malformed")
    n_good, n_bad = good.agg(F.count("match_id").alias("n_whole")), bad.agg(F.count("malformed").alias("n_broken"))
    return n_good.withColumn("n_broken", n_bad.scalar())


@query(
    "fn17_quarter_rows",
    sql(
        "lines",
        """
        SELECT match_id, CAST(n AS BIGINT) AS period_number, nullif(q % 9, 0) AS home_score, nullif(x % 40, 0) AS away_score
        FROM (SELECT *, count(*) OVER w AS have, max(nullif(q % 9, 0)) OVER w AS top FROM lines WHERE n <= 4
              WINDOW w AS (PARTITION BY match_id)) WHERE have = 4 AND top IS NOT NULL
        """,
    ),
)
def quarter_rows(d):
    pair = F.struct("n", (F.col("q") % 9).alias("home"), (F.col("x") % 40).alias("away"))
    # at most four pairs per match
    rows = d.lines.where("n <= 4").groupBy("match_id").agg(F.sort_array(F.collect_list(pair)).alias("q_scores"))
    return as_long(payloads.quarter_rows(rows).drop("period_type"), "period_number")


EVENT_SQL = ", ".join(f"{expr} AS {name}" for name, expr in views.EVENT_FIELDS.items())


@query(
    "fn20_finished_events",
    sql(
        "contests",
        """
        SELECT match_id AS event_id, CAST(to_timestamp(start) AT TIME ZONE 'UTC' AS DATE) AS event_date,
               home_name AS home_raw, away_name AS away_raw, NORM_HOME AS home_norm, NORM_AWAY AS away_norm
        FROM e WHERE status_type = 'finished' AND start <> 0 AND home_name <> ''
        """.replace("NORM_HOME", _norm_sql("home_name")).replace("NORM_AWAY", _norm_sql("away_name")),
        e=f"SELECT match_id, {EVENT_SQL} FROM contests",
    ),
)
def finished_events(d):
    return payloads.finished_events(event_payloads(d))


@query(
    "pf22_status_mapping",
    sql(
        "contests",
        "SELECT match_id, CASE status_type WHEN 'inprogress' THEN 'LIVE' WHEN 'notstarted' THEN 'SCHEDULED' "
        "ELSE 'FINISHED' END AS status FROM e",
        e=f"SELECT match_id, {EVENT_SQL} FROM contests",
    ),
)
def status_mapping(d):
    rows = event_payloads(d)
    return rows.select("match_id", parse.status_of(F.col("event.status.type"), STATUS_BY_SOURCE).alias("status"))


def _facts_sql() -> str:
    total = " + ".join(f"coalesce(max(CASE WHEN n = {p} THEN {{0}} END), 0)" for p in range(1, 5))
    return (
        f"SELECT match_id, nullif({total.format('q')}, 0) AS hr, nullif({total.format('x % 40')}, 0) AS ar, "
        "max(CASE WHEN n = 5 THEN CASE WHEN q <> 0 OR x % 40 <> 0 THEN 1 ELSE 0 END ELSE 0 END) AS ot, "
        "count(*) FILTER (WHERE n >= 5) AS extra FROM lines GROUP BY match_id"
    )


@query(
    "pf23_overtime_facts",
    sql(
        "contests lines",
        """
        SELECT concat('', e.match_id) AS external_id, hr AS home_score_regulation, ar AS away_score_regulation,
               coalesce(ot, 0) = 1 AS went_to_overtime, coalesce(extra, 0) AS overtime_periods_count,
               coalesce(season_name, 'unknown') AS season, substring(coalesce(home_short, home_name), 1, 8) AS home_short
        FROM e LEFT JOIN f ON f.match_id = e.match_id
        """,
        e=f"SELECT match_id, {EVENT_SQL} FROM contests",
        f=_facts_sql(),
    ),
)
def overtime_facts(d):
    out = payloads.event_facts(event_payloads(d)).select(
        "external_id",
        "home_score_regulation",
        "away_score_regulation",
        "went_to_overtime",
        "overtime_periods_count",
        "season",
        "home_short",
    )
    return as_long(out, "home_score_regulation", "away_score_regulation", "overtime_periods_count")


@query(
    "pf23_regulation_difference",
    sql(
        "contests",
        "SELECT concat('', match_id) AS external_id, home_score_final - match_id % 3 AS home_score_regulation, "
        "match_id % 3 <> 0 AS went_to_overtime FROM contests",
    ),
)
def regulation_difference(d):
    out = payloads.event_facts(event_payloads(d), "normaltime")
    return as_long(
        out.select("external_id", "home_score_regulation", "went_to_overtime"), "home_score_regulation"
    )


@query(
    "wn14_sharpest_line",
    f"""
    SELECT match_id, line AS total_line, bookmaker AS total_line_source, round(asym, 6) AS asymmetry FROM (
      SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY asym, line, bookmaker) AS r2 FROM (
        SELECT *, row_number() OVER (PARTITION BY match_id, bookmaker ORDER BY asym, {', '.join(views.ODDS_ORDER)}) AS r1
        FROM (SELECT *, abs(o - u) / (o + u) AS asym FROM (
            SELECT l_orderkey AS match_id, concat('', l_linenumber % 3) AS bookmaker, 180.5E0 + l_suppkey % 20 AS line,
                   CASE WHEN l_tax = 0 THEN NULL ELSE 1.5E0 + (CAST(l_quantity AS BIGINT) % 10) / 10.0E0 END AS o,
                   1.5E0 + (l_partkey % 10) / 10.0E0 AS u, {', '.join(views.ODDS_ORDER)} FROM lineitem))
        WHERE asym IS NOT NULL) WHERE r1 = 1) WHERE r2 = 1
    """,
)
def sharpest_line(d):
    parsed = payloads.parse_line_response(F.col("payload"))["data"]["findPrematchOddsForBookmaker"]
    rows = views.lines_payload(d.table("lineitem")).select(
        "match_id",
        parsed["bookmakerId"].alias("bookmaker"),
        parsed["opportunities"].alias("opportunities"),
    )
    return rounded(payloads.sharpest_lines(rows), "asymmetry")


# -- linking: parts with even keys against parts with odd keys, the size as the day --------------

PART_ROWS = """
SELECT p_partkey AS id, DATE '2024-01-01' + p_size AS d, p_name AS home, lower(p_type) AS away,
       list_distinct(string_split(p_name, ' ')) AS th, list_distinct(string_split(lower(p_type), ' ')) AS ta
FROM part WHERE p_partkey % 2 = {0}
"""
BEST = f"""
SELECT row_id, cand_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, cand_id) AS r FROM (
    SELECT a.id AS row_id, b.id AS cand_id,
           ({SIM.format('a.th', 'b.th')} + {SIM.format('a.ta', 'b.ta')}) / 2 AS score
    FROM a JOIN b ON abs(date_diff('day', a.d, b.d)) <= {{0}})) WHERE r = 1
"""


def _parts(d, odd: int):
    rows = d.table("part").where(F.col("p_partkey") % 2 == odd)
    return rows.select(
        F.col("p_partkey").alias("row_id" if odd == 0 else "cand_id"),
        F.lit("all").alias("league"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).alias("date"),
        F.col("p_name").alias("home_norm"),
        F.lower("p_type").alias("away_norm"),
    )


LINK_VIEWS = dict(a=PART_ROWS.format(0), b=PART_ROWS.format(1))


@query(
    "jn9_fuzzy_band_join",
    sql(
        "",
        "SELECT row_id, cand_id, round(score, 6) AS score FROM best WHERE score >= 0.5",
        **LINK_VIEWS,
        best=BEST.format(1),
    ),
)
def fuzzy_band_join(d):
    return rounded(linking.link(_parts(d, 0), _parts(d, 1), 0.5, 1), "score")


@query(
    "jn9_undated_candidates",
    sql(
        "",
        """
        SELECT row_id, cand_id, round(score, 6) AS score FROM (
          SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, cand_id) AS r FROM (
            SELECT a.id AS row_id, b.id AS cand_id, ({0} + {1}) / 2 AS score
            FROM a JOIN b ON b.id % 3 = 0 OR abs(date_diff('day', a.d, b.d)) <= 1)) WHERE r = 1 AND score >= 0.9
        """.format(SIM.format("a.th", "b.th"), SIM.format("a.ta", "b.ta")),
        **LINK_VIEWS,
    ),
)
def undated_candidates(d):
    cands = _parts(d, 1).withColumn("date", F.when(F.col("cand_id") % 3 != 0, F.col("date")))
    return rounded(linking.link(_parts(d, 0), cands, 0.9, 1, undated_match=True), "score")


@query(
    "jn10_closest_hints",
    sql(
        "",
        """
        SELECT row_id, cand_id, round(score, 6) AS score FROM wide
        WHERE row_id NOT IN (SELECT row_id FROM near WHERE score >= 0.95)
        """,
        **LINK_VIEWS,
        near=BEST.format(0),
        wide=BEST.format(3),
    ),
)
def closest_hints(d):
    rows, cands = _parts(d, 0), _parts(d, 1)
    links = linking.link(rows, cands, 0.95, 0)
    return rounded(linking.closest_hints(rows, links, cands, 3), "score")
