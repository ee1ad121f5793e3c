"""Nested box-score, event and line payloads to flat rows.

A payload is bounded by one contest, so names are looked up inside its arrays with higher
order functions: only the period level is exploded and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipoff.config import PERIOD_LABELS, STATUS_BY_SOURCE
from tipoff.functions import boxmath, parse
from tipoff.functions.text import normalise_name
from tipoff.schema import EVENT, LINE_RESPONSE, STATISTICS
from tipoff.session import staged

# Metric labels of the payloads and the bounds of the score object.
FIELD_GOALS = "field goals"
THREES = "3 pointers"
FREE_THROWS = "free throws"
OFFENSIVE_REBOUNDS = "offensive rebounds"
DEFENSIVE_REBOUNDS = "defensive rebounds"
TURNOVERS = "turnovers"
WHOLE_GAME = "ALL"
OVERTIME_KEYS = range(5, 10)


def read_json(spark, path: str, schema: str, malformed: str | None = None) -> DataFrame:
    """Landed JSON files with a declared schema; no inference pass.

    ``malformed`` names a column for the text of lines that are no JSON or do not fit the schema;
    without it their rows are all NULL.
    """
    if not malformed:
        return spark.read.schema(schema).json(path)
    reader = spark.read.schema(f"{schema}, {malformed} string").option("mode", "PERMISSIVE")
    return reader.option("columnNameOfCorruptRecord", malformed).json(path)


def split_malformed(rows: DataFrame, malformed: str) -> tuple[DataFrame, DataFrame]:
    """Rows that were read whole, and the text of the others with the file it came from.

    The rows are parsed once, with all their columns, and stored: which lines are malformed would
    otherwise depend on the columns that a later step reads.
    """
    read = staged(rows.withColumn("_file", F.input_file_name()), "landed")
    bad = F.col(malformed).isNotNull()
    return read.where(~bad).drop(malformed, "_file"), read.where(bad).select(malformed, F.col("_file").alias("file"))


def parse_statistics(text: Column) -> Column:
    return F.from_json(text, f"statistics {STATISTICS}")["statistics"]


def parse_event(text: Column) -> Column:
    return F.from_json(text, f"event struct<{_fields(EVENT)}>")["event"]


def parse_line_response(text: Column) -> Column:
    return F.from_json(text, LINE_RESPONSE)


def _fields(schema: str) -> str:
    """``a int, b string`` written as struct fields."""
    out, depth = [], 0
    for part in schema.replace("\n", " ").split(","):
        if depth == 0:
            name, kind = part.strip().split(" ", 1)
            part = f"{name}:{kind.strip()}"
        out.append(part.strip())
        depth += part.count("<") - part.count(">")
    return ",".join(out)


def _label(name: Column) -> Column:
    return F.lower(F.trim(name))


def _loose_label(name: Column) -> Column:
    return F.replace(_label(name), F.lit("-"), F.lit(" "))


def metric_items(block: Column, label=_label) -> Column:
    """All items of a block with their normalised label; materialise it once per block."""
    items = F.flatten(F.transform(block["groups"], lambda g: F.coalesce(g["statisticsItems"], F.array())))
    return F.transform(
        items,
        lambda i: F.struct(label(i["name"]).alias("name"), i["home"].alias("home"), i["away"].alias("away")),
    )


def metric(items: Column, name: str, side: str) -> Column:
    """Display text of one metric for one side; the last item of that name wins."""
    return F.try_element_at(F.filter(items, lambda i: i["name"] == name), F.lit(-1))[side]


def _label_map(column: int) -> Column:
    pairs = [F.lit(x) for row in PERIOD_LABELS for x in (row[0], row[column])]
    return F.create_map(*pairs)


def period_number(label: Column) -> Column:
    return F.try_element_at(_label_map(1), F.upper(label))


def period_type(label: Column) -> Column:
    return F.try_element_at(_label_map(2), F.upper(label))


def score_key(label: Column) -> Column:
    return F.try_element_at(_label_map(3), F.upper(label))


def _shooting(items: Column) -> dict[str, Column]:
    """Attempts, offensive rebounds and turnovers per side; zero attempts count as missing."""
    out: dict[str, Column] = {}
    for side in ("home", "away"):
        for name, source in (("fga", FIELD_GOALS), ("fta", FREE_THROWS)):
            tried = parse.shot_lenient(metric(items, source, side))[1]
            out[f"{side}_{name}"] = F.nullif(tried, F.lit(0))
        out[f"{side}_off_reb"] = parse.integer(metric(items, OFFENSIVE_REBOUNDS, side))
        out[f"{side}_turnovers"] = parse.integer(metric(items, TURNOVERS, side))
    return out


def _computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with further columns that are evaluated once for each row.

    They come out of a generator, so a filter on them is not pushed below, where it would evaluate
    the expressions of all the columns it reads a second time and more.
    """
    row = F.array(F.struct(*[expr.alias(name) for name, expr in columns.items()]))
    return df.select(*df.columns, F.explode_outer(row).alias("_r")).select(*df.columns, "_r.*")


def period_rows(payloads: DataFrame, key: str = "event_id") -> DataFrame:
    """Period rows of each contest; the full-game block only where no period parsed.

    Needs ``statistics`` (array), ``home_score`` and ``away_score`` (score maps).
    """
    blocks = F.col("statistics")
    known = F.filter(blocks, lambda b: period_type(b["period"]).isNotNull())
    whole = F.slice(F.filter(blocks, lambda b: F.upper(b["period"]) == WHOLE_GAME), 1, 1)
    chosen = F.when(F.size(known) > 0, known).otherwise(whole)
    rows = payloads.select(
        key,
        F.col("home_score").alias("_hs"),
        F.col("away_score").alias("_as"),
        (F.size(known) > 0).alias("has_quarter_breakdown"),
        # the outer form keeps the optimizer from evaluating the array a second time as a filter
        F.explode_outer(chosen).alias("_b"),
    ).where(F.col("_b").isNotNull())
    rows = rows.withColumn("_items", metric_items(F.col("_b")))
    label = F.col("_b.period")
    score_name = F.coalesce(score_key(label), F.lit("current"))
    rows = _computed(
        rows,
        {
            "period_number": F.coalesce(period_number(label), F.lit(1)),
            "period_type": F.coalesce(period_type(label), F.lit("GAME")),
            "home_score": F.try_element_at(F.col("_hs"), score_name),
            "away_score": F.try_element_at(F.col("_as"), score_name),
            **_shooting(F.col("_items")),
        },
    )
    rows = rows.withColumns(
        {
            f"{side}_possessions": boxmath.possessions(
                F.col(f"{side}_fga"),
                F.col(f"{side}_fta"),
                F.col(f"{side}_off_reb"),
                F.col(f"{side}_turnovers"),
            )
            for side in ("home", "away")
        }
    ).withColumns(
        {
            f"{side}_pace": boxmath.pace(F.col(f"{side}_possessions"), F.col("period_type"))
            for side in ("home", "away")
        }
    )
    empty_game = (
        (F.col("period_type") == "GAME")
        & F.col("home_possessions").isNull()
        & F.col("away_possessions").isNull()
    )
    return rows.where(~empty_game).drop("_hs", "_as", "_b", "_items")


def score_rows(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Quarter and overtime rows from the score maps; overtime stops at the first gap."""

    def entry(q: int, number: Column, kind: str) -> Column:
        return F.struct(
            number.cast("int").alias("period_number"),
            F.lit(kind).alias("period_type"),
            F.try_element_at(F.col("home_score"), F.lit(f"period{q}")).alias("home_score"),
            F.try_element_at(F.col("away_score"), F.lit(f"period{q}")).alias("away_score"),
        )

    def missing(r: Column) -> Column:
        return r["home_score"].isNull() & r["away_score"].isNull()

    quarters = F.filter(
        F.array(*[entry(q, F.lit(q), "QUARTER") for q in range(1, 5)]), lambda r: ~missing(r)
    )
    extra = F.array(
        *[entry(q, F.lit(i), "OVERTIME") for i, q in enumerate(OVERTIME_KEYS, start=1)]
    )
    gap = F.array_position(F.transform(extra, missing), True)
    played = F.when(gap > 0, gap - 1).otherwise(F.lit(len(OVERTIME_KEYS)))
    overtime = F.slice(extra, F.lit(1), played.cast("int"))
    played_rows = events.select(key, F.explode_outer(F.concat(quarters, overtime)).alias("r"))
    return played_rows.where(F.col("r").isNotNull()).select(key, "r.*")


def game_attempts(payloads: DataFrame, key: str = "event_id") -> DataFrame:
    """One GAME row with shot attempts from the first full-game block that has any."""
    names = {
        f"{side}_{short}": (source, side)
        for short, source in (("fga", FIELD_GOALS), ("fta", FREE_THROWS))
        for side in ("home", "away")
    }

    def read(block: Column) -> Column:
        return F.struct(
            *[
                parse.shot_attempts(metric(metric_items(block), s, side)).alias(n)
                for n, (s, side) in names.items()
            ]
        )

    whole = F.filter(F.col("statistics"), lambda b: F.upper(b["period"]) == WHOLE_GAME)
    usable = F.filter(
        F.transform(whole, read),
        lambda r: F.coalesce(*[r[n] for n in names]).isNotNull(),
    )
    return (
        payloads.select(key, F.try_element_at(usable, F.lit(1)).alias("r"))
        .where(F.col("r").isNotNull())
        .select(key, F.lit(1).alias("period_number"), F.lit("GAME").alias("period_type"), "r.*")
    )


REQUIRED = (
    ("fg", FIELD_GOALS, "shot"),
    ("three", THREES, "shot"),
    ("ft", FREE_THROWS, "shot"),
    ("turnovers", TURNOVERS, "count"),
    ("off_reb", OFFENSIVE_REBOUNDS, "count"),
    ("def_reb", DEFENSIVE_REBOUNDS, "count"),
)


def match_statistics(payloads: DataFrame) -> DataFrame:
    """Strict match-level box score per side and ``reject_reason`` (NULL when usable).

    One missing or malformed metric rejects the contest; the reason names the first one.
    """
    block = F.try_element_at(
        F.filter(F.col("statistics"), lambda b: b["period"] == WHOLE_GAME), F.lit(1)
    )
    rows = payloads.withColumn("_b", block)
    rows = rows.withColumn("_items", metric_items(F.col("_b"), _loose_label))
    out: dict[str, Column] = {}
    checks: list[tuple[str, str]] = []
    for side in ("home", "away"):
        for short, name, kind in REQUIRED:
            text = metric(F.col("_items"), name, side)
            if kind == "shot":
                made, tried = parse.shot_strict(text)
                out[f"{side}_{short}_made"], out[f"{side}_{short}_attempted"] = made, tried
                checks.append((f"{side}_{short}_attempted", f"{side}: {name}"))
            else:
                out[f"{side}_{short}"] = parse.count_of(text)
                checks.append((f"{side}_{short}", f"{side}: {name}"))
    rows = _computed(rows.drop("statistics"), {**out, "_whole": F.col("_b").isNotNull()})
    reason = F.coalesce(
        F.when(~F.col("_whole"), F.lit("no full-game block")),
        *[F.when(F.col(c).isNull(), F.lit(why)) for c, why in checks],
    )
    return rows.withColumn("reject_reason", reason).drop("_b", "_items", "_whole")


def advanced_rows(box: DataFrame) -> DataFrame:
    """Two (match, team) rows per usable contest with ratings on own possessions.

    Needs the contest columns ``match_id``, ``home_team_id``, ``away_team_id`` and final
    scores next to the box columns. Contests with non-positive possessions are left out.
    """

    def side(me: str, other: str) -> Column:
        poss = boxmath.possessions(
            F.col(f"{me}_fg_attempted"),
            F.col(f"{me}_ft_attempted"),
            F.col(f"{me}_off_reb"),
            F.col(f"{me}_turnovers"),
        )
        ratings = boxmath.efficiency_own(
            F.col(f"{me}_score_final"), F.col(f"{other}_score_final"), poss
        )
        return F.struct(
            F.col(f"{me}_team_id").alias("team_id"),
            *[v.alias(k) for k, v in ratings.items()],
            F.col(f"{me}_turnovers").alias("turnovers"),
            F.col(f"{me}_three_made").alias("three_pointers_made"),
            F.col(f"{me}_three_attempted").alias("three_pointers_attempted"),
        )

    both = F.array(side("home", "away"), side("away", "home"))
    rows = box.where(F.col("reject_reason").isNull()).select("match_id", F.explode(both).alias("r"))
    return rows.select("match_id", "r.*").where(F.col("possessions").isNotNull())


def quarter_rows(listings: DataFrame, key: str = "match_id", pairs: str = "q_scores") -> DataFrame:
    """Four quarter rows from an array of (home, away) score pairs.

    Contests with fewer than four pairs, or no home score at all, give no rows. A score of 0
    counts as missing, as it does on the listing pages.
    """
    scores = F.transform(
        F.col(pairs),
        lambda p: F.struct(F.nullif(p["home"], F.lit(0)).alias("home"), F.nullif(p["away"], F.lit(0)).alias("away")),
    )
    usable = (F.size(scores) >= 4) & F.exists(scores, lambda p: p["home"].isNotNull())
    return (
        listings.withColumn("_s", scores)
        .where(usable)
        .select(key, F.posexplode(F.slice("_s", 1, 4)).alias("_p", "_v"))
        .select(
            key,
            (F.col("_p") + 1).alias("period_number"),
            F.lit("QUARTER").alias("period_type"),
            F.col("_v.home").alias("home_score"),
            F.col("_v.away").alias("away_score"),
        )
    )


def finished_events(events: DataFrame) -> DataFrame:
    """Finished events with a start time and both names, names normalised.

    ``events`` has the event struct in ``event``.
    """
    e = F.col("event")
    home, away = e["homeTeam"]["name"], e["awayTeam"]["name"]
    good = (
        (e["status"]["type"] == "finished")
        & (e["startTimestamp"] != 0)
        & (home != "")
        & (away != "")
    )
    return events.where(good).select(
        e["id"].alias("event_id"),
        F.to_date(parse.event_time(e["startTimestamp"])).alias("event_date"),
        home.alias("home_raw"),
        away.alias("away_raw"),
        normalise_name(home).alias("home_norm"),
        normalise_name(away).alias("away_norm"),
    )


def event_facts(events: DataFrame, regulation_key: str | None = None) -> DataFrame:
    """Contest columns of an event: time, season, status, scores, overtime facts, short names.

    Sources without a regulation score sum the four periods and flag overtime by its own
    score; with ``regulation_key`` the regulation score is read and overtime means that the
    final score differs from it.
    """
    e = F.col("event")

    def score(side: str, key: str) -> Column:
        return F.try_element_at(e[f"{side}Score"], F.lit(key))

    def regulation(side: str) -> Column:
        if regulation_key:
            return score(side, regulation_key)
        return boxmath.regulation_points(*[score(side, f"period{q}") for q in range(1, 5)])

    def overtime(side: str) -> Column:
        return F.coalesce(score(side, "overtime") != 0, F.lit(False))

    if regulation_key:
        extra = F.coalesce(score("home", "current") != regulation("home"), F.lit(False))
    else:
        extra = overtime("home") | overtime("away")

    def short(team: str) -> Column:
        return F.substring(F.coalesce(e[team]["shortName"], e[team]["name"], F.lit("?")), 1, 8)

    return events.select(
        e["id"].cast("string").alias("external_id"),
        parse.event_time(e["startTimestamp"]).alias("scheduled_at"),
        F.coalesce(e["season"]["name"], F.lit("unknown")).alias("season"),
        parse.status_of(e["status"]["type"], STATUS_BY_SOURCE).alias("status"),
        score("home", "current").alias("home_score_final"),
        score("away", "current").alias("away_score_final"),
        regulation("home").alias("home_score_regulation"),
        regulation("away").alias("away_score_regulation"),
        extra.alias("went_to_overtime"),
        boxmath.overtime_count(*[score("home", f"period{q}") for q in OVERTIME_KEYS]).alias(
            "overtime_periods_count"
        ),
        F.coalesce(e["homeTeam"]["name"], F.lit("?")).alias("home_team"),
        F.coalesce(e["awayTeam"]["name"], F.lit("?")).alias("away_team"),
        short("homeTeam").alias("home_short"),
        short("awayTeam").alias("away_short"),
    )


def sharpest_lines(responses: DataFrame, key: str = "match_id") -> DataFrame:
    """The line with the most even odds per contest.

    ``responses`` has one row per bookmaker answer with ``bookmaker`` and ``opportunities``.
    Within an answer the first line of the smallest asymmetry wins; between answers ties go
    to the smaller line, then to the smaller bookmaker id compared as text.
    """

    def odds(o: Column) -> Column:
        over, under = (o[s]["value"].try_cast("double") for s in ("over", "under"))
        return F.struct(
            # not a number and endless odds are no odds
            F.nullif(F.abs(over - under) / F.nullif(over + under, F.lit(0.0)), F.lit(float("nan"))).alias("asymmetry"),
            o["handicap"]["value"].try_cast("double").alias("line"),
        )

    usable = F.filter(
        F.transform(F.col("opportunities"), odds),
        lambda r: r["asymmetry"].isNotNull() & r["line"].isNotNull(),
    )
    placed = F.transform(
        usable,
        lambda r, i: F.struct(r["asymmetry"].alias("asymmetry"), i.alias("i"), r["line"].alias("line")),
    )
    best = responses.select(key, F.col("bookmaker").cast("string").alias("bookmaker"), F.array_min(placed).alias("b"))
    return (
        best.where(F.col("b").isNotNull())
        .groupBy(key)
        .agg(F.min(F.struct(F.col("b.asymmetry"), F.col("b.line"), F.col("bookmaker"))).alias("m"))
        .select(
            key,
            F.col("m.line").alias("total_line"),
            F.col("m.bookmaker").alias("total_line_source"),
            F.col("m.asymmetry").alias("asymmetry"),
        )
    )
