"""Linking records of two sources by date and fuzzy names.

The best candidate of a row is the one with the largest mean of home and away name
similarity among candidates within a few days. The search runs inside (league, day) blocks, over the distinct
names of each:

* a link needs at least one side whose names reach the threshold on their own. Those name
  pairs are found through the rare tokens of a block: of the tokens a pair must share, at least
  one is among the rarest of either name. A word that is in every name can pair the names of one
  block at most, never those of different days or leagues;
* a row reaches candidates by equality on (league, day, similar name), and the other side is
  scored only for candidates that share a token there;
* candidates with nothing in common on the other side all score half the strong side, so the
  first of them by order stands for all.

Every candidate that can win is scored; no candidate list is cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipoff.functions.text import token_similarity, tokens
from tipoff.session import staged

# Fixed values of the two matchers.
LISTING_THRESHOLD = 0.40
LISTING_ID_THRESHOLD = 0.45
EVENT_THRESHOLD = 0.50
WINDOW_DAYS = 1
HINT_DAYS = 3
LISTING_HINT_DAYS = 2


def _by_rarity(names: DataFrame, frequency: DataFrame, block: Sequence[str]) -> DataFrame:
    """Each name of a block with its tokens, rarest first."""
    ranked = (
        names.select(*block, "name", F.explode(tokens(F.col("name"))).alias("t"))
        .join(frequency, [*block, "t"])
        .groupBy(*block, "name")
        .agg(F.sort_array(F.collect_list(F.struct("n", "t"))).alias("r"))
    )
    return ranked.select(*block, "name", F.col("r.t").alias("ts"))


def similar_names(left: DataFrame, right: DataFrame, at_least: float, block: Sequence[str] = ()) -> DataFrame:
    """(block, a, b, sim) for every pair of distinct names of a block with ``sim >= at_least`` (and
    above 0).

    A pair that reaches the bound by overlap shares one of the first
    ``size - ceil(bound * size) + 1`` tokens of ``a``; a pair that reaches it by containment
    shares the rarest token of the contained name.
    """
    left, right = left.select(*block, "name").distinct(), right.select(*block, "name").distinct()
    frequency = (
        left.unionByName(right)
        .select(*block, F.explode(tokens(F.col("name"))).alias("t"))
        .groupBy(*block, "t")
        .agg(F.count("*").alias("n"))
    )
    a = _by_rarity(left, frequency, block).withColumnsRenamed({"name": "a", "ts": "ta"})
    b = _by_rarity(right, frequency, block).withColumnsRenamed({"name": "b", "ts": "tb"})
    on = [*block, "t"]
    size = F.size("ta")
    needed = F.ceil(size * F.lit(float(at_least)) - 1e-9)
    prefix = F.least(F.greatest(size - needed + 1, F.lit(1)), size).cast("int")
    by_overlap = a.select(*block, "a", "ta", F.explode(F.slice("ta", F.lit(1), prefix)).alias("t")).join(
        b.select(*block, "b", "tb", F.explode("tb").alias("t")), on
    )
    by_containment = a.select(*block, "a", "ta", F.explode("ta").alias("t")).join(
        b.select(*block, "b", "tb", F.col("tb")[0].alias("t")), on
    )
    pairs = by_overlap.unionByName(by_containment).dropDuplicates([*block, "a", "b"])
    scored = pairs.select(*block, "a", "b", token_similarity(F.col("ta"), F.col("tb")).alias("sim"))
    return scored.where((F.col("sim") >= at_least) & (F.col("sim") > 0))


def _names(df: DataFrame, block: Sequence[str], home: str, away: str) -> DataFrame:
    return df.select(*block, F.explode(F.array(home, away)).alias("name"))


def _near(rows: DataFrame, window: int) -> DataFrame:
    """One copy of each row per candidate day."""
    days = F.sequence(F.date_sub("date", window), F.date_add("date", window))
    return rows.withColumn("day", F.explode(days))


def best_candidates(
    rows: DataFrame,
    candidates: DataFrame,
    at_least: float,
    window: int = WINDOW_DAYS,
    undated_match: bool = False,
) -> DataFrame:
    """The best candidate of each row, for rows whose best score is ``at_least`` or more.

    ``rows``: row_id, league, date, home_norm, away_norm. ``candidates``: cand_id, league,
    date, home_norm, away_norm, with ``cand_id`` giving the order in which ties are settled.
    ``undated_match`` lets candidates without a date match any day. Returns row_id, cand_id,
    score.
    """
    dated = candidates.where(F.col("date").isNotNull()).withColumnRenamed("date", "day")
    found = _search(_near(rows, window), dated, ["league", "day"], at_least)
    if undated_match:
        undated = candidates.where(F.col("date").isNull())
        found = found.unionByName(_search(rows, undated, ["league"], at_least))
    return _top(found, ["row_id"]).where(F.col("score") >= at_least)


def _top(options: DataFrame, keys: list[str]) -> DataFrame:
    best = F.max(F.struct(F.col("score"), (-F.col("cand_id")).alias("neg")))
    return (
        options.groupBy(*keys)
        .agg(best.alias("m"))
        .select(*keys, (-F.col("m.neg")).alias("cand_id"), F.col("m.score").alias("score"))
    )


def _search(rows: DataFrame, candidates: DataFrame, block: list[str], at_least: float) -> DataFrame:
    """Scored (row, candidate) options that include every possible winner."""
    # rows that ask the same question are answered once
    question = [*block, "home_norm", "away_norm"]
    asked = rows.select(*question).distinct()
    # of equal candidates only the first by order can be chosen
    cands = (
        candidates.groupBy(*question)
        .agg(F.min("cand_id").alias("cand_id"))
        .withColumnsRenamed({"home_norm": "c_home", "away_norm": "c_away"})
    )

    mine_names, their_names = _names(asked, block, "home_norm", "away_norm"), _names(cands, block, "c_home", "c_away")
    # read twice below
    sims = staged(similar_names(mine_names, their_names, at_least, block), "similar-names")

    def through(strong: str, weak: str) -> DataFrame:
        similar = sims.select(
            *block, F.col("a").alias(f"{strong}_norm"), F.col("b").alias(f"c_{strong}"), "sim"
        )
        near = asked.join(similar, [*block, f"{strong}_norm"])
        place = [*block, f"c_{strong}"]
        alone = near.join(cands.groupBy(*place).agg(F.min("cand_id").alias("cand_id")), place)
        mine, theirs = tokens(F.col(f"{weak}_norm")), tokens(F.col(f"c_{weak}"))
        both = near.withColumn("t", F.explode(mine)).join(
            cands.withColumn("t", F.explode(theirs)), [*place, "t"]
        )
        # a pair sharing several tokens is scored at one of them
        once = F.col("t") == F.array_min(F.array_intersect(mine, theirs))
        return alone.select(*question, "cand_id", (F.col("sim") / 2).alias("score")).unionByName(
            both.where(once).select(
                *question,
                "cand_id",
                ((F.col("sim") + token_similarity(mine, theirs)) / 2).alias("score"),
            )
        )

    options = _top(through("home", "away").unionByName(through("away", "home")), question)
    return rows.select("row_id", *question).join(options, question).select("row_id", "cand_id", "score")


def link(
    rows: DataFrame,
    candidates: DataFrame,
    threshold: float = EVENT_THRESHOLD,
    window: int = WINDOW_DAYS,
    undated_match: bool = False,
) -> DataFrame:
    """Accepted links: the best candidate where its score reaches the threshold."""
    return best_candidates(rows, candidates, threshold, window, undated_match)


def closest_hints(
    rows: DataFrame, links: DataFrame, candidates: DataFrame, window: int = HINT_DAYS
) -> DataFrame:
    """Best candidate in a wider window for rows that stayed unlinked.

    A row whose candidates all score 0 gets the first candidate of its days, as a hint only.
    """
    open_rows = staged(rows.join(links.select("row_id"), "row_id", "left_anti"), "open-rows")
    best = best_candidates(open_rows, candidates, 0.0, window)
    first = candidates.groupBy("league", F.col("date").alias("day")).agg(F.min("cand_id").alias("c"))
    any_day = (
        _near(open_rows, window).join(first, ["league", "day"]).groupBy("row_id").agg(F.min("c").alias("c"))
    )
    return (
        open_rows.select("row_id")
        .join(best, "row_id", "left")
        .join(any_day, "row_id", "left")
        .select(
            "row_id",
            F.coalesce("cand_id", "c").alias("cand_id"),
            F.when(F.coalesce("cand_id", "c").isNotNull(), F.coalesce("score", F.lit(0.0))).alias("score"),
        )
    )


def direct_score(a_home: Column, a_away: Column, b_home: Column, b_away: Column) -> Column:
    """Pair score of two name pairs already side by side."""
    home = token_similarity(tokens(a_home), tokens(b_home))
    away = token_similarity(tokens(a_away), tokens(b_away))
    return (home + away) / 2
