"""Rest, back-to-backs, density and road streaks from the calendar alone."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tipoff.config import FEATURES, FeatureSettings
from tipoff.operators import scale
from tipoff.operators.timeline import Timeline

DAY_US = 86_400_000_000


def with_gap(tl: Timeline) -> Timeline:
    """``_gap``: whole days since the entity's previous row (47 hours are one day)."""

    def gap(window) -> Column:
        return F.floor((F.col("_us") - F.lag("_us").over(window)) / F.lit(DAY_US))

    if not tl.hot:
        return tl.with_df(tl.df.withColumn("_gap", gap(tl.window())))
    cut = scale.split_blocks(tl.df, "_pos", 50_000, 1)
    w = Window.partitionBy(*tl.entity, "_block").orderBy(*tl.order)
    return tl.with_df(cut.withColumn("_gap", gap(w)).where("_own").drop("_block", "_own"))


def days_rest(gap: Column, default: int | None = None, most: int | None = None) -> Column:
    """Raw gap, or gap with a season-opener default and limits [0, most]."""
    if default is not None:
        gap = F.coalesce(gap, F.lit(default))
    if most is not None:
        gap = F.least(F.greatest(gap, F.lit(0)), F.lit(most))
    return gap.cast("bigint")


def back_to_back(gap: Column, max_gap: int) -> Column:
    return F.coalesce(((gap == 1) & (gap <= max_gap)).cast("int"), F.lit(0))


def trailing_counts(tl: Timeline, days: Mapping[str, int]) -> Timeline:
    """Rows of the entity in [now - N days, now], both ends closed, later ties left out.

    Row numbers turn the count into a difference: own number minus the rows before the window.
    """
    if not tl.hot:
        by_time = Window.partitionBy(*tl.entity).orderBy("_us")
        return tl.with_df(
            tl.df.withColumns(
                {
                    name: F.col("_pos")
                    - F.min("_pos").over(by_time.rangeBetween(-n * DAY_US, 0))
                    + 1
                    for name, n in days.items()
                }
            )
        )
    before = rows_before(tl, {name: n * DAY_US for name, n in days.items()})
    return tl.with_df(
        before.withColumns({name: F.col("_pos") - F.col(f"_b_{name}") for name in days}).drop(
            *[f"_b_{name}" for name in days]
        )
    )


def rows_before(tl: Timeline, shifts: Mapping[str, int]):
    """``_b_<name>``: rows of the entity earlier than (own time - shift), for hot entities.

    Each row asks its question as an extra row at the asked time; one running count over rows
    and questions answers all of them cell by cell, and answers return by (entity, number).
    """
    keys = [*tl.entity, "_pos"]
    asked = F.array(
        F.struct(F.lit("").alias("ask"), F.col("_us").alias("at"), F.lit(1).alias("one")),
        *[
            F.struct(F.lit(name).alias("ask"), (F.col("_us") - shift).alias("at"), F.lit(0).alias("one"))
            for name, shift in shifts.items()
        ],
    )
    marks = tl.df.select(*keys, F.explode(asked).alias("m")).select(*keys, "m.*")
    ranked = scale.running(
        marks,
        tl.entity,
        ["at", "one", "_pos", "ask"],
        {"seen": ("sum", F.col("one").cast("bigint"))},
        cell=F.floor(F.col("at") / F.lit(tl.limits.cell_seconds * 1_000_000)),
    )
    answers = (
        ranked.where("one = 0")
        .groupBy(*keys)
        .agg(*[F.max(F.when(F.col("ask") == name, F.col("seen"))).alias(f"_b_{name}") for name in shifts])
    )
    return tl.df.join(answers, keys, "left")


def road_streak(tl: Timeline, name: str, max_gap: int) -> Timeline:
    """Length of the current run of road rows; a home row or a long gap starts over.

    The last row number that cannot belong to the run is a running maximum.
    """
    opener = F.coalesce(F.col("_gap") > max_gap, F.lit(True))
    stop = F.when(~F.col("is_road"), F.col("_pos")).when(opener, F.col("_pos") - 1)
    out = tl.running({"_stop": ("max", stop)})
    streak = F.when(F.col("is_road"), F.col("_pos") - F.col("_stop")).otherwise(F.lit(0))
    return out.with_df(out.df.withColumn(name, streak.cast("bigint")).drop("_stop"))


SCHEDULE_COLUMNS = (
    "days_rest",
    "is_b2b",
    "games_last_short",
    "games_last_long",
    "is_high_density",
    "consecutive_road",
)


def schedule_load(tl: Timeline, cfg: FeatureSettings = FEATURES) -> Timeline:
    """All calendar columns of ``SCHEDULE_COLUMNS``."""
    tl = with_gap(tl)
    tl = trailing_counts(tl, {"games_last_short": cfg.short_days, "games_last_long": cfg.long_days})
    tl = road_streak(tl, "consecutive_road", cfg.rest_max)
    gap = F.col("_gap")
    return tl.with_df(
        tl.df.withColumns(
            {
                "days_rest": days_rest(gap, cfg.rest_default, cfg.rest_max),
                "is_b2b": back_to_back(gap, cfg.rest_max),
                "is_high_density": (F.col("games_last_short") >= cfg.density_games).cast("int"),
            }
        ).drop("_gap")
    )
