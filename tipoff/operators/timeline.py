"""Contests as per-team appearance timelines, and timelines back to contests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tipoff.config import SCALE, ScaleSettings
from tipoff.operators import scale

SIDES = ("home", "away")


def appearances(
    contests: DataFrame,
    stats: Mapping[str, tuple[Column, Column]],
    keep: Sequence[str] = (),
    contest_id: str = "match_id",
    ts: str = "scheduled_at",
) -> DataFrame:
    """Two rows per contest from one scan.

    ``stats`` maps a column to its (home value, away value). ``keep`` names contest columns
    to carry along; they ride on the home row only, so that rejoining sides needs no second
    read of the contests.
    """

    def side(i: int, name: str) -> Column:
        kept = [
            (F.col(c) if i == 0 else F.lit(None).cast(contests.schema[c].dataType)).alias(c)
            for c in keep
        ]
        return F.struct(
            F.col(f"{name}_team_id").alias("team_id"),
            F.lit(i == 1).alias("is_road"),
            *[pair[i].alias(c) for c, pair in stats.items()],
            *kept,
        )

    stacked = contests.select(
        F.col(contest_id),
        F.col(ts),
        F.explode(F.array(side(0, "home"), side(1, "away"))).alias("_side"),
    )
    return stacked.select(contest_id, ts, "_side.*")


def rejoin_sides(
    rows: DataFrame,
    columns: Sequence[str],
    keep: Sequence[str] = (),
    contest_id: str = "match_id",
) -> DataFrame:
    """One row per contest with ``home_<c>`` and ``away_<c>`` for each column.

    A single aggregation on the contest id replaces two joins against the contest table.
    """
    home = ~F.col("is_road")
    return rows.groupBy(contest_id).agg(
        *[F.max(F.when(home, F.col(c))).alias(c) for c in keep],
        *[F.max(F.when(home, F.col(c))).alias(f"home_{c}") for c in columns],
        *[F.max(F.when(~home, F.col(c))).alias(f"away_{c}") for c in columns],
    )


def join_halves(
    rows: DataFrame,
    columns: Sequence[str],
    keep: Sequence[str] = (),
    contest_id: str = "match_id",
) -> DataFrame:
    """``rejoin_sides`` for wide rows that are already stored: home half joined to road half.

    Each half is shuffled once with its own columns only; the aggregation form would carry
    every column twice, half of them NULL.
    """
    home = rows.where(~F.col("is_road")).select(
        contest_id, *keep, *[F.col(c).alias(f"home_{c}") for c in columns]
    )
    away = rows.where("is_road").select(
        contest_id, *[F.col(c).alias(f"away_{c}") for c in columns]
    )
    return home.join(away, contest_id, "inner")


def longest_timeline(contests: DataFrame) -> int:
    """Rows of the busiest team, from the two team columns alone."""
    ids = contests.select(F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"))
    return scale.largest_group(ids, ["team_id"])


def micros(ts: str | Column) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


@dataclass(frozen=True)
class Timeline:
    """Rows of entities in time order, with ``_us`` (time in microseconds) and ``_pos`` (1..n)."""

    df: DataFrame
    entity: tuple[str, ...]
    tie: str
    longest: int
    limits: ScaleSettings = SCALE

    @property
    def hot(self) -> bool:
        return self.longest > self.limits.hot_rows

    @property
    def order(self) -> list[str]:
        return ["_us", self.tie]

    @property
    def cell(self) -> Column | None:
        if not self.hot:
            return None
        return F.floor(F.col("_us") / F.lit(self.limits.cell_seconds * 1_000_000))

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.entity).orderBy(*self.order)

    def with_df(self, df: DataFrame) -> Timeline:
        return replace(self, df=df)

    def running(self, values: Mapping[str, tuple[str, Column]], inclusive: bool = True) -> Timeline:
        return self.with_df(
            scale.running(self.df, self.entity, self.order, values, self.cell, inclusive)
        )


def timeline(
    df: DataFrame,
    entity: Sequence[str] = ("team_id",),
    ts: str = "scheduled_at",
    tie: str = "match_id",
    limits: ScaleSettings = SCALE,
    longest: int | None = None,
) -> Timeline:
    """Number each entity's rows by (ts, tie).

    ``longest`` is the row count of the largest entity; it is counted when not given. It only
    chooses between the plain window and the cell-wise plan.
    """
    if longest is None:
        longest = scale.largest_group(df, entity)
    base = Timeline(df.withColumn("_us", micros(ts)), tuple(entity), tie, longest, limits)
    if base.hot:
        return base.running({"_pos": ("sum", F.lit(1).cast("bigint"))})
    return base.with_df(
        base.df.withColumn("_pos", F.row_number().over(base.window()).cast("bigint"))
    )


def finish(tl: Timeline) -> DataFrame:
    return tl.df.drop("_us", "_pos")
