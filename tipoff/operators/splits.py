"""Chronological and calendar splits."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipoff.operators.scale import rank_cut
from tipoff.operators.timeline import micros
from tipoff.session import staged

TEST_FRACTION = 0.20


#: Rows without a time come before all others.
NO_TIME = -(2**63)


def _order(ts: str, tie: str) -> dict[str, Column]:
    return {"_us": F.coalesce(micros(ts), F.lit(NO_TIME)), "_key": F.col(tie)}


def _at_or_after(ts: str, tie: str, us: Column, key: Column) -> Column:
    own = _order(ts, tie)
    return (own["_us"] > us) | ((own["_us"] == us) & (own["_key"] >= key))


def split_latest(
    df: DataFrame,
    group: str,
    fraction: float = TEST_FRACTION,
    ts: str = "scheduled_at",
    tie: str = "match_id",
    store: bool = False,
) -> DataFrame:
    """Add ``split``: the last ``max(1, int(n * fraction))`` rows of each group are ``test``.

    One plan for every size: the cut row of a group is located by counting, and each row is
    compared with its group's cut, so contests are never sorted. A row without a group belongs
    to neither part; its ``split`` is NULL. ``store`` writes the cut rows, one for each group: rows
    that are read many times find them once, and a join with a table known to be small moves no row.
    """
    first = {"test": lambda n: n - F.greatest(F.lit(1), F.floor(n * fraction)) + 1}
    cuts = rank_cut(df.where(F.col(group).isNotNull()), [group], _order(ts, tie), first)
    cuts = cuts.select(group, F.col("_us").alias("_cut_us"), F.col("_key").alias("_cut_key"))
    if store:
        cuts = staged(cuts, "cuts")
    joined = df.join(cuts, group, "left")
    is_test = _at_or_after(ts, tie, F.col("_cut_us"), F.col("_cut_key"))
    return joined.withColumn(
        "split", F.when(is_test, F.lit("test")).when(F.col(group).isNotNull(), F.lit("train"))
    ).drop("_cut_us", "_cut_key")


def split_at(
    df: DataFrame,
    ends: Mapping[str, Callable[[Column], Column]],
    last: str,
    ts: str = "scheduled_at",
    tie: str = "match_id",
    store: bool = False,
) -> DataFrame:
    """Add ``split`` over all rows in time order: ``ends`` gives for each part but the last, in order,
    how many of n rows come up to its end.

    All rows form one sequence, so the cut rows are located by counting; no unpartitioned sort of
    the data takes place, and the cuts reach the rows as a scalar subquery. ``store`` as in ``split_latest``.
    """
    first = {name: (lambda n, end=end: end(n) + 1) for name, end in ends.items()}
    found = rank_cut(df, [], _order(ts, tie), first)
    if store:
        found = staged(found, "cuts")
    entry = F.struct("_label", F.struct("_us", "_key"))
    cuts = found.agg(F.map_from_entries(F.collect_list(entry)).alias("cuts")).scalar()
    split = F.lit(last)
    for name in reversed(list(ends)):
        cut = F.try_element_at(cuts, F.lit(name))
        # A part that takes all rows has no row behind its end.
        behind = F.coalesce(_at_or_after(ts, tie, cut["_us"], cut["_key"]), F.lit(False))
        split = F.when(behind, split).otherwise(F.lit(name))
    return df.withColumn("split", split)


def split_three_ways(df: DataFrame, train: float, validation: float, **kw) -> DataFrame:
    """Leading ``int(n * train)`` rows, next up to ``int(n * (train + validation))``, rest."""
    ends = {"train": lambda n: F.floor(n * train), "validation": lambda n: F.floor(n * (train + validation))}
    return split_at(df, ends, "test", **kw)


def split_two_ways(df: DataFrame, test: float = TEST_FRACTION, **kw) -> DataFrame:
    """Unshuffled split with ``ceil(n * test)`` test rows."""
    return split_at(df, {"train": lambda n: n - F.ceil(n * test)}, "test", **kw)


def split_by_months(df: DataFrame, months: Sequence[int], ts: str = "scheduled_at") -> DataFrame:
    """Rows in the month set are ``test``, the others ``train``."""
    return df.withColumn(
        "split", F.when(F.month(ts).isin(list(months)), F.lit("test")).otherwise(F.lit("train"))
    )
