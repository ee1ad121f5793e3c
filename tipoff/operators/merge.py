"""Keyed changes to stored tables, as new snapshots.

Plain files have no in-place update: each operation joins the base with the change set on the
key and returns the next snapshot. Writers in ``sources.sinks`` publish it under a new path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipoff.operators.scale import running


def last_per_key(changes: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the last by ``order``. Combines map-side, so copies of a key never meet whole."""
    rest = [c for c in changes.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return changes.groupBy(*keys).agg(newest.alias("_r")).select(*keys, "_r.*")


def first_per_key(changes: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    rest = [c for c in changes.columns if c not in keys]
    oldest = F.min_by(F.struct(*rest), F.struct(*order))
    return changes.groupBy(*keys).agg(oldest.alias("_r")).select(*keys, "_r.*")


def upsert(
    base: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    immutable: Sequence[str] = (),
) -> DataFrame:
    """Insert new keys; for known keys take every column of ``changes`` except ``immutable``.

    Columns missing from ``changes`` keep their base value. ``changes`` holds one row per key.
    """
    marked = changes.withColumn("_new", F.lit(True))
    b = base.withColumn("_old", F.lit(True)).alias("b")
    c = marked.alias("c")
    on = [F.col(f"b.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    joined = b.join(c, on, "full")
    out: list[Column] = []
    for name in base.columns:
        mine = F.col(f"b.{name}")
        if name in keys:
            out.append(F.coalesce(mine, F.col(f"c.{name}")).alias(name))
        elif name not in changes.columns:
            out.append(mine.alias(name))
        else:
            theirs = F.col(f"c.{name}")
            replace = F.col("c._new") & (
                F.col("b._old").isNull() if name in immutable else F.lit(True)
            )
            out.append(F.when(replace, theirs).otherwise(mine).alias(name))
    return joined.select(*out)


def replace_by_key(base: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop every base row of the keys present in ``rows`` and add ``rows``."""
    touched = rows.select(*keys).distinct()
    return base.join(touched, list(keys), "left_anti").unionByName(rows, allowMissingColumns=True)


def insert_absent(
    base: DataFrame,
    rows: DataFrame,
    key: str,
    order: Sequence[str | Column],
    surrogate: str | None = None,
) -> DataFrame:
    """Add rows whose key is not in the base; the first row of a new key wins.

    New surrogate ids follow the largest existing one in order of (digest cell, key). They are
    numbered cell by cell, so a large first load is not pushed through one task.
    """
    first = first_per_key(rows, [key], order)
    new = first.join(base.select(key), key, "left_anti")
    if surrogate:
        top = base.agg(F.coalesce(F.max(surrogate), F.lit(0)).alias("m")).first()["m"]
        digest = F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 3)
        numbered = running(
            new.withColumn("_one", F.lit(0)).withColumn("_digest", digest),
            ["_one"],
            ["_digest", key],
            {"_n": ("sum", F.lit(1).cast("bigint"))},
            cell=F.col("_digest"),
        )
        new = numbered.withColumn(surrogate, F.lit(top) + F.col("_n")).drop("_one", "_digest", "_n")
    return base.unionByName(new, allowMissingColumns=True)


def patch(base: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Overwrite ``columns`` where the key has a change, also with NULL."""
    change = changes.select(
        key, *[F.col(c).alias(f"_p_{c}") for c in columns], F.lit(True).alias("_hit")
    )
    joined = base.join(change, key, "left")
    return joined.withColumns(
        {c: F.when(F.col("_hit"), F.col(f"_p_{c}")).otherwise(F.col(c)) for c in columns}
    ).select(*base.columns)


def merge_sources(sources: Sequence[DataFrame], key: str, order: Sequence[str] = ()) -> DataFrame:
    """Union of lists read in order; the first list that has a key provides its row.

    ``order`` are the columns that tell which row a list names first, as a key may come twice in it.
    """
    tagged = [df.withColumn("source_order", F.lit(i)) for i, df in enumerate(sources)]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return first_per_key(out, [key], ["source_order", *order])


def stamped(changes: DataFrame, at: Column | None = None) -> DataFrame:
    """``changes`` with the time they were made, which ``upsert`` then stores."""
    return changes.withColumn("updated_at", F.current_timestamp() if at is None else at)


def outcome_counts(df: DataFrame, league: str, outcome: str) -> DataFrame:
    return df.groupBy(league, outcome).agg(F.count("*").alias("n"))
