"""Running values, row numbers and rank cuts that never need one task per group.

A window partitioned by a key alone puts all rows of that key into one task. These helpers
cut a key's ordered rows into cells (of time, of score, or of a fixed row count), do the row
level work inside a cell, and carry a small per-cell summary across cells. Groups that are
known to be short take the plain window, which needs one shuffle less.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def largest_group(df: DataFrame, group: Sequence[str]) -> int:
    """Rows of the largest group. Reads the key columns only; counts are combined map-side."""
    return df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0


def _merge(kind: str, local: Column, carried: Column) -> Column:
    if kind == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))
    if kind == "max":
        return F.greatest(local, carried)
    return F.coalesce(local, carried)


def _over(kind: str, value: Column, window) -> Column:
    if kind == "sum":
        return F.sum(value).over(window)
    if kind == "max":
        return F.max(value).over(window)
    return F.last(value, ignorenulls=True).over(window)


def _total(kind: str, value: Column, order: Sequence[str]) -> Column:
    if kind == "sum":
        return F.sum(value)
    if kind == "max":
        return F.max(value)
    return F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, tuple[str, Column]],
    cell: Column | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Running ``sum``, ``max`` or ``last`` (non-null) of each value along ``order``.

    ``cell`` is an expression that never decreases along ``order``. Given it, the work is
    partitioned by (group, cell): a window inside each cell, one pre-aggregated row per cell,
    a window over those rows, and a join back on the same keys. Without it a plain window
    per group is used. ``inclusive=False`` leaves the current row out.
    """
    end = 0 if inclusive else -1
    if cell is None:
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        return df.withColumns(
            {
                out: _merge(kind, _over(kind, value, w), F.lit(None))
                for out, (kind, value) in values.items()
            }
        )
    df = df.withColumn("_cell", cell)
    keys = [*group, "_cell"]
    totals = df.groupBy(*keys).agg(
        *[_total(kind, value, order).alias(f"_t_{out}") for out, (kind, value) in values.items()]
    )
    before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        *[_over(kind, F.col(f"_t_{out}"), before).alias(f"_c_{out}") for out, (kind, _) in values.items()],
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = df.withColumns(
        {f"_l_{out}": _over(kind, value, inside) for out, (kind, value) in values.items()}
    )
    joined = local.join(carried, keys, "left")
    return joined.select(
        *[c for c in df.columns if c != "_cell"],
        *[
            _merge(kind, F.col(f"_l_{out}"), F.col(f"_c_{out}")).alias(out)
            for out, (kind, _) in values.items()
        ],
    )


def split_blocks(df: DataFrame, pos: str, size: int, halo: int) -> DataFrame:
    """Cut rows numbered 1..n per entity into blocks of ``size`` rows.

    Every block also gets copies of the ``halo`` rows before it, marked ``_own = false``, so a
    row frame of at most ``halo`` rows can be evaluated inside one (entity, ``_block``).
    """
    own = F.floor((F.col(pos) - 1) / F.lit(size))
    lead_in = (F.col(pos) - 1) % size >= size - halo
    targets = F.when(lead_in, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("_block", F.explode(targets)).withColumn("_own", F.col("_block") == own)


#: A sketch of a group's values has so many equal parts, and is off by less than a sixteenth of one.
SKETCH_PARTS, SKETCH_ACCURACY = 256, 4096


def _sketch(rows: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    points = F.array(*[F.lit(i / SKETCH_PARTS) for i in range(SKETCH_PARTS + 1)])
    sketch = F.percentile_approx(value, points, F.lit(SKETCH_ACCURACY)).alias("_points")
    return rows.groupBy(*on).agg(F.count("*").alias("_size"), sketch)


def rank_cut(
    df: DataFrame,
    group: Sequence[str],
    order: Mapping[str, Column],
    ranks: Mapping[str, Callable[[Column], Column]],
) -> DataFrame:
    """For each group and each of ``ranks``, the row at that rank (1-based) when ordered by ``order``.

    A rank is a function of the group's size; one beyond the size has no row. ``order`` are numbers
    without NULL that together tell rows apart. Returns the group columns, ``_label`` (the name in
    ``ranks``), the columns of ``order`` and ``_size``, the group's size.

    One plan and no job of its own. For each column of ``order``, a mergeable quantile sketch gives
    a bracket of values around the rank, wider than the sketch can err. The next pass counts rows below
    the bracket and by value inside it, combined map-side, and the value is picked by its cumulative
    range. So the rank is exact, only values of a few parts in 256 are sorted, and equal values are
    counted as one; rows that share the value go on to the next column.
    """
    on = list(group) or ["_all"]
    rows = df.select(*group, *[expr.alias(name) for name, expr in order.items()])
    if not group:
        rows = rows.withColumn("_all", F.lit(0))
    names = list(order)
    sized = _sketch(rows, on, names[0])
    wanted = F.array(*[F.struct(F.lit(x).alias("_label"), rank(F.col("_size")).cast("long").alias("_rank")) for x, rank in ranks.items()])
    target = sized.select(*on, F.col("_size").alias("_total"), "_size", "_points", F.inline(wanted))
    target = target.where("_rank BETWEEN 1 AND _size")
    for i, name in enumerate(names):
        at = [*on, *names[:i]]
        if i:
            ties = rows.join(_few(target.select(*at).distinct(), group), at, "left_semi")
            target = target.join(_sketch(ties, at, name), at)
        part = F.floor((F.col("_rank") - 1) / F.col("_size") * SKETCH_PARTS).cast("int")
        bracket = target.select(
            *at, "_label", "_rank", "_total",
            F.when(part >= 2, F.get("_points", part - 2)).alias("_low"),
            F.when(part + 3 <= SKETCH_PARTS, F.get("_points", part + 3)).alias("_high"),
        )
        # The sketch sees doubles, so large numbers are compared as such, and ordered as they are.
        own = F.col(name).cast("double")
        inside = F.col("_low").isNull() | (own >= F.col("_low").cast("double"))
        held = rows.join(_few(bracket, group), at).where(F.col("_high").isNull() | (own <= F.col("_high").cast("double")))
        # The row without a value stands for all rows below the bracket.
        counts = held.withColumn(name, F.when(inside, F.col(name))).groupBy(*at, "_label", "_rank", "_total", name)
        order_by = Window.partitionBy(*at, "_label").orderBy(F.col(name).asc_nulls_first())
        upto = F.sum("_n").over(order_by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        cells = counts.agg(F.count("*").alias("_n")).withColumn("_upto", upto)
        hit = F.col(name).isNotNull() & (F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank"))
        target = cells.where(hit).select(*at, name, "_label", "_total", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"))
    return target.select(*group, "_label", *names, F.col("_total").alias("_size"))


def _few(targets: DataFrame, group: Sequence[str]) -> DataFrame:
    """Without groups there is one row for each rank asked for."""
    return targets if group else F.broadcast(targets)
