"""Lagged rolling and exponential means: row n sees rows before n only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipoff.operators import scale
from tipoff.operators.timeline import Timeline
from tipoff.session import staged


def _block_shape(windows: Sequence[int], span: int | None) -> tuple[int, int]:
    """Rows per block and lead-in rows.

    Weights of the exponential mean are powers of 1/q counted from the middle of the block, so
    the block must end before they leave double range on either side; rows further back than
    the lead-in weigh less than 1e-16 of the newest one.
    """
    lead = max([1, *windows])
    if span is None:
        return max(50_000, 4 * lead), lead
    decay = -math.log(1 - 2 / (span + 1))
    lead = max(lead, math.ceil(37 / decay))
    size = int(1200 / decay) - lead
    if size < lead:
        raise ValueError("rolling windows are too long to share a pass with this span")
    return size, lead


def lagged_means(
    tl: Timeline,
    columns: Sequence[str],
    windows: Sequence[int] = (),
    span: int | None = None,
) -> Timeline:
    """Add ``<c>_L<k>`` and ``<c>_EMA<span>`` for every column.

    ``_L<k>`` is the mean of the last k earlier rows, NULLs skipped. ``_EMA<span>`` is the
    adjusted exponential mean of all earlier rows: a NULL keeps the previous value while older
    weights go on decaying.
    """
    return lagged_means_by(tl, {c: (tuple(windows), span) for c in columns})


def lagged_means_by(tl: Timeline, plan: dict[str, tuple[tuple[int, ...], int | None]]) -> Timeline:
    """As ``lagged_means`` with its own windows and span per column, in one pass."""
    spans = {span for _, span in plan.values() if span is not None}
    widths = [k for ks, _ in plan.values() for k in ks]
    shapes = [_block_shape(widths, span) for span in spans] or [_block_shape(widths, None)]
    size, lead = min(s for s, _ in shapes), max(h for _, h in shapes)

    blocked = tl.longest > size
    rows = tl.df
    if blocked:
        rows = scale.split_blocks(rows, "_pos", size, lead)
        inside = Window.partitionBy(*tl.entity, "_block").orderBy(*tl.order)
        step = F.col("_pos") - F.col("_block") * size - size // 2
    else:
        inside = tl.window()
        step = F.col("_pos") - size // 2
    for span in spans:
        rows = rows.withColumn(f"_w{span}", F.pow(F.lit(1 + 2 / (span - 1)), step.cast("double")))

    # in one piece, the ratio over earlier rows is the mean itself; in blocks, it is kept at
    # the row it belongs to and carried forward from there
    upto = inside.rowsBetween(Window.unboundedPreceding, 0 if blocked else -1)
    out: dict[str, Column] = {}
    states: dict[str, str] = {}
    for c, (ks, span) in plan.items():
        for k in ks:
            out[f"{c}_L{k}"] = F.avg(c).over(inside.rowsBetween(-k, -1))
        if span is not None:
            weight, seen = F.col(f"_w{span}"), F.col(c).isNotNull()
            mean = F.sum(F.col(c) * weight).over(upto) / F.sum(F.when(seen, weight)).over(upto)
            name = f"{c}_EMA{span}"
            if blocked:
                states[name] = f"_s_{c}_{span}"
                out[states[name]] = F.when(seen, mean)
            else:
                out[name] = mean
    rows = rows.withColumns(out).drop(*[f"_w{span}" for span in spans])
    if blocked:
        rows = rows.where("_own")
        if states:
            rows = _carry_states(tl, rows, states)
        rows = rows.drop("_block", "_own", *states.values())
    return tl.with_df(rows)


def _carry_states(tl: Timeline, rows: DataFrame, states: dict[str, str]) -> DataFrame:
    """The exponential mean before a row is the state after the last non-null row before it."""
    if not tl.hot:
        earlier = tl.window().rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumns(
            {name: F.last(state, ignorenulls=True).over(earlier) for name, state in states.items()}
        )
    rows = staged(rows, "rolling-states")
    inside = (
        Window.partitionBy(*tl.entity, "_block")
        .orderBy(*tl.order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    keys = [*tl.entity, "_block"]
    ends = rows.groupBy(*keys).agg(
        *[
            F.max_by(s, F.when(F.col(s).isNotNull(), F.col("_pos"))).alias(f"_e{s}")
            for s in states.values()
        ]
    )
    carried = scale.running(
        ends,
        tl.entity,
        ["_block"],
        {f"_c{s}": ("last", F.col(f"_e{s}")) for s in states.values()},
        cell=F.floor(F.col("_block") / 10_000),
        inclusive=False,
    ).select(*keys, *[f"_c{s}" for s in states.values()])
    local = rows.withColumns(
        {name: F.last(state, ignorenulls=True).over(inside) for name, state in states.items()}
    )
    joined = local.join(carried, keys, "left")
    return joined.withColumns(
        {name: F.coalesce(F.col(name), F.col(f"_c{s}")) for name, s in states.items()}
    ).drop(*[f"_c{s}" for s in states.values()])
