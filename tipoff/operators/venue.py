"""Home and road form kept apart, carried to every later row."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tipoff.config import FEATURES
from tipoff.operators import scale
from tipoff.operators.timeline import Timeline


def venue_gap(tl: Timeline, value: str, name: str, window: int = FEATURES.venue_window) -> Timeline:
    """Mean of the last ``window`` home values minus that of the road values, earlier rows only.

    NULL until the entity has both a home and a road row behind it.
    """
    rows = tl.df
    frame = (-(window - 1), 0)
    if not tl.hot:
        same = Window.partitionBy(*tl.entity, "is_road").orderBy(*tl.order).rowsBetween(*frame)
        rows = rows.withColumn("_form", F.avg(value).over(same))
    else:
        numbered = scale.running(
            rows,
            [*tl.entity, "is_road"],
            tl.order,
            {"_vpos": ("sum", F.lit(1).cast("bigint"))},
            cell=tl.cell,
        )
        cut = scale.split_blocks(numbered, "_vpos", 50_000, window)
        same = (
            Window.partitionBy(*tl.entity, "is_road", "_block").orderBy(*tl.order).rowsBetween(*frame)
        )
        rows = (
            cut.withColumn("_form", F.avg(value).over(same))
            .where("_own")
            .drop("_block", "_own", "_vpos")
        )
    carried = tl.with_df(rows).running(
        {
            "_home_form": ("last", F.when(~F.col("is_road"), F.col("_form"))),
            "_road_form": ("last", F.when(F.col("is_road"), F.col("_form"))),
        },
        inclusive=False,
    )
    return carried.with_df(
        carried.df.withColumn(name, F.col("_home_form") - F.col("_road_form")).drop(
            "_form", "_home_form", "_road_form"
        )
    )
