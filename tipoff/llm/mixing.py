"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipoff.llm.common import WORD, query, table, whole
from tipoff.session import staged

#: Weights of the sources in code-point order, repeating.
SOURCE_WEIGHTS = (5, 2, 1)
#: Weight of a document in the draw, by its quality label: good, bad, none.
QUALITY_WEIGHTS = {1: 2.0, 0: 0.5, None: 1.0}


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size) to (source, source_size, target): water filling.

    Sources get a part of ``share`` times all sizes by weight, at most ``cap`` times their own
    size; what is above goes to the others by weight. Sorted by cap over weight, a source is full
    exactly if the level that the rest would get without the fuller ones reaches its own cap.
    The input has one row per source, so the two single-partition windows see few rows.
    """
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    spot = (F.row_number().over(order) - 1) % len(weights)
    given = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (spot + 1).cast("int")))
    given = given.withColumn("most", F.col("source_size") * F.lit(cap))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").cast("binary").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(after)
    judged = given.withColumn("level", level).withColumn("full", F.col("most") <= F.col("level") * F.col("weight"))
    poured = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), F.col("level")))).over(everything)
    target = F.when(F.col("full"), F.col("most")).otherwise(poured["level"] * F.col("weight"))
    return judged.select("source", "source_size", target.alias("target"))


def uniform(id_col: str, seed: str) -> Column:
    """A number in (0, 1) from the id alone: reruns agree and SQL can repeat it."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)


def mix(
    docs: DataFrame,
    quality: DataFrame | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = SOURCE_WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix:",
    buckets: int = 4096,
) -> DataFrame:
    """One row per input row: doc_id, size, source, source_size, target, epochs, taken.

    A source whose target is e whole times its size and a rest is taken e times whole; for the
    rest its documents are drawn by exponential keys -ln(u) / quality in ascending order until the
    words reach the budget. The document on the edge is taken if that comes nearer to it.

    The keys of a source are cut into ``buckets`` spans of the unit interval. Sums by span tell
    where each span starts, and only inside a span are rows sorted, so a source that holds most
    rows is spread over that many groups.

    ``quality`` holds (doc_id, mix_weight), one row per id; a document without a positive weight
    there counts as 1. A null text has size 0, a null source is a source of its own behind all
    others. Equal keys go by id; rows that repeat an id are sizes apart
    or equal. A source of size 0 has target 0. Extra columns are ignored.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.regexp_count(whole(text_col), F.lit(WORD)).cast("long").alias("size"),
        F.col(source_col).alias("source"),
    )
    weight = F.lit(1.0)
    if quality is not None:
        rows = rows.join(quality, "doc_id", "left")
        weight = F.when(F.col("mix_weight") > 0, F.col("mix_weight").cast("double")).otherwise(F.lit(1.0))
    rows = rows.withColumn("draw", -F.log(uniform("doc_id", seed)) / weight)
    span = F.least(F.floor((1.0 - F.exp(-F.col("draw"))) * buckets), F.lit(buckets - 1))
    rows = staged(rows.select("doc_id", "size", "source", "draw", span.cast("int").alias("span")), "sizes")
    by_span = rows.groupBy("source", "span").agg(F.sum("size").alias("span_size"))
    totals = by_span.groupBy("source").agg(F.sum("span_size").alias("source_size"))
    targets = source_targets(totals, weights, share, cap)
    spans = by_span.withColumn(
        "span_start",
        F.coalesce(
            F.sum("span_size").over(
                Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ),
    )
    plan = spans.alias("a").join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    plan = plan.select("a.source", "span", "span_start", "source_size", "target")
    placed = rows.alias("r").join(
        plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.span") == F.col("p.span"))
    )
    inside = Window.partitionBy("r.source", "r.span").orderBy("draw", "doc_id", "size")
    before = F.col("span_start") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    return (
        placed.select("doc_id", "size", "r.source", "source_size", "target", epochs.cast("long").alias("epochs"), before.alias("before"))
        .withColumn("drawn", (F.col("before") + F.col("size") / 2.0 <= rest) & (F.col("size") > 0))
        .withColumn("epochs", F.col("epochs") + F.col("drawn").cast("long"))
        .select("doc_id", "size", "source", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).alias("taken"))
    )


def label_quality(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) of the labelled documents; an id labelled twice counts as its better label."""
    weight = F.when(F.max("quality") == 1, F.lit(QUALITY_WEIGHTS[1])).when(F.max("quality") == 0, F.lit(QUALITY_WEIGHTS[0]))
    return labels.groupBy("doc_id").agg(weight.alias("mix_weight"))


@query(
    "op1_source_mix",
    f"""
    WITH w AS (SELECT doc_id, CASE max(quality) WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 END AS weight FROM labels GROUP BY doc_id),
    d AS (
        SELECT d.doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
               -ln((CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE)
                   / 4503599627370496.0::DOUBLE) / coalesce(w.weight, 1.0)::DOUBLE AS draw
        FROM documents d LEFT JOIN w ON d.doc_id = w.doc_id),
    s AS (SELECT source, sum(size)::BIGINT AS source_size,
                 [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
          FROM d GROUP BY source),
    l AS (SELECT *, 2.0::DOUBLE * source_size AS most,
                 (1.5::DOUBLE * sum(source_size) OVER ()
                  - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST
                                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST
                                     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
          FROM s),
    t AS (SELECT source, source_size,
                 CASE WHEN most <= level * weight THEN most
                      ELSE weight * (SELECT level FROM l WHERE most > level * weight
                                     ORDER BY most / weight, source NULLS LAST LIMIT 1) END AS target
          FROM l),
    k AS (SELECT d.doc_id, d.size, t.source_size, t.target,
                 CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
                 sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
           CAST(size * (epochs + CASE WHEN size > 0 AND before + size / 2.0::DOUBLE <= target - epochs * source_size
                                      THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM k
    """,
)
def op1(spark, sf_dir):
    quality = label_quality(table(spark, sf_dir, "labels"))
    mixed = mix(table(spark, sf_dir, "documents"), quality)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
