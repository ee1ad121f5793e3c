"""Enrichment progress and table totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.sources.tables import finished, league_of, numeric_id


def enrichment_progress(matches: DataFrame, advanced: DataFrame) -> DataFrame:
    """Per league: contests with a numeric id, enriched, pending, percent done, listing-only."""
    done = advanced.select("match_id").distinct().withColumn("_done", F.lit(True))
    rows = (
        matches.where(finished())
        .select("match_id", "external_id", league_of().alias("league"))
        .join(done, "match_id", "left")
    )
    numeric = F.coalesce(numeric_id(), F.lit(False))
    enriched = numeric & F.col("_done").isNotNull()
    counts = rows.groupBy("league").agg(
        F.count_if(numeric).alias("total_scoutable"),
        F.count_if(enriched).alias("enriched"),
        F.count_if(numeric & F.col("_done").isNull()).alias("pending"),
        F.count_if(F.col("external_id").like("fs_%")).alias("listing_only"),
    )
    share = 100.0 * F.col("enriched") / F.nullif(F.col("total_scoutable"), F.lit(0))
    return counts.withColumn("pct_done", F.round(share, 1)).orderBy(
        F.col("pending").desc(), F.col("total_scoutable").desc()
    )


def table_totals(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    parts = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def existing_ids(matches: DataFrame, periods: DataFrame) -> DataFrame:
    """External ids of contests that already have period rows."""
    return (
        matches.where(F.col("external_id").isNotNull())
        .join(periods.select("match_id"), "match_id", "left_semi")
        .select("external_id")
        .distinct()
    )
