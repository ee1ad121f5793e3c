"""Incremental box-score enrichment of landed payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tipoff.operators.merge import last_per_key
from tipoff.session import staged
from tipoff.sources import payloads, sinks

PAYLOAD_SCHEMA = "match_id bigint, seq bigint, payload string"
ROW_KEY = ["match_id", "team_id"]
#: Parts of the stored table. A batch rewrites only those that its contests fall into.
BUCKETS = 64


#: Where the reader puts a line that is no JSON or does not fit the schema.
MALFORMED = "malformed"


def box_scores(batch: DataFrame) -> DataFrame:
    """Box scores of landed payloads with ``reject_reason``; malformed lines are kept with theirs."""
    box = payloads.match_statistics(
        batch.withColumn("statistics", payloads.parse_statistics(F.col("payload")))
    ).drop("payload")
    if MALFORMED not in box.columns:
        box = box.withColumn(MALFORMED, F.lit(None).cast("string"))
    return box.withColumn(
        "reject_reason",
        F.when(F.col(MALFORMED).isNotNull(), F.lit("malformed line"))
        .when(F.col("match_id").isNull(), F.lit("no match id"))
        .otherwise(F.col("reject_reason")),
    )


def enriched(box: DataFrame, matches: DataFrame) -> DataFrame:
    """Advanced rows of box scores with their ``seq``: strict box score, ratings, the last per key."""
    facts = matches.select(
        "match_id", "home_team_id", "away_team_id", "home_score_final", "away_score_final"
    )
    usable = last_per_key(box.where(F.col("reject_reason").isNull()).drop(MALFORMED), ["match_id"], ["seq"])
    rows = payloads.advanced_rows(usable.withColumn("reject_reason", F.lit(None)).join(facts, "match_id"))
    return rows.join(usable.select("match_id", "seq"), "match_id")


def enrich(batch: DataFrame, matches: DataFrame) -> DataFrame:
    """``enriched`` of a set of payloads."""
    return enriched(box_scores(batch), matches)


def refused(box: DataFrame) -> DataFrame:
    return box.where(F.col("reject_reason").isNotNull()).select("match_id", "seq", "reject_reason", MALFORMED)


def rejected(batch: DataFrame) -> DataFrame:
    """``refused`` of a set of payloads."""
    return refused(box_scores(batch))


def _bucket(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("match_id"), F.lit(BUCKETS)).cast("int"))


def _read(spark: SparkSession, root: str, buckets: list[int] | None = None) -> DataFrame | None:
    parts = sinks.newest_parts(spark, root, "bucket")
    paths = [path for bucket, path in parts.items() if buckets is None or int(bucket) in buckets]
    return spark.read.parquet(*paths) if paths else None


def stored(spark: SparkSession, root: str) -> DataFrame | None:
    """The table below ``root``: the newest version of each part."""
    return _read(spark, root)


def merge_into(spark: SparkSession, root: str, changes: DataFrame) -> None:
    """Merge rows into the table at ``root``; of rows of one key the one with the largest ``seq`` stays.

    A late payload never replaces a newer one, in whatever batch it comes. Only the touched parts
    are read and written, so a batch costs what it changes and not what is stored.
    """
    changes = staged(_bucket(changes), "enriched")
    touched = [r["bucket"] for r in changes.select("bucket").distinct().collect()]
    if not touched:
        return
    rows = changes.withColumn("_new", F.lit(1))
    base = _read(spark, root, touched)
    if base is not None:
        rows = rows.unionByName(_bucket(base).withColumn("_new", F.lit(0)))
    merged = last_per_key(rows, ROW_KEY, ["seq", "_new"]).drop("_new")
    sinks.publish_parts(merged, root, "bucket")


def run_available(
    spark: SparkSession,
    landing: str,
    matches: DataFrame,
    root: str,
    checkpoint: str,
    files_per_batch: int | None = None,
    rejects: str | None = None,
) -> StreamingQuery:
    """Process every landed file not seen yet, then stop; a rerun goes on from there.

    A batch repeated after a failure gives the same table. Payloads that cannot be used are
    written below ``rejects`` with the reason and their batch, one folder for each batch; of a
    malformed line the text is kept, and the lines around it go on. A batch is parsed once.
    """
    reader = spark.readStream.schema(f"{PAYLOAD_SCHEMA}, {MALFORMED} string")
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", MALFORMED)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def save(batch: DataFrame, batch_id: int) -> None:
        box = staged(box_scores(batch), "batch")
        merge_into(spark, root, enriched(box, matches))
        if rejects:
            refused(box).write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")

    query = (
        reader.json(landing)
        .writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def run_counts(spark: SparkSession, root: str, rejects: str) -> dict[str, int]:
    """Rows stored, and payloads rejected by reason."""
    table = stored(spark, root)
    out = {"enriched": table.count() if table is not None else 0}
    for row in spark.read.parquet(rejects).groupBy("reject_reason").count().collect():
        out[row["reject_reason"]] = row["count"]
    return out
