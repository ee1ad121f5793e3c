"""Tables stored in order, and scans of them by range.

Rows are dealt to files by ranges of their keys and sorted inside each file, so files do not
overlap. A small table beside them holds each file's range and how many rows lie before it: a scan
opens only files that its range reaches, and a row's place in the whole order is known without a
sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS, FILES = "rows", "files"


def write_ordered(df: DataFrame, path: str, keys: Sequence[str] = ("scheduled_at", "match_id"), parts: int | None = None) -> str:
    """Write ``df`` to the new folder ``path``, ordered by ``keys``; a missing key comes first.

    One shuffle by range. ``parts`` is the number of ranges, by default what the session shuffles to.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).write.parquet(f"{path}/{ROWS}")
    first = keys[0]
    written = spark.read.parquet(f"{path}/{ROWS}")
    files = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.min(first).alias("low"),
        F.max(first).alias("high"),
        F.count("*").alias("n"),
        F.min(F.struct(*keys)).alias("least"),
    )
    # One row for each file: the only window here, and it never sees the rows themselves.
    earlier = Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    files.drop("least").coalesce(1).write.parquet(f"{path}/{FILES}")
    return path


def files_between(spark: SparkSession, path: str, start=None, stop=None) -> list[str]:
    """The files that hold keys from ``start`` up to and without ``stop``, in order."""
    files = spark.read.parquet(f"{path}/{FILES}")
    if start is not None:
        files = files.where(F.col("high") >= F.lit(start))
    if stop is not None:
        files = files.where(F.col("low") < F.lit(stop))
    return [r["file"] for r in files.select("file", "before").orderBy("before").collect()]


def scan_ordered(
    spark: SparkSession,
    path: str,
    start=None,
    stop=None,
    key: str = "scheduled_at",
    position: str | None = None,
) -> DataFrame:
    """Rows whose ``key`` is at least ``start`` and less than ``stop``, from the files that can hold them.

    With ``position``, a column of that name counts the rows of the whole table in order, from 1: the
    rows before a row's file, and the row's place in it. Rows without a key are in a scan without
    bounds only, and come first.
    """
    found = files_between(spark, path, start, stop)
    whole = spark.read.parquet(f"{path}/{ROWS}")
    df = spark.read.schema(whole.schema).parquet(*found) if found else whole.where(F.lit(False))
    columns = df.columns
    if position:
        df = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    if start is not None:
        df = df.where(F.col(key) >= F.lit(start))
    if stop is not None:
        df = df.where(F.col(key) < F.lit(stop))
    if not position:
        return df
    places = spark.read.parquet(f"{path}/{FILES}").select(F.col("file").alias("_file"), F.col("before").alias("_before"))
    return df.join(places, "_file").select(*columns, (F.col("_before") + F.col("_row") + 1).alias(position))
