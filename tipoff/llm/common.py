"""What the operators for training data share: session settings, tables, registered queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff.session import configure, free_shuffles, staged

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: The same six characters, as a trim set.
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = Query(lambda spark, sf_dir: fn(prepare(spark), sf_dir), sql)
        return fn

    return add


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the text operators.

    Arrow batches are counted in rows; texts can be very long, so a batch holds few of them.
    """
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; 0 where the id is null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % n, F.lit(0))


def power_of_two(least: int) -> int:
    return 1 << max(0, least - 1).bit_length()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder, read it back, and let go of the shuffles behind it."""
    out = staged(df, label)
    free_shuffles(df.sparkSession)
    return out


def hash_sample(df: DataFrame, key: str, about: int, seed: int = 1) -> DataFrame:
    """About ``about`` rows of ``df``, all if it has no more; a row is in by the hash of its key alone."""
    n = df.count()
    if n <= about:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 40)) < int(about / n * (1 << 40)))
