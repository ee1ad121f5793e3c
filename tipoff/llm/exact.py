"""Exact duplicates by a tree of merges over sorted digest runs. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.common import power_of_two, query, shuffle_partitions, table, whole
from tipoff.session import staged

KEY = ["digest", "text_sha256", "n_bytes"]


def merge_sorted(entries: DataFrame) -> DataFrame:
    """Neighbours in the order (run, digest, SHA-256, length) become one entry with the largest id.

    The largest id is taken as a struct, which Spark cannot update in a hash table: it sorts the
    entries and merges them in one walk over the sorted rows. The result does not depend on that.
    """
    largest = F.max(F.struct("keep_id")).alias("largest")
    merged = entries.groupBy("run", *KEY).agg(largest, F.sum("group_size").alias("group_size"))
    return merged.select("run", *KEY, F.col("largest.keep_id").alias("keep_id"), "group_size")


def merge_level(level: DataFrame, drop_bits: int) -> DataFrame:
    """One round: run r goes to run r >> drop_bits, equal entries of the runs that meet become one.

    The runs that meet are dealt by digest and merged in order. Entries with one digest are the
    same text only if their SHA-256 and their byte length agree as well, and this is verified at
    every level. An entry is in a run once, so no more than 2**drop_bits of them meet.
    """
    moved = level.withColumn("run", F.shiftright("run", drop_bits))
    return merge_sorted(moved.repartition("run", "digest"))


def exact_groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", runs: int | None = None, fan_in_bits: int = 3
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are dealt into ``runs`` runs by id. Each run merges its own copies first, then
    2**fan_in_bits runs meet in each binomial round until one run is left, which stays spread over
    partitions by digest. The largest id of each text goes back down the tree by (run, digest), so
    that copies of one text, however many, are joined run by run and never meet in one task.

    Texts are equal when their bytes are; a null text equals an empty one. A null id is smaller
    than every other id. Rows that repeat both id and text are one document written twice and get
    the same answer. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    runs = power_of_two(runs or max(64, shuffle_partitions(spark)))
    text = whole(text_col)
    rows = staged(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.pmod(F.xxhash64(F.col(id_col)), F.lit(runs)).alias("run"),
            F.xxhash64(text).alias("digest"),
            F.sha2(text, 256).alias("text_sha256"),
            F.octet_length(text).alias("n_bytes"),
        ),
        "digests",
    )
    single = F.lit(1).cast("long").alias("group_size")
    first = merge_sorted(rows.select("run", *KEY, F.col("doc_id").alias("keep_id"), single))
    level, left = first, runs
    while left > 1:
        level = merge_level(level, fan_in_bits)
        left >>= fan_in_bits
    down = first.select("run", *KEY).join(level.select(*KEY, "keep_id", "group_size"), KEY)
    return rows.join(down, ["run", *KEY]).select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


@query(
    "op10_exact_dedup",
    """
    SELECT doc_id,
           max(doc_id) OVER copies AS keep_id,
           count(*) OVER copies AS group_size,
           doc_id = max(doc_id) OVER copies AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents
    WINDOW copies AS (PARTITION BY coalesce(text, ''))
    """,
)
def op10(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"))
