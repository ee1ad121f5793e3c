"""Stages of the corpus pipeline, one operator each. All but the last keep the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff.llm import toxicity as toxic
from tipoff.llm.common import prepare, table
from tipoff.llm.jaccard import near_groups
from tipoff.llm.lines import LineIndex, drop_lines
from tipoff.llm.mixing import label_quality
from tipoff.llm.mixing import mix as mix_sources
from tipoff.llm.packing import pack as pack_documents


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain of classifiers, trained on the labelled ones, does not reject."""
    labels = table(prepare(spark), sf_dir, "labels")
    return toxic.keep_clean(docs, toxic.train(docs, labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that five or more of them hold, but for the largest holder's.

    Where the table has n_chars, it is that of the text that is left. No document goes.
    """
    out = drop_lines(docs, LineIndex.empty(prepare(spark)).insert(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id. Texts without words stay."""
    prepare(spark)
    first = near_groups(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = first.select(F.col("doc_id").alias("__first_id")).distinct()
    return docs.join(first, docs["doc_id"].eqNullSafe(F.col("__first_id")), "left_semi")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows that share an id share its turns."""
    taken = mix_sources(docs, label_quality(table(prepare(spark), sf_dir, "labels")))
    turns = taken.groupBy(F.col("doc_id").alias("__mix_id")).agg(F.ceil(F.avg("epochs")).cast("int").alias("__turns"))
    joined = docs.join(turns.where("__turns > 0"), docs["doc_id"].eqNullSafe(F.col("__mix_id")))
    repeated = joined.withColumn("__turn", F.explode(F.sequence(F.lit(1), F.col("__turns"))))
    return repeated.drop("__mix_id", "__turns", "__turn")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: pieces of power-of-two length with their ids."""
    prepare(spark)
    return pack_documents(docs, with_ids=True)
