"""The corpus pipeline: whole documents in, training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's input. Every stage but the last returns the columns of documents.
So when a stage starts, the results before it are stored, and the tables that earlier stages staged
on their way go. Stage results themselves are never removed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tipoff.llm import stages
from tipoff.session import drop_staged, free_shuffles, fresh_path, staged_tables

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Tables that each stage staged on its way, by application.
_ON_THE_WAY: dict[str, dict[str, list[str]]] = {}


def _after_the_others(stage: Stage) -> Stage:
    """``stage``, which removes first what other stages staged on their way, but for what ``docs`` reads."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        on_the_way = _ON_THE_WAY.setdefault(spark.sparkContext.applicationId, {})
        read = docs.inputFiles()
        others = [path for name in on_the_way if name != stage.__name__ for path in on_the_way[name]]
        drop_staged(spark, [path for path in others if not any(f"{path}/" in file for file in read)])
        free_shuffles(spark)
        before = set(staged_tables(spark))
        out = stage(spark, docs, sf_dir)
        here = set(staged_tables(spark))
        for name in on_the_way:
            on_the_way[name] = [path for path in on_the_way[name] if path in here]
        on_the_way.setdefault(stage.__name__, []).extend(here - before)
        return out

    return run


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", _after_the_others(stages.toxicity)),
    ("line_dedup", _after_the_others(stages.line_dedup)),
    ("near_duplicates", _after_the_others(stages.near_duplicates)),
    ("mix", _after_the_others(stages.mix)),
    ("pack", _after_the_others(stages.pack)),
]

#: Toxicity is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
