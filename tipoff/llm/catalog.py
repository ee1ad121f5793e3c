"""Imports every operator module, so that the registry is complete."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tipoff.llm import alignment, exact, jaccard, kneser_ney, language, lines, mixing, packing, quality, repeats, secrets, toxicity, variants  # noqa: F401
from tipoff.llm.common import QUERIES


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: q.sql for name, q in QUERIES.items() if q.sql}
