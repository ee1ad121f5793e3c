from __future__ import annotations

import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "alpha beta gamma delta " * 200

#: Rows (doc_id, text, lang, source) with nulls, empty and odd texts, repeated rows, repeated texts.
ODD = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, "   \n\t ", None, "b"),
    (4, "one", "en", None),
    (5, "one two", "fr", "b"),
    (6, "Ünïcode ñ 日本語 \x00 tail", "de", "c"),
    (7, LONG, "en", "a"),
    (8, LONG, "en", "a"),
    (8, LONG, "en", "a"),
    (9, LONG + "more", None, "c"),
    (None, "no id here at all", "en", "c"),
    (10, "\n\n\n", "es", None),
    (11, "12 34 56 #$%", "es", "b"),
]
#: Columns whose names operators use inside.
CLASHES = ["ref", "node", "keys", "run", "digest", "size", "span", "draw", "n", "k1", "quality", "toxic", "lettered", "target"]


@pytest.fixture(scope="session")
def llm(spark):
    from tipoff.llm.common import prepare

    return prepare(spark)


@pytest.fixture(scope="session")
def make(llm):
    """A documents table of rows (doc_id, text, lang, source), with extra columns of clashing names."""
    from pyspark.sql import functions as F

    def build(rows=ODD, clash=True):
        df = llm.createDataFrame(list(rows), "doc_id long, text string, lang string, source string")
        df = df.withColumn("n_chars", F.length("text").cast("long"))
        return df.withColumns({c: F.lit("x") for c in CLASHES}) if clash else df

    return build


@pytest.fixture(scope="session")
def documents(llm):
    """The small documents table and its rows as (doc_id, text)."""
    df = llm.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return df, [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
