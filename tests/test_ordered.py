"""Stored order: files do not overlap, scans open the files they need, places are known."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tipoff.sources import ordered

START = datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Rows with ties over file edges, a third of them at one time, some without a time."""
    rng = random.Random(4)
    rows = [(i, START + timedelta(hours=rng.randrange(500)) if i % 3 else START + timedelta(hours=77)) for i in range(900)]
    rows += [(2000 + i, None) for i in range(5)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "match_id long, scheduled_at timestamp").withColumn("note", F.lit("x"))
    return ordered.write_ordered(df, str(tmp_path_factory.mktemp("ordered") / "t"), parts=8), rows


def order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or START, r[0]))


def test_files_do_not_overlap(spark, stored):
    path, rows = stored
    one = spark.read.parquet(f"{path}/rows").withColumn("file", F.col("_metadata.file_path"))
    key = F.struct("scheduled_at", "match_id")
    ranges = one.groupBy("file").agg(F.min(key).alias("a"), F.max(key).alias("b")).collect()
    assert len(ranges) > 4
    at = {(r[1], r[0]): i for i, r in enumerate(order(rows))}
    spans = sorted((at[tuple(r["a"])], at[tuple(r["b"])]) for r in ranges)
    assert all(left[1] < right[0] for left, right in zip(spans, spans[1:], strict=False))
    assert spans[0][0] == 0 and spans[-1][1] == len(rows) - 1


def test_a_later_start_opens_fewer_files(spark, stored):
    path, rows = stored
    counts = []
    for hours in (0, 78, 250, 470, 1000):
        start = START + timedelta(hours=hours)
        df = ordered.scan_ordered(spark, path, start)
        assert sorted(r["match_id"] for r in df.collect()) == sorted(i for i, t in rows if t and t >= start)
        counts.append(len(df.inputFiles()) if hours < 1000 else 0)
        assert "PushedFilters: [IsNotNull(scheduled_at)" in df._jdf.queryExecution().toString() or hours == 1000
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[2] > counts[3] > 0


def test_a_window_opens_its_files_only(spark, stored):
    path, rows = stored
    start, stop = START + timedelta(hours=100), START + timedelta(hours=130)
    df = ordered.scan_ordered(spark, path, start, stop)
    assert sorted(r["match_id"] for r in df.collect()) == sorted(i for i, t in rows if t and start <= t < stop)
    assert len(df.inputFiles()) <= 2


def test_places(spark, stored):
    path, rows = stored
    want = {r[0]: i for i, r in enumerate(order(rows), start=1)}
    whole = ordered.scan_ordered(spark, path, position="place")
    assert {r["match_id"]: r["place"] for r in whole.collect()} == want
    assert whole.columns == ["match_id", "scheduled_at", "note", "place"]
    late = ordered.scan_ordered(spark, path, START + timedelta(hours=300), position="place")
    assert all(want[r["match_id"]] == r["place"] for r in late.collect())


def test_empty_and_refused(spark, tmp_path):
    df = spark.createDataFrame([], "match_id long, scheduled_at timestamp")
    path = ordered.write_ordered(df, str(tmp_path / "t"))
    assert ordered.scan_ordered(spark, path, START, position="place").count() == 0
    with pytest.raises(Exception, match="exist"):
        ordered.write_ordered(df, path)
