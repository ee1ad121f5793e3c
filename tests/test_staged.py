from __future__ import annotations

from tipoff.session import drop_staged, staged, staged_in_slices, staged_tables


def test_only_named_tables_go(spark, tmp_path):
    kept = staged(spark.range(5), "kept")
    staged(spark.range(7), "going")
    path = staged_tables(spark)[-1]
    outside = str(tmp_path / "outside")
    spark.range(3).write.parquet(outside)
    before = len(staged_tables(spark))
    assert drop_staged(spark, [path, outside, "/nowhere"]) == 1
    assert path not in staged_tables(spark) and len(staged_tables(spark)) == before - 1
    assert drop_staged(spark, [path]) == 0
    assert kept.count() == 5 and spark.read.parquet(outside).count() == 3


def test_slices_make_the_whole_table(spark):
    rows = [(None if i % 10 == 0 else i // 2, i) for i in range(200)]
    before = set(staged_tables(spark))
    out = staged_in_slices(spark.createDataFrame(rows, "key long, n long"), "sliced", "key")
    assert sorted(map(tuple, out.collect()), key=lambda r: r[1]) == rows
    assert len(out.inputFiles()) >= 4 and len(set(staged_tables(spark)) - before) == 1
    assert drop_staged(spark, set(staged_tables(spark)) - before) == 1
