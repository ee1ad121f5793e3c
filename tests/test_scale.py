"""Cell-wise plans against plain windows, with one group holding a third of the rows or more."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F


from tipoff.operators import fills, metrics, scale, splits



@pytest.fixture(scope="module")
def contests(spark):
    rng = np.random.default_rng(3)
    out = []
    for i in range(400):
        league = "big" if i % 5 else f"l{i % 3}"
        day = int(rng.integers(0, 60)) if i % 4 else 7
        out.append((i * 37 % 401, league, dt.datetime(2025, 1, 1) + dt.timedelta(days=day), float(rng.integers(0, 9))))
    return spark.createDataFrame(out, "match_id long, league string, scheduled_at timestamp, x double").cache()


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_cells_equal_plain_window(contests, rows, inclusive):
    values = {
        "s": ("sum", F.col("x")),
        "m": ("max", F.when(F.col("x") > 3, F.col("x"))),
        "l": ("last", F.when(F.col("x") < 4, F.col("x"))),
    }
    order = ["scheduled_at", "match_id"]
    plain = scale.running(contests, ["league"], order, values, None, inclusive)
    cells = scale.running(contests, ["league"], order, values, F.dayofyear("scheduled_at"), inclusive)
    assert rows(plain) == rows(cells)


def test_split_latest_equals_a_ranked_one(contests, rows):
    latest = Window.partitionBy("league").orderBy(F.desc("scheduled_at"), F.desc("match_id"))
    size = F.count("*").over(Window.partitionBy("league"))
    ranked = contests.withColumn("split", F.when(
        F.row_number().over(latest) <= F.greatest(F.lit(1), F.floor(size * 0.2)), "test").otherwise("train"))
    got = splits.split_latest(contests, "league").select("match_id", "split")
    assert rows(got) == rows(ranked.select("match_id", "split"))


def test_rows_without_a_league_are_in_neither_part(contests):
    none = contests.withColumn("league", F.when(F.col("match_id") % 5 > 0, F.col("league")))
    got = splits.split_latest(none, "league").collect()
    assert len(got) == 400 and all((r["split"] is None) == (r["league"] is None) for r in got)


@pytest.mark.parametrize("kind", ["one time", "few times", "some without", "spread"])
def test_rank_cut_with_ties_and_large_ids(spark, kind):
    """Ties of thousands, missing times, ids past the doubles: the row at each rank is the sorted one."""
    n = 5000
    ids = [2**62 + 3 * (i * 7919 % n) for i in range(n)]
    times = {
        "one time": lambda i: 77,
        "few times": lambda i: i % 3,
        "some without": lambda i: None if i % 4 == 0 else i % 50,
        "spread": lambda i: i * i,
    }[kind]
    data = [("ab"[i % 5 == 0], ids[i], times(i)) for i in range(n)]
    df = spark.createDataFrame(data, "g string, id long, t long").repartition(7)
    order = {"_t": F.coalesce("t", F.lit(splits.NO_TIME)), "_id": F.col("id")}
    ranks = {"first": lambda c: F.lit(1), "some": lambda c: F.floor(c * 0.37), "last": lambda c: c, "no": lambda c: c + 1}
    for group in (["g"], []):
        got = {(*[r[c] for c in group], r["_label"]): (r["_t"], r["_id"], r["_size"]) for r in scale.rank_cut(df, group, order, ranks).collect()}
        want = {}
        for key in {(d[0],) if group else () for d in data}:
            own = sorted((d[2] if d[2] is not None else splits.NO_TIME, d[1]) for d in data if not group or d[0] == key[0])
            for label, rank in (("first", 1), ("some", int(len(own) * 0.37)), ("last", len(own))):
                want[(*key, label)] = (*own[rank - 1], len(own))
        assert got == want


def test_splits_run_no_job_before_they_are_read(spark, contests):
    spark.sparkContext.setJobGroup("building", "")
    built = [splits.split_latest(contests, "league"), splits.split_three_ways(contests, 0.6, 0.2), splits.split_two_ways(contests)]
    built.append(metrics.exact_quantiles(contests, ["league"], "x", [0.5]))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("building")) == 0
    spark.sparkContext.setJobGroup("reading", "")
    assert all(df.count() for df in built)


def test_splits_of_nothing_and_of_everything(contests):
    assert splits.split_three_ways(contests.where("false"), 0.6, 0.2).count() == 0
    whole = splits.split_three_ways(contests, 0.5, 0.5).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in whole} == {"train": 200, "validation": 200}
    none = contests.withColumn("scheduled_at", F.when(F.col("match_id") % 3 > 0, F.col("scheduled_at")))
    parts = splits.split_two_ways(none, 0.1).where("split = 'test'")
    assert parts.count() == 40 and parts.where("scheduled_at IS NULL").count() == 0


def test_quantiles_of_values_close_together(spark):
    """Values in a thousandth, a few far away: the cells follow the data."""
    rng = np.random.default_rng(3)
    values = [*(rng.random(4000) / 1000).tolist(), *[1e9] * 5, -4.0]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    got = {r["q"]: r["x"] for r in metrics.exact_quantiles(df, [], "x", [0.0, 0.01, 0.5, 0.977, 1.0]).collect()}
    assert all(v == pytest.approx(np.percentile(values, 100 * q), rel=1e-12) for q, v in got.items())


def test_every_league_has_a_test_row(contests):
    split = splits.split_latest(contests, "league")
    sizes = {r["league"]: r for r in split.groupBy("league").agg(
        F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect()}
    assert all(r["t"] == max(1, int(r["n"] * 0.2)) for r in sizes.values())


def test_three_way_split_is_ordered_and_complete(contests):
    parts = splits.split_three_ways(contests, 0.6, 0.2).toPandas().sort_values(["scheduled_at", "match_id"])
    assert parts["split"].tolist() == ["train"] * 240 + ["validation"] * 80 + ["test"] * 80


def test_two_way_split_rounds_test_up(spark):
    df = spark.range(11).select(F.col("id").alias("match_id"), F.lit("2025-01-01").cast("timestamp").alias("scheduled_at"))
    counts = {r["split"]: r["count"] for r in splits.split_two_ways(df, 0.2).groupBy("split").count().collect()}
    assert counts == {"train": 8, "test": 3}


def test_quantiles_match_numpy(contests):
    got = {
        (r["league"], r["q"]): r["x"]
        for r in metrics.exact_quantiles(contests, ["league"], "x", [0.025, 0.5, 0.9]).collect()
    }
    pdf = contests.toPandas()
    for league, g in pdf.groupby("league"):
        for q in (0.025, 0.5, 0.9):
            assert got[(league, q)] == pytest.approx(np.percentile(g["x"], 100 * q))


def test_auc_matches_pairs(contests):
    df = contests.withColumn("p", F.col("x") / 10).withColumn("y", (F.col("match_id") % 3 == 0).cast("int"))
    got = {r["league"]: r["roc_auc"] for r in metrics.roc_auc(df, ["league"], "y", "p").collect()}
    for league, g in df.toPandas().groupby("league"):
        pos, neg = g[g.y == 1].p.to_numpy(), g[g.y == 0].p.to_numpy()
        wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
        assert got[league] == pytest.approx(wins / (len(pos) * len(neg)))


def test_auc_is_null_for_one_class(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 1, 0.7)], "league string, y int, p double")
    assert metrics.roc_auc(df, ["league"], "y", "p").first()["roc_auc"] is None


def test_league_fill_without_any_league_data(spark, rows):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", None), ("a", 3.0), ("b", None), ("b", None)], "league string, v double"
    )
    assert rows(fills.fill_league_mean(df, ["v"], "league"), "league", "v") == [
        ("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 2.0), ("b", 2.0)
    ]


def test_sided_fills_equal_direct_fills(spark, rows):
    data = [(i, "a" if i % 3 else "b", bool(j), float(i + j) if (i + j) % 4 and i % 3 else None)
            for i in range(12) for j in range(2)]
    apps = spark.createDataFrame(data, "match_id long, league string, is_road boolean, v double")
    means = fills.side_means(apps, ["v"])
    by_league = fills.sided_league_fills(means, ["v"])
    home = apps.where(~F.col("is_road"))
    direct = fills.fill_league_mean(home, ["v"], "league").select("match_id", "v")
    joined = home.join(by_league, "league").select("match_id", F.coalesce("v", "_f_home_v").alias("v"))
    assert rows(direct) == rows(joined)
    assert fills.sided_global_means(means, ["v"])["home_v"] == pytest.approx(home.agg(F.avg("v")).first()[0])
