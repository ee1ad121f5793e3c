from __future__ import annotations

import datetime as dt
import itertools
import json
import random

from pyspark.sql import functions as F

from tipoff.operators import linking, merge
from tipoff.session import fresh_path
from tipoff.sources import payloads, sinks
from tipoff.streaming import enrichment


def test_upsert_keeps_immutable_and_unlisted_columns(spark, rows):
    base = spark.createDataFrame([(1, "a", 10, 1.0), (2, "b", 20, 2.0)], "id long, team string, score int, line double")
    new = spark.createDataFrame([(2, "x", None), (3, "c", 30)], "id long, team string, score int")
    out = merge.upsert(base, new, ["id"], immutable=["team"])
    assert rows(out, "id", "team", "score", "line") == [(1, "a", 10, 1.0), (2, "b", None, 2.0), (3, "c", 30, None)]


def test_replace_patch_and_insert(spark, rows):
    base = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "id long, n int")
    new = spark.createDataFrame([(1, 9)], "id long, n int")
    assert rows(merge.replace_by_key(base, new, ["id"]), "id", "n") == [(1, 9), (2, 1)]
    change = spark.createDataFrame([(1, None)], "id long, n int")
    assert rows(merge.patch(base, change, "id", ["n"]), "id", "n") == [(1, None), (1, None), (2, 1)]
    teams = spark.createDataFrame([(4, "k1", "old")], "team_id long, key string, name string")
    seen = spark.createDataFrame([("k1", "new", 1), ("k2", "first", 2), ("k2", "later", 3), ("k3", "z", 1)], "key string, name string, at int")
    out = merge.insert_absent(teams, seen, "key", ["at"], "team_id")
    got = rows(out, "key", "name")
    assert got == [("k1", "old"), ("k2", "first"), ("k3", "z")]
    assert sorted(r["team_id"] for r in out.collect()) == [4, 5, 6]


def test_first_source_wins(spark, rows):
    a = spark.createDataFrame([(1, "a")], "id long, src string")
    b = spark.createDataFrame([(1, "b"), (2, "b")], "id long, src string")
    assert rows(merge.merge_sources([a, b], "id"), "id", "src") == [(1, "a"), (2, "b")]


def _similarity(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    small, big = sorted((x, y), key=len)
    score = len(x & y) / len(big)
    return max(score, 0.5 + 0.25 * len(small) / len(big)) if small <= big else score


def test_linking_equals_all_pairs(spark, rows):
    """Random names with one word in almost all of them, one crowded day, ties and empty names."""
    rng = random.Random(11)
    words = ["united", "north", "south", "river", "hill", "lake", "old", "new"]

    def name():
        picked = rng.sample(words[1:], rng.randint(0, 3)) + (["united"] if rng.random() < 0.8 else [])
        return " ".join(sorted(picked))

    def day():
        return dt.date(2025, 1, 5) if rng.random() < 0.4 else dt.date(2025, 1, 1) + dt.timedelta(days=rng.randint(0, 9))

    left = [(i, rng.choice("xy"), day(), name(), name()) for i in range(60)]
    right = [(i, rng.choice("xy"), None if i % 17 == 0 else day(), name(), name()) for i in range(120)]
    schema = "{} long, league string, date date, home_norm string, away_norm string"
    rows_df = spark.createDataFrame(left, schema.format("row_id"))
    cands = spark.createDataFrame(right, schema.format("cand_id"))
    for threshold, window, undated in ((0.4, 1, True), (0.5, 1, False), (0.8, 3, False)):
        want = []
        for i, lg, d, h, a in left:
            best = None
            for j, lg2, d2, h2, a2 in right:
                near = undated if d2 is None else abs((d2 - d).days) <= window
                if lg != lg2 or not near:
                    continue
                score = (_similarity(h, h2) + _similarity(a, a2)) / 2
                if best is None or score > best[1]:
                    best = (j, score)
            if best and best[1] >= threshold:
                want.append((i, best[0], round(best[1], 9)))
        got = rows(linking.link(rows_df, cands, threshold, window, undated), "row_id", "cand_id", "score")
        assert sorted(got) == sorted(want)


def test_a_word_of_all_names_pairs_names_of_one_block_only(spark):
    schema = "league string, day int, name string"
    left = spark.createDataFrame([("x", i // 10, f"united a{i}") for i in range(1000)], schema)
    right = spark.createDataFrame([("x", i // 10, f"united b{i}") for i in range(1000)], schema)
    pairs = linking.similar_names(left, right, 0.5, ["league", "day"])
    assert pairs.count() == 100 * 10 * 10
    assert pairs.where("int(substring(a, 9)) div 10 <> int(substring(b, 9)) div 10").count() == 0


def test_one_day_off_links_and_two_do_not(spark):
    row = spark.createDataFrame([(1, "l", dt.date(2025, 1, 5), "bonn", "ulm")], "row_id long, league string, date date, home_norm string, away_norm string")
    for off, n in ((1, 1), (2, 0)):
        cand = spark.createDataFrame([(7, "l", dt.date(2025, 1, 5 + off), "bonn", "ulm")], "cand_id long, league string, date date, home_norm string, away_norm string")
        assert linking.link(row, cand).count() == n


def _payload(fga):
    items = [
        {"name": n, "home": h, "away": "5/9" if "/" in h else "4"}
        for n, h in (("Field goals", f"30/{fga}"), ("3-Pointers", "5/20"), ("Free throws", "10/20"),
                     ("Turnovers", "10"), ("Offensive rebounds", "8"), ("Defensive rebounds", "30"))
    ]
    return json.dumps({"statistics": [{"period": "ALL", "groups": [{"groupName": "g", "statisticsItems": items}]}]})


def _land(spark, path, data):
    spark.createDataFrame(data, enrichment.PAYLOAD_SCHEMA).coalesce(1).write.mode("append").json(path)


def test_stream_is_incremental_and_idempotent(spark):
    landing, root, state = (fresh_path(spark, n) for n in ("land", "table", "state"))
    matches = spark.createDataFrame(
        [(i, 10 + i, 20 + i, 100, 90) for i in range(4)],
        "match_id long, home_team_id long, away_team_id long, home_score_final int, away_score_final int",
    )
    _land(spark, landing, [(0, 1, _payload(70)), (1, 1, _payload(70)), (2, 1, "{}")])
    enrichment.run_available(spark, landing, matches, root, state)
    first = {(r["match_id"], r["team_id"]): r["possessions"] for r in enrichment.stored(spark, root).collect()}
    assert set(first) == set(itertools.chain([(0, 10), (0, 20)], [(1, 11), (1, 21)]))
    assert round(first[(0, 10)], 6) == round(70 + 0.44 * 20 - 8 + 10, 6)
    _land(spark, landing, [(1, 3, _payload(60)), (1, 2, _payload(50)), (3, 1, _payload(80))])
    enrichment.run_available(spark, landing, matches, root, state)
    version = sinks.latest_version(spark, root)
    second = {(r["match_id"], r["team_id"]): r["possessions"] for r in enrichment.stored(spark, root).collect()}
    assert len(second) == 6 and second[(0, 10)] == first[(0, 10)]
    assert round(second[(1, 11)], 6) == round(60 + 0.44 * 20 - 8 + 10, 6)
    enrichment.run_available(spark, landing, matches, root, state)
    assert sinks.latest_version(spark, root) == version


def test_first_listed_row_of_a_repeated_key_wins(spark, rows):
    a = spark.createDataFrame([(1, "z", 0), (1, "a", 1), (1, "b", 2)], "id long, src string, at long")
    b = spark.createDataFrame([(1, "c", 0)], "id long, src string, at long")
    assert rows(merge.merge_sources([a, b], "id", ["at"]), "id", "src") == [(1, "z")]


def test_late_payloads_never_replace_newer_ones(spark):
    landing, root, state, rejects = (fresh_path(spark, n) for n in ("land", "table", "state", "rejects"))
    matches = spark.createDataFrame(
        [(i, 10 + i, 20 + i, 100, 90) for i in range(6)],
        "match_id long, home_team_id long, away_team_id long, home_score_final int, away_score_final int",
    )
    for data in ([(1, 3, _payload(70)), (2, 1, _payload(70))], [(1, 2, _payload(50)), (3, 1, "{}")], [(1, 4, "{}"), (2, 2, _payload(60))]):
        _land(spark, landing, data)
        enrichment.run_available(spark, landing, matches, root, state, rejects=rejects)
    got = {(r["match_id"], r["team_id"]): (r["seq"], round(r["possessions"] - 0.44 * 20 - 2, 6)) for r in enrichment.stored(spark, root).collect()}
    assert got[(1, 11)] == (3, 70) and got[(2, 12)] == (2, 60) and len(got) == 4
    assert enrichment.run_counts(spark, root, rejects) == {"enriched": 4, "no full-game block": 2}


def test_only_touched_parts_are_written(spark):
    root = fresh_path(spark, "table")

    def rows(n, seq):
        return spark.createDataFrame([(i, i, 1.0 * seq, seq) for i in n], "match_id long, team_id long, possessions double, seq long")

    enrichment.merge_into(spark, root, rows(range(200), 1))
    enrichment.merge_into(spark, root, rows([7], 2))
    parts = sinks.newest_parts(spark, root, "bucket")
    assert sum("version=2" in path for path in parts.values()) == 1 and len(parts) > 50
    assert {r["possessions"] for r in enrichment.stored(spark, root).where("match_id = 7").collect()} == {2.0}
    assert enrichment.stored(spark, root).count() == 200


def test_listings_do_not_grow_with_batches(spark):
    """Many merges: folders stay few, an old part stays readable, the newest rows win."""
    root = fresh_path(spark, "table")

    def rows(n, seq):
        return spark.createDataFrame([(i, i, 1.0 * seq, seq) for i in n], "match_id long, team_id long, possessions double, seq long")

    enrichment.merge_into(spark, root, rows(range(100), 1))
    sizes = []
    for seq in range(2, 14):
        enrichment.merge_into(spark, root, rows([seq % 3], seq))
        sizes.append((len(sinks._folders(spark, root)), len(sinks._folders(spark, f"{root}/manifest"))))
    assert max(s[0] for s in sizes) <= 3 + 3 + 2 and max(s[1] for s in sizes) <= sinks.KEPT_MANIFESTS
    got = {r["match_id"]: r["seq"] for r in enrichment.stored(spark, root).collect()}
    assert len(got) == 100 and [got[i] for i in range(4)] == [12, 13, 11, 1]


def test_an_unfinished_write_is_not_seen(spark):
    root = fresh_path(spark, "table")
    df = spark.createDataFrame([(1, 1, 1.0, 1)], "match_id long, team_id long, possessions double, seq long")
    enrichment.merge_into(spark, root, df)
    before = sinks.newest_parts(spark, root, "bucket")
    df.withColumn("bucket", F.lit(5)).write.partitionBy("bucket").parquet(f"{root}/version=2")
    assert sinks.newest_parts(spark, root, "bucket") == before
    enrichment.merge_into(spark, root, df.withColumn("seq", F.lit(2).cast("long")))
    assert [r["seq"] for r in enrichment.stored(spark, root).collect()] == [2]


def test_malformed_lines_are_stored_and_the_rest_goes_on(spark):
    landing, root, state, rejects = (fresh_path(spark, n) for n in ("land", "table", "state", "rejects"))
    matches = spark.createDataFrame([(1, 11, 21, 100, 90)], "match_id long, home_team_id long, away_team_id long, home_score_final int, away_score_final int")
    good = json.dumps({"match_id": 1, "seq": 1, "payload": _payload(70)})
    lines = ['{"match_id": 1, "seq"', good, "not json", '{"match_id": "one", "seq": 1}', '{"seq": 4}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(landing)
    enrichment.run_available(spark, landing, matches, root, state, rejects=rejects)
    assert enrichment.run_counts(spark, root, rejects) == {"enriched": 2, "malformed line": 3, "no match id": 1}
    kept = {r["malformed"] for r in spark.read.parquet(rejects).collect()}
    assert kept == {lines[0], lines[2], lines[3], None}
    read = payloads.read_json(spark, landing, enrichment.PAYLOAD_SCHEMA, "bad")
    whole, bad = payloads.split_malformed(read, "bad")
    assert whole.count() == 2 and {r["bad"] for r in bad.collect()} == {lines[0], lines[2], lines[3]}


def test_rejected_payloads_have_reasons(spark):
    df = spark.createDataFrame([(1, 1, "{}"), (2, 1, _payload(20))], enrichment.PAYLOAD_SCHEMA)
    got = {r["match_id"]: r["reject_reason"] for r in enrichment.rejected(df).collect()}
    assert got == {1: "no full-game block", 2: "home: field goals"}


def test_csv_round_trip(spark, rows):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 2.5)], "id long, s string, x double")
    assert rows(sinks.round_trip_csv(df)) == rows(df.withColumn("x", F.col("x")))
