"""Digests by array operations against hashlib, and the draws that are counted from them."""

from __future__ import annotations

import math
import random
from hashlib import md5

import numpy as np
import pytest

from tipoff.operators import digests, settle


@pytest.mark.parametrize("length", [0, 7, 46, 52, 53, 54, 55, 56, 61, 64, 130])
def test_digests_are_those_of_hashlib(length, monkeypatch):
    monkeypatch.setattr(digests, "TEXTS_AT_ONCE", 100)
    rng = random.Random(length)
    prefix = bytes(rng.randrange(33, 250) for _ in range(length))
    first = np.array([rng.choice([0, 7, 9, 10, 99, 100, 5000, 12_345_678]) for _ in range(400)])
    second = np.array([rng.choice([0, 9, 10, 999, 1000, 16_383, 9_999_999_999]) for _ in range(400)])
    got = {}
    for places, words in digests.of_pairs(prefix, first, second):
        got |= {int(i): b"".join(int(w[n]).to_bytes(4, "big") for w in words) for n, i in enumerate(places)}
    assert got == {i: md5(prefix + b"%d-%d" % pair).digest() for i, pair in enumerate(zip(first, second, strict=True))}


def test_first_number_of_a_slot():
    rng = random.Random(3)
    for size in (1, 2, 3, 7, 4096, 150_001, 2**31 + 11):
        for slot in {0, size, *(rng.randrange(size) for _ in range(20))}:
            first = settle._first_number(size, slot)
            assert first == 2**32 or math.floor(first / 4294967296.0 * size) >= slot
            assert first == 0 or math.floor((first - 1) / 4294967296.0 * size) < slot
    assert settle._first_number(5, 5) == 2**32 and settle._first_number(5, 0) == 0


@pytest.mark.parametrize(("size", "wins", "losses"), [(1, 1, 1), (1, 0, 0), (5, 2, 3), (64, 64, 64), (203, 90, 120), (90, 0, 0)])
def test_drawn_counts(size, wins, losses, monkeypatch):
    monkeypatch.setattr(digests, "TEXTS_AT_ONCE", 20)
    pieces = [(b, start) for b in (1, 2, 9, 10, 11, 4999) for start in range(0, size, 64)]
    want = []
    for b, start in pieces:
        at = []
        for i in range(start, min(size, start + 64)):
            digest = md5(f"x-0.50-{b}-{i // 4}".encode()).hexdigest()
            at.append(math.floor(int(digest[8 * (i % 4) : 8 * (i % 4) + 8], 16) / 2**32 * size))
        want.append((sum(x < wins for x in at), sum(x >= losses for x in at)))
    draws, starts = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
    won, lost = settle._drawn("x-0.50", size, wins, losses, draws.astype(np.int32), starts, 64)
    assert list(zip(won.tolist(), lost.tolist(), strict=True)) == want


def test_digests_are_array_operations(monkeypatch):
    """Pieces of several draws are digested together: rounds are gone through once for many texts."""
    calls = []
    rounds = digests._rounds
    monkeypatch.setattr(digests, "_rounds", lambda *a: calls.append(a[2]) or rounds(*a))
    settle._drawn("x-0.50", 4000, 1000, 2000, np.arange(100, 150), np.zeros(50, np.int64), settle.POSITIONS)
    assert sum(calls) == 50 * 1000 and len(calls) <= 12


def test_pieces_are_spread_over_all_cores(spark):
    report = spark.createDataFrame([("a", 900, 800, 40)], "league string, wins long, losses long, pushes long")
    out = settle.bootstrap_interval_indexed(report, ["league"], 50)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and f", {4 * spark.sparkContext.defaultParallelism}), REPARTITION_BY_NUM" in plan
