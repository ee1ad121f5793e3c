from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

from tests.llm.conftest import LONG, ODD, WORD

from tipoff.llm.exact import exact_groups, merge_level, merge_sorted
from tipoff.llm.mixing import mix


def brute_groups(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[text or ""].append(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        ids = [i for i in groups[text or ""] if i is not None]
        keep = max(ids) if ids else None
        digest = hashlib.sha256((text or "").encode()).hexdigest()
        out.append((doc_id, keep, len(groups[text or ""]), doc_id == keep, digest))
    return Counter(out)


def test_groups_of_odd_rows(make):
    for runs in (1, 8, 64):
        got = exact_groups(make(), runs=runs).collect()
        assert Counter(tuple(r) for r in got) == brute_groups(ODD)


def test_groups_of_documents_with_a_hot_text(make, documents):
    rows = [(i, t, "en", "a") for i, t in documents[1]] + [(1000 + i, LONG, "en", "a") for i in range(150)]
    assert Counter(tuple(r) for r in exact_groups(make(rows)).collect()) == brute_groups(rows)


def test_groups_of_nothing(make):
    assert exact_groups(make([])).count() == 0


def entries(llm, rows):
    schema = "run long, digest long, text_sha256 string, n_bytes int, keep_id long, group_size long"
    return llm.createDataFrame(rows, schema)


def test_rounds_merge_sorted_runs(llm):
    """Each round sorts and merges, and nothing is grouped in a hash table."""
    rows = [(r, d, "s", 3, 10 * r + d, 1) for r in range(64) for d in range(5)]
    level = merge_sorted(entries(llm, rows))
    for _ in range(2):
        level = merge_level(level, 3)
    got = sorted((r["run"], r["digest"], r["keep_id"], r["group_size"]) for r in level.collect())
    assert got == [(0, d, 630 + d, 64) for d in range(5)]
    plan = level._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "HashAggregate" not in plan and "Python" not in plan and "Arrow" not in plan
    assert plan.count("SortAggregate") >= 3
    assert plan.count("Sort [run#") >= 3


def test_equal_digests_of_other_texts_stay_apart(llm):
    rows = [(0, 7, "s", 3, 1, 1), (1, 7, "t", 3, 2, 1), (2, 7, "s", 4, 3, 1), (3, 7, "s", 3, None, 1), (4, 7, "u", 1, None, 1)]
    got = {(r["text_sha256"], r["n_bytes"], r["keep_id"], r["group_size"]) for r in merge_level(entries(llm, rows), 3).collect()}
    assert got == {("s", 3, 1, 2), ("t", 3, 2, 1), ("s", 4, 3, 1), ("u", 1, None, 1)}


def size(text):
    return len(WORD.findall(text or ""))


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, full = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in full]
        total = sum(weight[s] for s in open_)
        part = {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if part[s] >= cap * sizes[s]]
        if not over:
            return full | part
        for s in over:
            full[s] = cap * sizes[s]
            left -= full[s]
        if len(full) == len(order):
            return full


def test_mix_meets_targets(make, documents):
    rows = [(i, t, "en", f"s{min(i % 9, 3)}" if i % 17 else None) for i, t in documents[1]] + ODD
    got = mix(make(rows)).collect()
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += size(text)
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert r["taken"] == r["epochs"] * r["size"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for source, words in taken.items():
        assert abs(words - want[source]) <= largest[source] / 2 + 1


def test_mix_reruns_agree_and_do_not_depend_on_spans(make, documents):
    rows = [(i, t, "en", f"s{i % 3}") for i, t in documents[1]]
    first = {r["doc_id"]: r["taken"] for r in mix(make(rows)).collect()}
    assert first == {r["doc_id"]: r["taken"] for r in mix(make(rows).repartition(7), buckets=3).collect()}


def test_mix_prefers_quality(make, llm):
    rows = [(i, "w " * 10, "en", s) for i in range(400) for s in ("a",)] + [(1000 + i, "w " * 10, "en", "b") for i in range(400)]
    quality = llm.createDataFrame([(1000 + i, 50.0 if i % 2 else 0.02) for i in range(400)], "doc_id long, mix_weight double")
    got = mix(make(rows), quality, weights=(9, 1), share=1.0).where("source = 'b'").collect()
    chosen = [r["doc_id"] for r in got if r["taken"]]
    assert chosen and sum(i % 2 for i in chosen) > 0.9 * len(chosen)


def test_mix_of_nothing(make):
    assert mix(make([])).count() == 0
    assert [r["taken"] for r in mix(make([(1, None, "en", "a")])).collect()] == [0]
