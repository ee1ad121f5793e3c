from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from tests.llm.conftest import ODD, WORD

from tipoff.llm.graph import components
from tipoff.llm.jaccard import Bound, near_groups


def shingles(text, width):
    words = [w.encode().lower() for w in WORD.findall(text or "")]
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1))


def roots(pairs, ids):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(rows, width=5, percent=80):
    sets = {i: shingles(t, width) for i, t in rows}
    holders = defaultdict(list)
    pairs = []
    for i in sorted(sets):
        shared = Counter(j for g in sets[i] for j in holders[g])
        pairs += [(i, j) for j, n in shared.items() if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n)]
        for g in sets[i]:
            holders[g].append(i)
    root = roots(pairs, sets)
    return sorted((i, len(sets[i]), root[i]) for i in sets)


def got(df, **settings):
    return sorted(tuple(r) for r in near_groups(df, **settings).collect())


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def near_copies():
    """Groups of near copies of texts of many lengths, close to the threshold on both sides, and a
    large group that all but a few texts of one length belong to."""
    rng = random.Random(11)
    rows = []
    for n in [3, 8, 9, 10, 11, 12, 13, 19, 20, 25, 30, 45, 60, 90, 150, 400]:
        base = [f"w{rng.randrange(500)}" for _ in range(n + 2)]
        for _ in range(8):
            text = edited(rng, base, rng.randrange(0, 1 + n // 20 + (rng.random() < 0.3)))
            rows.append((len(rows), text + rng.choice(["", " tail", " Tail end"])))
    base = [f"h{rng.randrange(900)}" for _ in range(120)]
    rows += [(1000 + i, edited(rng, base, rng.choice([0, 1, 1, 2, 3, 4]))) for i in range(150)]
    return rows


def test_near_copies(make, near_copies):
    df = make([(i, t, "en", "a") for i, t in near_copies])
    for contract in ({"width": 3, "percent": 90}, {"width": 5, "percent": 85}, {"width": 5, "percent": 80}):
        want = brute(near_copies, **contract)
        assert sum(i != root for i, _, root in want) > 100
        assert got(df, **contract) == want
        # Small blocks: large groups go by their pivot, and are spread over several blocks.
        assert got(df, block_size=1000, **contract) == want


def test_other_widths_and_thresholds(make, near_copies):
    df = make([(i, t, "en", "a") for i, t in near_copies])
    assert got(df, width=2, percent=70) == brute(near_copies, 2, 70)


def test_documents(make, documents):
    df = make([(i, t, "en", "a") for i, t in documents[1]])
    assert got(df) == brute(documents[1])


def test_rare_elements_part_texts_that_quote_one_passage(make, llm):
    from tipoff.llm.jaccard import _packed, rare_classes
    import numpy as np

    rng = np.random.default_rng(3)
    sets, links = {}, []
    passage = rng.integers(0, 1 << 48, 60, dtype=np.uint64)
    for i in range(80):
        own = rng.integers(0, 1 << 48, 100, dtype=np.uint64)
        sets[2 * i] = np.concatenate([passage, own])
        if i < 20:
            # A partner at the bound: of 160 elements it has 143 in common with it, and 17 others.
            sets[2 * i + 1] = np.concatenate([passage, own[:83], rng.integers(0, 1 << 48, 17, dtype=np.uint64)])
            links.append((2 * i, 2 * i + 1))
    rows = [(7, k, len(v), bytearray(_packed(np.sort(v)))) for k, v in sets.items()]
    df = llm.createDataFrame(rows, "super long, node long, n long, elements binary")
    classes = defaultdict(set)
    for r in rare_classes(df, Bound(80)).collect():
        classes[r["super"]].add(r["node"])
    assert sorted(map(sorted, classes.values())) == sorted(map(list, links))


def test_only_elements_that_can_come_first_are_shuffled():
    from tipoff.llm.jaccard import _element_keys, _packed
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(4)
    for percent in (70, 80, 90):
        bound, sizes = Bound(percent), [1, 2, 3, 7, 40, 900, 3000]
        sets = [np.sort(rng.integers(0, 1 << 48, n, dtype=np.uint64)) for n in sizes]
        columns = [pa.array([7] * len(sets)), pa.array(range(len(sets))), pa.array([_packed(s) for s in sets], pa.binary())]
        batch = pa.RecordBatch.from_arrays(columns, ["super", "node", "elements"])
        out = next(iter(_element_keys(bound)(iter([batch]))))
        for n, own, keys in zip(sizes, out.column("own").to_pylist(), out.column("keys").to_pylist(), strict=True):
            counted = bound.rare(n) - own
            assert len(keys) == max(counted, bound.rare(n)) and len(set(keys)) == len(keys)
            assert n < 900 or bound.rare(n) < len(keys) < 1.1 * bound.counted * n


def test_quoted_passages_and_repeated_rows(make):
    rng = random.Random(5)
    passage = [f"p{rng.randrange(900)}" for _ in range(60)]
    rows = []
    for i in range(60):
        own = [f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 200))]
        rows.append((len(rows), " ".join(passage + own)))
        if i % 3 == 0:
            rows.append((len(rows), edited(rng, passage + own, rng.randrange(0, 4))))
    want = brute(rows)
    assert 5 < sum(i != root for i, _, root in want) < 21
    for size in (300, 2_000_000):
        assert got(make([(i, t, "en", "a") for i, t in rows]), block_size=size) == want
    twice = sorted(want + 2 * want[:9])
    assert got(make([(i, t, "en", "a") for i, t in rows + 2 * rows[:9]]), block_size=300) == twice


def test_odd_rows(make):
    rows = [r for r in ODD if r[0] is not None and r[0] != 8] + [ODD[7]]
    assert got(make(rows)) == brute([r[:2] for r in rows])
    with_null = near_groups(make()).collect()
    assert len(with_null) == len(ODD)
    assert {r["component_id"] for r in with_null if r["doc_id"] in (7, 8)} == {7}
    assert [r["component_id"] for r in with_null if r["doc_id"] is None] == [None]


def test_nothing(make):
    assert near_groups(make([])).count() == 0


def test_bound_never_asks_for_too_much():
    import numpy as np

    for percent in (70, 80, 90):
        bound = Bound(percent)
        for a in range(1, 60):
            for b in range(a, 70):
                least = int(bound.shared(np.array(a + b)))
                linked = [i for i in range(a + 1) if bound.linked(i, a + b)]
                assert not linked or linked[0] == least


def test_empty_zones_are_allowed_for():
    """Few sets of a band have more empty zones than it allows for."""
    import numpy as np

    rng = np.random.default_rng(4)
    for percent in (80, 90):
        bound = Bound(percent)
        edges = bound.bands(3000)
        for low, zones, spare in zip(edges, *bound.zones(edges), strict=False):
            sets = rng.integers(0, zones, (400, low))
            empty = np.array([zones - len(np.unique(s)) for s in sets])
            assert (empty > spare).mean() < 0.05, (percent, low)


def test_components(llm):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    pairs += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(80)]
    found = {r["node"]: r["root"] for r in components(llm.createDataFrame(pairs, "u long, v long")).collect()}
    want = roots(pairs, {i for p in pairs for i in p})
    assert found == {i: r for i, r in want.items() if i != r}


def test_default_bound_is_four_fifths(make):
    """Texts with 0.80 to 0.85 of their runs of five words in common are linked, by the default."""
    rows = []
    for n, replaced in ((100, 2), (200, 4), (400, 7)):
        words = [f"d{n}x{k}" for k in range(n)]
        copy = [f"new{k}" if k % (n // replaced) == n // replaced // 2 and k // (n // replaced) < replaced else w for k, w in enumerate(words)]
        assert sum(a != b for a, b in zip(words, copy, strict=True)) == replaced
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(copy))]
    want = brute(rows, percent=80)
    assert [root for _, _, root in want] == [0, 0, 2, 2, 4, 4]
    assert [root for _, _, root in brute(rows, percent=85)] == list(range(6))
    assert got(make([(i, t, "en", "a") for i, t in rows])) == want


def test_linked_sizes_have_a_cell_in_common(llm):
    from pyspark.sql import functions as F

    for percent in (70, 80, 90, 100):
        sizes = llm.range(1, 4000).select("id", Bound(percent).cells(F.col("id")).alias("cells")).collect()
        cells = {r["id"]: set(r["cells"]) for r in sizes}
        for n in cells:
            least = -(-n * percent // 100)
            assert all(cells[n] & cells[m] for m in range(least, n + 1)), (percent, n)


def test_documents_at_four_fifths(make, documents):
    df = make([(i, t, "en", "a") for i, t in documents[1]])
    assert got(df) == brute(documents[1], percent=80)
    assert got(df, block_size=1000) == brute(documents[1], percent=80)
