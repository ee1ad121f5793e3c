from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from tests.llm.conftest import ODD

from tipoff.llm.variants import group_variants, path_numbers

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows, every=0, least=6, count=5, factor=5):
    words = Counter()
    for doc_id, text in rows:
        for run in LETTERS.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    words = {w: n for w, n in words.items() if len(w) >= least and n >= count}
    form, near = {}, {}
    for w in words:
        others = [v for v in words if abs(len(v) - len(w)) < 2 and one_apart(v, w)]
        near[w] = len(others)
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= factor * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, near[w], words.get(form[w])))
    return sorted(out)


def got(df, **settings):
    found = group_variants(df, **settings).select("word", "form", "root", "n", "n_near", "form_n")
    return sorted(tuple(r) for r in found.collect())


def test_odd_rows(make):
    rows = [r[:2] for r in ODD] + [(20 + i, "Naïveté × NAïVETé naïvete÷ İstanbul") for i in range(6)]
    rows += [(None, "hyphen-ated Straße KKelvin" * 5), (40, "ÀÉÎÕÜ àéîõü" * 9)]
    settings = {"damage_every": 3}
    assert got(make([(i, t, "en", "a") for i, t in rows]), **settings) == brute(rows, 3)


def test_made_words(make):
    """Runs of equal letters, words one letter apart in chains, ties."""
    rng = random.Random(5)
    base = ["aabbaa", "mississippi", "bookkeeper", "letters", "zzzzzzz", "ñandúes"]
    rows = []
    for i in range(300):
        word = rng.choice(base)
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            k = rng.randrange(len(word))
            word = rng.choice([word[:k] + word[k + 1 :], word[:k] + rng.choice("abzñ") + word[k:], word[:k] + rng.choice("abñ") + word[k + 1 :], word[:k] + word[k] + word[k:]])
        rows.append((i, f"{word} " * rng.choice([1, 3, 5, 30])))
    df = make([(i, t, "en", "a") for i, t in rows])
    for settings in ({}, {"least_letters": 5, "least_count": 1, "factor": 2}):
        names = {"least_letters": "least", "least_count": "count", "factor": "factor"}
        assert got(df, **settings) == brute(rows, **{names[k]: v for k, v in settings.items()})


def test_long_chain_and_long_word(make):
    """A chain of forms longer than five, and a run of many thousand letters."""
    chain = ["abcdefgh"[: 6] + "x" * i for i in range(7)]
    rows = [(i, f"{w} " * 2**i) for i, w in enumerate(chain)] + [(50, "q" * 3000 + " " + "q" * 3001)]
    df = make([(i, t, "en", "a") for i, t in rows])
    result = got(df, least_count=1, factor=2)
    assert result == brute(rows, count=1, factor=2)
    assert {r[2] for r in result if r[0].startswith("abc")} == {chain[-1]}


def test_documents(llm, documents):
    df, rows = documents
    assert got(df, damage_every=199) == brute(rows, 199)


def test_node_numbers():
    assert path_numbers("abc")[:3] == path_numbers("abd")[:3] and path_numbers("abc")[3] != path_numbers("abd")[3]
    assert len(path_numbers("")) == 1


def test_nothing_and_settings(make):
    assert got(make([])) == []
    with pytest.raises(ValueError):
        group_variants(make([]), factor=1)
