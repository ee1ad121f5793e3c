from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from tests.llm.conftest import ODD

from tipoff.llm.repeats import GRAM, WORD_GRAM, Depth, cut_repeats, merged, op7


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(hash(b[k : k + length]) for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for doc_id, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[hash(b[k : k + length])] > 1:
                gone[k : k + length] = b"\1" * length
        runs = [x for x in bytes(gone).split(b"\0") if x]
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((doc_id, len(b), sum(gone), len(runs), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df, length):
    return sorted((tuple(r) for r in cut_repeats(df, length, "digest").collect()), key=str)


def test_odd_rows(make):
    for length in (400, 20):
        assert got(make(), length) == brute([r[:2] for r in ODD], length)


def test_documents(make, documents):
    rows = [(i, t, "en", "a") for i, t in documents[1][:120]]
    for length in (400, 61):
        assert got(make(rows), length) == brute(documents[1][:120], length)


def test_sizes_nest():
    for length in range(GRAM + 1, 1 << 12):
        sizes = Depth(length).blocks
        assert sizes[-1] == 1 and all(a > b and a % b == 0 for a, b in zip(sizes, sizes[1:], strict=False))


def test_whole_table(llm):
    """Every document of the larger table, at the length of the query and at one that cuts unevenly."""
    docs = llm.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r[0], r[1]) for r in docs.collect()]
    for length in (400, 135):
        assert got(docs, length) == brute(rows, length)


def test_many_lengths(make, documents):
    """Lengths whose offsets no block size divides."""
    picked = [r for r in documents[1] if len(r[1] or "") < 3000][:60]
    picked += [(1000 + i, f"{i} " + t[i : i + 500] + t[: 2 * i]) for i, t in picked[::2] if t]
    for length in (47, 121, 289):
        assert got(make([(i, t, "en", "a") for i, t in picked]), length) == brute(picked, length)


def test_passages_cut_at_every_place(make):
    """Pieces of one text, of all lengths around the threshold, between letters that differ."""
    rng = random.Random(3)
    base = "".join(rng.choice("abcd ") for _ in range(600))
    rows = []
    for i in range(80):
        a = rng.randrange(0, 300)
        n = rng.choice([39, 40, 41, 60, 100, 250])
        rows.append((i, "".join(rng.choice("efgh") for _ in range(rng.randrange(50))) + base[a : a + n] + f"<{i}>", "en", "a"))
    assert got(make(rows), 40) == brute([r[:2] for r in rows], 40)


def test_runs_of_one_letter(make):
    rows = [(1, "a" * 100, "en", "a"), (2, "b" * 40, "en", "a"), (3, "ab" * 30, "en", "a"), (4, "c" * 41, "en", "a")]
    assert got(make(rows), 40) == brute([r[:2] for r in rows], 40)


def test_nothing(make):
    assert cut_repeats(make([])).count() == 0


def test_merged():
    import numpy as np

    assert merged(np.array([5, 0, 2]), np.array([9, 2, 4])) == [(0, 4), (5, 9)]


def brute_words(rows, length):
    """Like brute, over words: how many of each text lie in windows found at two places."""
    texts = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    seen = Counter(tuple(w[k : k + length]) for _, w in texts for k in range(len(w) - length + 1))
    out = []
    for doc_id, w in texts:
        gone = bytearray(len(w))
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                gone[k : k + length] = b"\1" * length
        out.append((doc_id, sum(gone)))
    return sorted(out, key=str)


def got_words(df, length):
    return sorted(((r["doc_id"], r["n_repeated_words"]) for r in cut_repeats(df, words=length).collect()), key=str)


def test_words_of_odd_rows(make):
    for length in (WORD_GRAM + 1, 51):
        assert got_words(make(), length) == brute_words([r[:2] for r in ODD], length)


def test_words_of_documents(make, documents):
    rows = [(i, t, "en", "a") for i, t in documents[1]]
    for length in (7, 51):
        assert got_words(make(rows), length) == brute_words(documents[1], length)


def test_words_leave_the_other_columns(make, documents):
    rows = [(i, t, "en", "a") for i, t in documents[1][:40]]
    with_words = cut_repeats(make(rows), 61, "digest", words=9).drop("n_repeated_words")
    assert sorted((tuple(r) for r in with_words.collect()), key=str) == brute(documents[1][:40], 61)


def test_passages_under_400_bytes_are_told(llm, tmp_path):
    """Passages of over 50 words and under 400 bytes: no byte goes by contract, the query tells them all the same."""
    rng = random.Random(5)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(n))

    rows = []
    for i in range(30):
        passage = prose(rng.randrange(51, 60))
        assert len(passage) < 400 - 2 * 8
        rows += [(3 * i, f"{prose(80)} {passage} {prose(60)}"), (3 * i + 1, f"{prose(9)}\n{passage}\n{prose(200)}"), (3 * i + 2, prose(250))]
    llm.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in op7(llm, str(tmp_path)).collect()}
    assert len(found) == 90 and all(r["n_removed"] == 0 for r in found.values())
    assert {i for i, r in found.items() if r["n_repeated_words"] > 50} == {i for i in range(90) if i % 3 != 2}
    assert all(found[i]["n_repeated_words"] == 0 for i in range(2, 90, 3))


def test_words_out_of_range(make):
    with pytest.raises(ValueError, match="words"):
        cut_repeats(make(), words=WORD_GRAM)
