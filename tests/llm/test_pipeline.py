from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm.conftest import ODD
from tests.llm.test_jaccard import brute as brute_groups
from tests.llm.test_lines import brute as brute_lines

from tipoff.llm import stages
from tipoff.llm.exact import exact_groups
from tipoff.llm.textbytes import SpanHash, Words

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(llm):
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in llm.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = stages.toxicity(llm, docs, SF).cache()
    gone = {r[0] for r in docs.select("doc_id").collect()} - {r[0] for r in clean.select("doc_id").collect()}
    assert gone and sum(labels.get(i) == 0 for i in gone) <= 0.02 * len(labels)

    lines = stages.line_dedup(llm, clean, SF).cache()
    assert lines.columns == docs.columns and lines.count() == clean.count()
    want = {r[0]: r[3] for r in brute_lines([(r["doc_id"], r["text"]) for r in clean.collect()])}
    assert {r["doc_id"]: r["text_sha256"] for r in exact_groups(lines).collect()} == want
    assert lines.where("n_chars <> length(text)").count() == 0

    single = stages.near_duplicates(llm, lines, SF).cache()
    rows = [(r["doc_id"], r["text"]) for r in lines.collect()]
    assert {r["doc_id"] for r in single.collect()} == {i for i, _, root in brute_groups(rows) if i == root}

    mixed = stages.mix(llm, single, SF).cache()
    assert mixed.columns == docs.columns
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert set(times) <= {r["doc_id"] for r in single.collect()} and max(times.values()) <= 2

    pieces = stages.pack(llm, mixed, SF).collect()
    total = defaultdict(int)
    for r in pieces:
        total[r["doc_id"]] += r["length"]
        assert len(r["ids"]) == r["length"] <= 1024
    tokens = {r["doc_id"]: r["doc_tokens"] for r in pieces}
    assert {i: tokens[i] * n for i, n in times.items()} == total


def test_whole_pipeline(llm):
    assert corpus_pipeline.run(llm, SF).count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "mix", "pack"]


def test_stages_of_odd_rows(make, llm):
    for docs in (make(), make([])):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(llm, docs, SF)
            assert out.columns == docs.columns
            out.count()
    assert stages.near_duplicates(llm, make(), SF).where("doc_id IS NULL OR doc_id < 4").count() == 4
    assert stages.line_dedup(llm, make(), SF).count() == len(ODD)


def test_words_and_spans():
    import numpy as np

    texts = [b"", b"ab cd", b"ef", b" ", b"g\tHI  j", b"", b"k"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    words = Words(data, offsets)
    spans = [bytes(data[a:b]) for a, b in zip(words.starts, words.ends, strict=True)]
    assert spans == [w for t in texts for w in t.split()]
    assert words.counts.tolist() == [len(t.split()) for t in texts]
    hasher = SpanHash(1, lower=True)
    twice = np.concatenate([data, np.frombuffer(b"hi HI", np.uint8)])
    hasher.load(twice)
    n = len(data)
    a, b, c = hasher.spans(np.array([n, n + 3, 0]), np.array([n + 2, n + 5, 2]))
    assert a == b != c


def test_near_duplicates_link_from_four_fifths(llm):
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    left = {r["doc_id"] for r in stages.near_duplicates(llm, docs, SF).collect()}
    assert left == {i for i, _, root in brute_groups(rows, percent=80) if i == root}
    assert left != {i for i, _, root in brute_groups(rows, percent=85) if i == root}
