from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import ODD, WORD

from tipoff.llm import kneser_ney, language, quality, toxicity
from tipoff.llm.catalog import callables

SF = "/root/testdata/sf0.001"
SF_MORE = "/root/testdata/sf0.01"


# -- language model


def tokens(text):
    return [w.encode().lower() for w in WORD.findall(text or "")] + ["end"]


class Brute:
    def __init__(self, texts):
        rows = [tokens(t) for t in texts]
        self.c = Counter(w for r in rows for w in r)
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.pairs = Counter(p for r in rows for p in zip(["begin", *r], r, strict=False))
        self.first, self.after, self.before = Counter(), defaultdict(lambda: [0, 0, 0]), Counter()
        for (u, w), k in self.pairs.items():
            self.first[u] += k
            self.after[u][min(k, 3) - 1] += 1
            self.before[w] += 1
        self.d = self.discounts(self.pairs)
        self.low = self.discounts(self.before)
        kinds = len(self.pairs)
        self.mass = sum(self.low[min(k, 3) - 1] for k in self.before.values()) / kinds if kinds else 1.0

    @staticmethod
    def discounts(counts):
        n = [sum(k == i for k in counts.values()) for i in (1, 2, 3, 4)]
        if min(n) == 0:
            return 0.5, 1.0, 1.5
        y = n[0] / (n[0] + 2 * n[1])
        return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3))

    def one(self, w):
        k = self.before.get(w, 0)
        return (k - self.low[min(k, 3) - 1] if k else 0) / max(1, len(self.pairs)) + self.mass / (self.v + 1)

    def p(self, u, w):
        if u not in self.first:
            return self.one(w)
        k = self.pairs.get((u, w), 0)
        mass = sum(a * b for a, b in zip(self.d, self.after[u], strict=True)) / self.first[u]
        return (k - self.d[min(k, 3) - 1] if k else 0) / self.first[u] + mass * self.one(w)

    def row(self, text):
        t = tokens(text)
        base = sum(math.log10((self.c[w] + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in t)
        score = sum(math.log10(self.p(u, w)) for u, w in zip(["begin", *t], t, strict=False))
        return len(t), sum(self.c[w] > 0 for w in t), self.n, base, score


def test_scores_equal_a_plain_model(llm):
    got = {r["doc_id"]: tuple(r) for r in callables()["op2_kneser_ney"](llm, SF_MORE).collect()}
    rows = [(r["doc_id"], r["text"]) for r in llm.read.parquet(f"{SF_MORE}/documents.parquet").collect()]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 1}
    model = Brute([t for i, t in rows if i not in held])
    assert abs(sum(model.p(b"the", w) for w in model.c) + model.p(b"the", "unknown") - 1) < 1e-9
    better = 0
    for i, text in rows:
        want = (i, i in held, *model.row(text))
        assert got[i] == pytest.approx(want, rel=1e-9), i
        better += i in held and want[6] > want[5]
    assert better > 0.9 * len(held)


def test_scores_of_odd_rows_with_many_shards(make):
    docs = make(ODD)
    for shard_bytes in (64 << 20, 64):
        model = kneser_ney.train(docs, shard_bytes)
        plain = Brute([r[1] for r in ODD])
        got = sorted(map(tuple, kneser_ney.score(docs, model).collect()), key=str)
        want = sorted(((r[0], *plain.row(r[1])) for r in ODD), key=str)
        for a, b in zip(got, want, strict=True):
            assert a[0] == b[0] and a[1:] == pytest.approx(b[1:], rel=1e-9)


def test_pairs_of_frequent_words_are_spread():
    layout = kneser_ney.Layout("", 4, 64, hot=10)
    second = np.arange(1000, dtype=np.uint64)
    first = np.full(1000, 7, np.uint64)
    assert len(set(layout.pair_shard(first, second, np.full(1000, 5)).tolist())) == 1
    assert len(set(layout.pair_shard(first, second, np.full(1000, 50)).tolist())) > 8


def test_model_of_nothing(make):
    model = kneser_ney.train(make([]))
    assert model.n_tokens == 0
    assert {r["score"] for r in kneser_ney.score(make(), model).collect()} == {0.0}


# -- language


def test_language_of_held_out_documents(llm):
    found = callables()["op3_language_id"](llm, "/root/testdata/sf0.01").join(
        llm.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id"
    )
    rows = found.where("held_out").collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert {r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found.collect()} == {True}
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98


def test_language_of_odd_rows(make):
    docs = make()
    net = language.train_network(docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang"), epochs=2)
    rows = language.predict(docs, net).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        if r["doc_id"] in (1, 2, 3, 10, 11):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in {"en", "fr", "de", "es"}
    assert {r["lang_pred"] for r in language.predict(docs, None).collect()} == {"und"}
    assert language.predict(make([]), net).count() == 0


def test_lookup_by_pairs_equals_the_network():
    net = language.Network.fresh(("a", "b", "c"), 1)
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 256, (50, language.WINDOW + language.OVERLAP), dtype=np.uint8)
    hidden, _ = net.pooled(rows)
    assert np.allclose(net.probabilities(rows), net.softmax(hidden @ net.out + net.out_bias), atol=1e-5)


def test_windows_hold_every_gram():
    data = np.frombuffer(b"x" * 300 + b"yz" + b"w" * 128, np.uint8)
    rows, owner = language.cut_windows(data, np.array([0, 300, 302, 302, 430]))
    assert owner.tolist() == [0, 0, 0, 1, 3]
    assert bytes(rows[3][:4]) == b"yz\0\0" and bytes(rows[0]) == b"x" * 131


# -- quality


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    threes = Counter(zip(words, words[1:], words[2:], strict=False))
    again = {k + j for k in range(len(words) - 2) if threes[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_counts_equal_plain_ones(make, documents):
    rows = ODD + [(i, t, "en", "a") for i, t in documents[1]] + [(5000, "a b c\na b c\n a b c\n\n|x| <y>", "en", "a")]
    got = sorted((tuple(r) for r in quality.measure(make(rows)).select("doc_id", *quality.COUNTS).collect()), key=str)
    assert got == sorted(((i, *brute_counts(t)) for i, t, *_ in rows), key=str)


def test_verdicts(make, llm):
    docs, labels = (llm.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    # Half of the labels train, the other half are compared with.
    found = quality.quality_rules(docs, labels.where("doc_id % 2 = 0"))
    rows = found.withColumnRenamed("quality", "p").join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert all(not r["kept"] for r in rows if r["base_failed"])
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in rows)
    judged = [r for r in rows if not r["base_failed"]]
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in judged]) > 0.95


def test_quality_without_labels_and_of_nothing(make, llm):
    none = llm.createDataFrame([(7, None)], "doc_id long, quality int")
    rows = quality.quality_rules(make(), none).collect()
    assert len(rows) == len(ODD) and all(r["kept"] == (not r["base_failed"]) for r in rows)
    assert quality.quality_rules(make([]), none).count() == 0


def test_trees_keep_their_sides():
    rng = np.random.default_rng(5)
    x = rng.random((3000, 3))
    y = (np.sin(6 * x[:, 0]) + x[:, 1] + rng.normal(0, 0.3, 3000) > 1).astype(float)
    trees = quality.fit_trees(x, y, np.array([1, -1, 0]), trees=30)
    grid = np.linspace(0, 1, 50)
    for other in rng.random((20, 3)):
        for f, side in ((0, 1), (1, -1)):
            line = np.repeat(other[None], 50, axis=0)
            line[:, f] = grid
            assert (side * np.diff(trees.raw(line)) >= -1e-9).all()
    free = quality.fit_trees(x, y, np.zeros(3, int), trees=60)
    assert np.mean((free.probability(x) > 0.5) == y) > 0.8


# -- toxicity


def test_toxic_documents_that_were_not_trained_on(llm):
    docs, labels = (llm.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.train(docs, labels.where("doc_id % 4 <> 0"))
    rows = toxicity.score(docs, chain).join(labels.where("doc_id % 4 = 0"), "doc_id").collect()
    assert np.mean([r["is_toxic"] for r in rows if r["toxic"] == 1]) > 0.75
    assert np.mean([r["is_toxic"] for r in rows if r["toxic"] == 0]) < 0.01


def toxic_rows(n, seed):
    rng = random.Random(seed)
    plain = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randrange(20, 200))
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["Vilex,", "grotz.", "blargish", "blargen", "blargous"]))
        rows.append((i, " ".join(words), "en", "a"))
        labels.append((i, rng.randrange(2), int(toxic)))
    return rows, labels


def test_chain_finds_toxic_texts(make, llm):
    rows, labels = toxic_rows(900, 1)
    table = llm.createDataFrame(labels[:600] + [(None, 1, 1), (3, None, 1), (4, 0, None)], "doc_id long, quality int, toxic int")
    docs = make(rows)
    chain = toxicity.train(docs, table, about=250)
    found = {r["doc_id"]: r for r in toxicity.score(docs, chain).collect()}
    toxic = {i for i, _, t in labels if t}
    called = {i for i, r in found.items() if r["is_toxic"]}
    assert len(called & toxic) > 0.97 * len(toxic) and len(called - toxic) < 0.02 * len(rows)
    assert all(0 <= r[f"p_{c}"] <= 1 for r in found.values() for c in toxicity.CATEGORIES)
    clean = toxicity.keep_clean(docs, chain)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.select("doc_id").collect()} == set(found) - called


def test_later_categories_see_out_of_fold_probabilities():
    rng = np.random.default_rng(2)
    x = rng.random((300, 40)).astype(np.float32)
    noise = rng.integers(0, 2, (300, 2)).astype(float)
    weights, held = toxicity.fit_chain(x, noise, np.arange(300) % 3, 0.01)
    assert [len(w) for w in weights] == [41, 42]
    # Labels of noise: honest probabilities cannot tell them.
    assert abs(np.corrcoef(held[:, 0], noise[:, 0])[0, 1]) < 0.25


def test_toxicity_without_labels_and_of_odd_rows(make, llm):
    none = llm.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = toxicity.train(make(), none)
    rows = toxicity.score(make(), chain).collect()
    assert len(rows) == len(ODD) and not any(r["is_toxic"] for r in rows)
    one = llm.createDataFrame([(7, 1, 0), (8, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    assert not any(r["is_toxic"] for r in toxicity.score(make(), toxicity.train(make(), one)).collect())
    assert toxicity.score(make([]), chain).count() == 0
    assert toxicity.keep_clean(make(), chain).count() == len(ODD)


def test_registered_queries_cover_all_rows(llm):
    n = llm.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op4_toxicity", "op6_quality_rules"):
        rows = callables()[name](llm, SF)
        assert rows.count() == n and rows.where(F.col("doc_id").isNull()).count() == 0
