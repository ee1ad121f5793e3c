"""Toxicity by a chain of linear classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipoff.llm.common import hash_sample, query, settle, table, whole
from tipoff.llm.textbytes import SpanHash, Words, raw, slices

#: Categories in the order of the chain. The last one decides.
CATEGORIES: dict[str, Callable[[], Column]] = {
    "toxic_prose": lambda: (F.col("toxic") == 1) & (F.col("quality") == 1),
    "toxic_junk": lambda: (F.col("toxic") == 1) & (F.col("quality") == 0),
    "toxic": lambda: F.col("toxic") == 1,
}
PREFIXES = (4, 5, 6, 7)
#: Bytes between words: ASCII other than letters and digits.
BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def features(data: np.ndarray, offsets: np.ndarray, hasher: SpanHash) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts and of the beginnings of longer ones, with their texts."""
    words = Words(data, offsets, BETWEEN)
    hasher.load(data)
    owner, size = words.owner(), words.ends - words.starts
    keys, owners = [hasher.spans(words.starts, words.ends)], [owner]
    for n in PREFIXES:
        longer = size > n
        starts = words.starts[longer]
        keys.append(hasher.spans(starts, starts + n))
        owners.append(owner[longer])
    return np.concatenate(keys), np.concatenate(owners)


def _distinct(keys: np.ndarray, owners: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature number, owner) once each, and the features."""
    known, number = np.unique(keys, return_inverse=True)
    pairs = np.unique(number.astype(np.int64) * n + owners)
    return np.stack([pairs // n, pairs % n]), known


def _count_features(categories: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash(3, lower=True)
        for batch in batches:
            for piece in slices(batch, "text"):
                keys, owners = features(*raw(piece.column("text")), hasher)
                if not len(keys):
                    continue
                (number, owner), known = _distinct(keys, owners, piece.num_rows)
                counts = [np.bincount(number, minlength=len(known))]
                for c in categories:
                    hit = piece.column(c).to_numpy(zero_copy_only=False).astype(float)
                    counts.append(np.bincount(number, weights=hit[owner], minlength=len(known)).astype(np.int64))
                arrays = [pa.array(known.view(np.int64)), *(pa.array(c) for c in counts)]
                yield pa.RecordBatch.from_arrays(arrays, ["feature", "n", *categories])

    return run


def select_features(sample: DataFrame, categories: list[str], most: int, least_docs: int) -> np.ndarray:
    """The features that tell most of the categories apart, by the largest G-square of each.

    Counts cover the whole sample; only ``most`` features per category come to the driver.
    """
    ints = ", ".join(f"{c} long" for c in categories)
    counts = sample.mapInArrow(_count_features(categories), f"feature long, n long, {ints}")
    counts = settle(counts.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ["n", *categories]]), "features")
    totals = sample.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("long")).alias(c) for c in categories]).first()
    chosen: set[int] = set()
    for c in categories:
        rate = F.lit((totals[c] or 0) / max(1, totals["n"]))
        hit, n = F.col(c).cast("double"), F.col("n").cast("double")

        def part(seen, expected):
            return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

        score = part(hit, n * rate) + part(n - hit, n * (1 - rate))
        best = counts.where(F.col("n") >= least_docs).orderBy(F.desc_nulls_last(score), "feature").limit(most)
        chosen.update(r[0] for r in best.select("feature").collect())
    return np.sort(np.array(sorted(chosen), np.int64).view(np.uint64))


def present(piece: pa.RecordBatch, known: np.ndarray, hasher: SpanHash) -> tuple[np.ndarray, np.ndarray]:
    """A 0/1 matrix of the known features in each text, and whether a text has a word at all."""
    keys, owners = features(*raw(piece.column("text")), hasher)
    out = np.zeros((piece.num_rows, len(known)), np.float32)
    worded = np.bincount(owners, minlength=piece.num_rows) > 0
    if len(known) and len(keys):
        # Most words are none of the features; sixteen bits of the hash tell so.
        maybe = np.zeros(1 << 16, bool)
        maybe[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
        likely = maybe[(keys & np.uint64(0xFFFF)).astype(np.int64)]
        keys, owners = keys[likely], owners[likely]
        spot = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[spot] == keys
        out[owners[hit], spot[hit]] = 1
    return out, worded


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 8) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the intercept, which is not penalised."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weights = np.zeros(x.shape[1])
    rate = np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6)
    weights[-1] = np.log(rate / (1 - rate))
    if not 0 < y.sum() < len(y):
        return weights
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ weights)
        spread = np.maximum(p * (1 - p), 1e-6).astype(x.dtype)
        hessian = (x.T * spread) @ x + np.diag(ridge)
        gradient = x.T @ (y - p) - ridge * weights
        step = np.linalg.solve(hessian.astype(np.float64), gradient)
        weights = weights + step
        if np.abs(step).max() < 1e-4:
            break
    return weights


@dataclass(frozen=True)
class Chain:
    """A fitted chain: each category's weights for the features, the earlier categories, and 1."""

    categories: tuple[str, ...]
    known: np.ndarray
    weights: tuple[np.ndarray, ...]
    threshold: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 0))
        for w in self.weights:
            inputs = np.hstack([x, out, np.ones((len(x), 1))])
            out = np.hstack([out, sigmoid(inputs @ w)[:, None]])
        return out


def fit_chain(x: np.ndarray, labels: np.ndarray, fold: np.ndarray, penalty: float) -> tuple[list[np.ndarray], np.ndarray]:
    """Weights of the chain, and every row's probabilities by models that have not seen the row.

    A later category is trained on out-of-fold probabilities of the earlier ones, which are as
    uncertain as those it meets on new documents; fitted ones would be too sure.
    """
    out = np.zeros(labels.shape)
    weights = []
    for k in range(labels.shape[1]):
        inputs, y = np.hstack([x, out[:, :k].astype(x.dtype)]), labels[:, k]
        for f in np.unique(fold):
            rest = fold != f
            w = fit_linear(inputs[rest], y[rest], penalty)
            out[~rest, k] = sigmoid(np.hstack([inputs[~rest], np.ones((int((~rest).sum()), 1))]) @ w)
        weights.append(fit_linear(inputs, y, penalty))
    return weights, out


def best_threshold(p: np.ndarray, y: np.ndarray, stands_for: np.ndarray) -> float:
    """The cut from 0.5 up with the best F1 on out-of-fold probabilities, the lowest of equal ones.

    Lower cuts are not tried: a document that is more likely clean than toxic stays.
    ``stands_for``: how many labelled documents each sampled one stands for.
    """
    cuts, n = np.linspace(0.5, 0.95, 46), stands_for
    hits = [(p >= c) * n for c in cuts]
    return float(cuts[int(np.argmax([2 * (h * y).sum() / max(1, h.sum() + (n * y).sum()) for h in hits]))])


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    about: int = 6_000,
    per_category: int = 300,
    least_docs: int = 4,
    folds: int = 3,
    penalty: float = 0.1,
) -> Chain:
    """Fit on a bounded sample: about ``about`` toxic and as many other labelled documents, whole texts.

    ``labels`` has doc_id, quality, toxic; rows with a null are left out, an id labelled twice counts
    as toxic if either says so. Texts of two labels count once. At most len(CATEGORIES) *
    ``per_category`` features come to the driver, and one bit of each for every sampled document.
    """
    names = list(CATEGORIES)
    clean = labels.dropna(subset=["doc_id", "quality", "toxic"]).groupBy("doc_id")
    clean = clean.agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    toxic, other = clean.where("toxic = 1"), clean.where("toxic <> 1")
    taken = hash_sample(toxic, "doc_id", about).unionByName(hash_sample(other, "doc_id", about))
    taken = taken.select("doc_id", *[CATEGORIES[c]().cast("int").alias(c) for c in names])
    texts = docs.select("doc_id", whole("text").alias("text"))
    # The sample is bounded by 2 * ``about`` rows of a few numbers, so it goes to every task.
    sample = texts.join(F.broadcast(taken), "doc_id")
    sample = sample.groupBy(F.sha2("text", 256)).agg(
        F.min("doc_id").alias("doc_id"), F.first("text").alias("text"), *[F.max(c).alias(c) for c in names]
    )
    sample = settle(sample.select("doc_id", "text", *names), "toxic-sample")
    known = select_features(sample, names, per_category, least_docs)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash(3, lower=True)
        for batch in batches:
            for piece in slices(batch, "text"):
                x, _ = present(piece, known, hasher)
                bits = pa.array([np.packbits(r.astype(bool)).tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(piece.column(c) for c in names), bits], ["doc_id", *names, "bits"])

    kind = dict(sample.dtypes)["doc_id"]
    schema = f"doc_id {kind}, " + ", ".join(f"{c} int" for c in names) + ", bits binary"
    got = sample.mapInArrow(rows, schema).withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(folds))).orderBy("doc_id").toPandas()
    x = np.zeros((len(got), len(known)), np.float32)
    for i, b in enumerate(got["bits"]):
        x[i] = np.unpackbits(np.frombuffer(b, np.uint8), count=len(known))
    y = got[names].to_numpy(np.float64).reshape(len(got), len(names))
    weights, held = fit_chain(x, y, got["fold"].to_numpy(), penalty)
    sampled = max(1, int((y[:, -1] == 0).sum()))
    stands_for = np.where(y[:, -1] > 0, 1.0, max(1.0, other.count() / sampled))
    return Chain(tuple(names), known, tuple(weights), best_threshold(held[:, -1], y[:, -1], stands_for))


def _scorer(chain: Chain) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash(3, lower=True)
        for batch in batches:
            for piece in slices(batch, "text"):
                x, worded = present(piece, chain.known, hasher)
                p = chain.probabilities(x) * worded[:, None]
                rest = piece.drop_columns(["text"])
                verdict = worded & (p[:, -1] >= chain.threshold)
                arrays = [*rest.columns, pa.array(verdict), *(pa.array(p[:, k]) for k in range(p.shape[1]))]
                yield pa.RecordBatch.from_arrays(arrays, [*rest.schema.names, "is_toxic", *(f"p_{c}" for c in chain.categories)])

    return run


def score(docs: DataFrame, chain: Chain, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every document, is_toxic, and the probability of each category.

    Whole texts are read. A text that is null or has no word is not toxic, with probabilities 0.
    One pass without a shuffle.
    """
    picked = docs.select(*[docs[f"`{c}`"] for c in keep if c != "text"], whole(docs["text"]).alias("text"))
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep if c != "text"] + ["is_toxic boolean"] + [f"p_{c} double" for c in chain.categories])
    return picked.mapInArrow(_scorer(chain), schema)


def _filter(chain: Chain) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash(3, lower=True)
        for batch in batches:
            for piece in slices(batch, "text"):
                x, worded = present(piece, chain.known, hasher)
                toxic = worded & (chain.probabilities(x)[:, -1] >= chain.threshold)
                yield piece.filter(pa.array(~toxic))

    return run


def keep_clean(docs: DataFrame, chain: Chain) -> DataFrame:
    """The documents that the chain does not call toxic, all columns, in one pass without a shuffle."""
    return docs.mapInArrow(_filter(chain), docs.schema)


@query("op4_toxicity")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
