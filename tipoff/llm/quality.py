"""Quality rules: boosted trees over document statistics, behind fixed base rules."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipoff.llm.common import hash_sample, query, settle, table
from tipoff.llm.textbytes import SPACE, SpanHash, Words, mix64, raw, slices, windows

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
DIGIT = np.array([48 <= b < 58 for b in range(256)])
UPPER = np.array([65 <= b < 91 for b in range(256)])
POINT = np.array([b & 0xC0 != 0x80 for b in range(256)])

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
OTHERS = ["n_lines", "n_distinct_words", "n_letters", "n_digits", "n_upper", "n_plain_words"]
#: Features of the trees, and the side that each may push the verdict to: -1 only down, 0 any.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbol_rate": -1,
    "dup_line_rate": -1,
    "repeat_rate": -1,
    "distinct_rate": 0,
    "letter_rate": 0,
    "digit_rate": 0,
    "upper_rate": 0,
    "words_per_line": 0,
    "plain_word_rate": 0,
}


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _by_owner(owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return mix64(keys + mix64(owner.astype(np.uint64)))


def statistics(data: np.ndarray, offsets: np.ndarray, hasher: SpanHash) -> dict[str, np.ndarray]:
    """The counts of COUNTS and OTHERS for some texts."""
    n = len(offsets) - 1
    words = Words(data, offsets)
    hasher.load(data)
    owner = words.owner()
    hashes = hasher.spans(words.starts, words.ends)
    out = {"n_words": words.counts.astype(np.int64)}
    black = ~SPACE[data]
    out["word_chars"] = _sums(black & POINT[data], offsets)
    out["n_symbols"] = _sums(SYMBOLS[data], offsets)

    # Lines: from a text's start or a line feed to the next line feed or the text's end.
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]))
    ends = np.sort(np.concatenate([feeds, offsets[1:]]))
    line_owner = np.repeat(np.arange(n), _sums(data == 10, offsets) + 1)
    inked = np.concatenate([[0], np.cumsum(black, dtype=np.int64)])
    worded = inked[ends] > inked[starts]
    keys = _by_owner(line_owner[worded], hasher.spans(starts[worded], ends[worded]))
    first = np.zeros(len(keys), bool)
    first[np.unique(keys, return_index=True)[1]] = True
    lines = np.bincount(line_owner[worded], minlength=n)
    out["n_dup_lines"] = lines - np.bincount(line_owner[worded][first], minlength=n)
    out["n_lines"] = lines

    # Words in windows of three that come twice or more in their text.
    threes, begin = windows(hashes, owner, 3)
    _, number, count = np.unique(_by_owner(owner[begin], threes), return_inverse=True, return_counts=True)
    again = begin[count[number] > 1] if len(begin) else begin
    covered = np.zeros(len(hashes), bool)
    for k in range(3):
        covered[again + k] = True
    out["n_repeat_words"] = np.bincount(owner[covered], minlength=n)
    out["n_distinct_words"] = np.bincount(owner[np.unique(_by_owner(owner, hashes), return_index=True)[1]], minlength=n)

    out["n_letters"] = _sums(black & LETTER[data] & POINT[data], offsets)
    out["n_digits"] = _sums(DIGIT[data], offsets)
    out["n_upper"] = _sums(UPPER[data], offsets)
    letters = np.concatenate([[0], np.cumsum(LETTER[data], dtype=np.int64)])
    plain = letters[words.ends] - letters[words.starts] >= words.ends - words.starts - 1
    out["n_plain_words"] = np.bincount(owner[plain], minlength=n)
    return {k: v.astype(np.int64) for k, v in out.items()}


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = SpanHash(6)
    for batch in batches:
        for piece in slices(batch, "text"):
            found = statistics(*raw(piece.column("text")), hasher)
            rest = piece.drop_columns(["text"])
            arrays = [*rest.columns, *(pa.array(found[c]) for c in COUNTS + OTHERS)]
            yield pa.RecordBatch.from_arrays(arrays, [*rest.schema.names, *COUNTS, *OTHERS])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and all counts of each whole text; a null text counts as empty."""
    picked = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return picked.mapInArrow(_measure, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS + OTHERS))


def feature_matrix(counts: dict[str, np.ndarray]) -> np.ndarray:
    c = {k: np.asarray(v, np.float64) for k, v in counts.items()}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.stack(
        [
            np.log1p(c["n_words"]),
            c["word_chars"] / words,
            c["n_symbols"] / words,
            c["n_dup_lines"] / lines,
            c["n_repeat_words"] / words,
            c["n_distinct_words"] / words,
            c["n_letters"] / chars,
            c["n_digits"] / chars,
            c["n_upper"] / chars,
            c["n_words"] / lines,
            c["n_plain_words"] / words,
        ],
        axis=1,
    )


@dataclass(frozen=True)
class Trees:
    """Boosted trees as flat node arrays, tree after tree. A leaf points to itself.

    A row goes left where its feature is at most the node's cut.
    """

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                low = x[rows, self.feature[at]] <= self.cut[at]
                at = np.where(low, self.left[at], self.right[at])
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


class _Grower:
    """Grows one tree on binned features, with monotone sides kept by bounds on the leaves."""

    def __init__(self, bins: np.ndarray, edges: list[np.ndarray], sides: np.ndarray, depth: int, least: float, penalty: float, rate: float):
        self.bins, self.edges, self.sides = bins, edges, sides
        self.depth, self.least, self.penalty, self.rate = depth, least, penalty, rate
        self.width = max((len(e) for e in edges), default=0) + 1

    def best_split(self, rows, gradient, hessian, low, high):
        n = self.bins.shape[1]
        slot = (self.bins[rows] + np.arange(n) * self.width).ravel()
        g = np.bincount(slot, np.repeat(gradient[rows], n), n * self.width).reshape(n, -1).cumsum(axis=1)
        h = np.bincount(slot, np.repeat(hessian[rows], n), n * self.width).reshape(n, -1).cumsum(axis=1)
        gt, ht = gradient[rows].sum(), hessian[rows].sum()
        lv = np.clip(g / (h + self.penalty), low, high)
        rv = np.clip((gt - g) / (ht - h + self.penalty), low, high)

        def gain(v, g, h):
            return 2 * g * v - (h + self.penalty) * v * v

        whole = np.clip(gt / (ht + self.penalty), low, high)
        score = gain(lv, g, h) + gain(rv, gt - g, ht - h) - gain(whole, gt, ht)
        side = self.sides[:, None]
        bad = (h < self.least) | (ht - h < self.least) | (side * (rv - lv) < 0)
        score[bad] = -np.inf
        f, b = np.unravel_index(np.argmax(score), score.shape)
        return (int(f), int(b), lv[f, b], rv[f, b]) if score[f, b] > 1e-6 else None

    def grow(self, gradient, hessian, nodes: list[list]) -> tuple[int, np.ndarray]:
        out = np.zeros(len(gradient))

        def add(rows, level, low, high) -> int:
            spot = len(nodes)
            value = np.clip(gradient[rows].sum() / (hessian[rows].sum() + self.penalty), low, high) * self.rate
            nodes.append([0, np.inf, spot, spot, value])
            found = self.best_split(rows, gradient, hessian, low, high) if level < self.depth else None
            if found is None:
                out[rows] = value
                return spot
            f, b, lv, rv = found
            goes = self.bins[rows, f] <= b
            middle, side = (lv + rv) / 2, self.sides[f]
            left_bounds = (low, middle) if side > 0 else (middle, high) if side < 0 else (low, high)
            right_bounds = (middle, high) if side > 0 else (low, middle) if side < 0 else (low, high)
            nodes[spot][:2] = [f, self.edges[f][b]]
            nodes[spot][2] = add(rows[goes], level + 1, *left_bounds)
            nodes[spot][3] = add(rows[~goes], level + 1, *right_bounds)
            return spot

        return add(np.arange(len(gradient)), 0, -np.inf, np.inf), out


def fit_trees(
    x: np.ndarray, y: np.ndarray, sides: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.15,
    bins: int = 64, least: float = 1.0, penalty: float = 1.0,
) -> Trees:
    """Boost logistic loss. With one class only there are no trees, just its rate."""
    mean = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    roots, nodes = [], []
    if 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        grower = _Grower(binned, [np.append(e, np.inf) for e in edges], sides, depth, least, penalty, rate)
        score = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            root, step = grower.grow(y - p, np.maximum(p * (1 - p), 1e-9), nodes)
            roots.append(root)
            score = score + step
    flat = list(zip(*nodes, strict=True)) if nodes else [[0], [np.inf], [0], [0], [0.0]]
    kinds = (np.int64, np.float64, np.int64, np.int64, np.float64)
    return Trees(np.array(roots, np.int64), *(np.array(c, k) for c, k in zip(flat, kinds, strict=True)), depth, base)


def failed_base() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def train(measured: DataFrame, labels: DataFrame, *, about: int = 20_000, **settings) -> Trees:
    """Fit to a bounded sample, about ``about`` labelled documents that pass the base rules.

    Null labels are left out; an id labelled twice counts as its better label.
    """
    good = labels.dropna(subset=["doc_id", "quality"]).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    taken = hash_sample(good, "doc_id", about)
    # Bounded by ``about`` rows of two numbers.
    rows = measured.where(~failed_base()).join(F.broadcast(taken), "doc_id").orderBy("doc_id", *COUNTS).toPandas()
    x = feature_matrix({c: rows[c].to_numpy() for c in COUNTS + OTHERS})
    return fit_trees(x, rows["quality"].to_numpy(np.float64), np.array(list(FEATURES.values())), **settings)


def judge(measured: DataFrame, trees: Trees, threshold: float = 0.5) -> DataFrame:
    """doc_id, the five counts, base_failed, kept, quality: the base rules, then the trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = feature_matrix({c: batch.column(c).to_numpy() for c in COUNTS + OTHERS})
            arrays = [*batch.select(["doc_id", *COUNTS]).columns, pa.array(trees.probability(x))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *COUNTS, "quality"])

    scored = measured.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", quality double")
    return scored.withColumn("base_failed", failed_base()).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= threshold)
    )


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **settings) -> DataFrame:
    """One row per document. Texts are read once; what follows works on the counts.

    A null text has no words and fails the base rules, and so does an empty one. Without labels the
    base rules alone decide. Repeated rows are judged alike, and other columns are ignored.
    """
    measured = settle(measure(docs), "quality-counts")
    return judge(measured, train(measured, labels, **settings), threshold)


@query("op6_quality_rules")
def op6(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
