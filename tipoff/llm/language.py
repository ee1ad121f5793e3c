"""Language identification by a byte convolutional network."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.common import crc_mod, query, table, whole
from tipoff.llm.textbytes import raw, slices

WIDTHS = (2, 3, 4)
FILTERS = 12
WINDOW = 128
OVERLAP = max(WIDTHS) - 1
UNKNOWN = "und"


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of some texts as rows of WINDOW + OVERLAP bytes, and the text of each row.

    Rows of a text start every WINDOW bytes and reach into the next one, so each gram is in one
    row. The last row is filled up with byte 0.
    """
    size = np.diff(offsets)
    times = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), times)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
    start, end = offsets[:-1][owner] + number * WINDOW, offsets[1:][owner]
    place = start[:, None] + np.arange(WINDOW + OVERLAP)
    rows = np.append(data, np.uint8(0))[np.minimum(place, len(data))]
    rows[place >= end[:, None]] = 0
    return rows, owner


@dataclass
class Network:
    """Filters of several widths over one-hot bytes, rectified, max pooled, then a softmax.

    ``filters[w][j]`` is the part of the filters of width w that looks at byte j of a gram: a row of
    FILTERS weights for each byte value.
    """

    languages: tuple[str, ...]
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, languages: tuple[str, ...], seed: int) -> Network:
        rng = np.random.default_rng(seed)
        filters = {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        for w in WIDTHS:
            filters[w][:, 0] = 0
        out = rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        return cls(languages, filters, {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, out, np.zeros(len(languages), np.float32))

    def responses(self, rows: np.ndarray, w: int) -> np.ndarray:
        total = self.filters[w][0][rows[:, :WINDOW]]
        for j in range(1, w):
            total += self.filters[w][j][rows[:, j : j + WINDOW]]
        return total

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        tops, where = [], []
        for w in WIDTHS:
            r = self.responses(rows, w)
            at = r.argmax(axis=1)
            where.append(at)
            tops.append(np.take_along_axis(r, at[:, None], axis=1)[:, 0] + self.bias[w])
        return np.maximum(np.concatenate(tops, axis=1), 0), where

    @staticmethod
    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        """Language probabilities of each row. Pairs of bytes are looked up at once, so a gram of
        four takes two lookups."""
        pair = rows[:, :-1].astype(np.int32) * 256 + rows[:, 1:]
        tops = []
        for w, tables in self._pairs().items():
            total = tables[0][pair[:, :WINDOW]]
            if len(tables) > 1:
                second = pair if w == 4 else rows
                total += tables[1][second[:, 2 : 2 + WINDOW]]
            tops.append(total.max(axis=1) + self.bias[w])
        hidden = np.maximum(np.concatenate(tops, axis=1), 0)
        return self.softmax(hidden @ self.out + self.out_bias)

    def _pairs(self) -> dict[int, list[np.ndarray]]:
        if not hasattr(self, "_tables"):
            f = self.filters

            def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                return (a[:, None] + b[None]).reshape(1 << 16, FILTERS)

            self._tables = {
                2: [both(f[2][0], f[2][1])],
                3: [both(f[3][0], f[3][1]), f[3][2]],
                4: [both(f[4][0], f[4][1]), both(f[4][2], f[4][3])],
            }
        return self._tables


def fit(rows: np.ndarray, y: np.ndarray, languages: tuple[str, ...], *, epochs: int, batch: int, rate: float, seed: int) -> Network:
    """Adam on cross entropy. Only the pooled places of a filter get a gradient."""
    net = Network.fresh(languages, seed)
    rng = np.random.default_rng(seed)
    params = [*(net.filters[w] for w in WIDTHS), *(net.bias[w] for w in WIDTHS), net.out, net.out_bias]
    mean, square, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    lanes = np.arange(FILTERS)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            x = rows[pick]
            hidden, where = net.pooled(x)
            error = net.softmax(hidden @ net.out + net.out_bias)
            error[np.arange(len(pick)), y[pick]] -= 1
            error /= len(pick)
            back = (error @ net.out.T) * (hidden > 0)
            grads = []
            for i, w in enumerate(WIDTHS):
                part, at = back[:, i * FILTERS : (i + 1) * FILTERS], where[i]
                g = np.zeros_like(net.filters[w])
                for j in range(w):
                    seen = np.take_along_axis(x, at + j, axis=1)
                    np.add.at(g[j], (seen, np.broadcast_to(lanes, seen.shape)), part)
                g[:, 0] = 0
                grads.append(g)
            grads += [back[:, i * FILTERS : (i + 1) * FILTERS].sum(axis=0) for i in range(len(WIDTHS))]
            grads += [hidden.T @ error, error.sum(axis=0)]
            step += 1
            for p, g, m, s in zip(params, grads, mean, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def sample_windows(train: DataFrame, per_language: int, seed: int) -> DataFrame:
    """(lang, piece): about ``per_language`` pieces of WINDOW characters from each language's texts.

    A third of them come from the start of as many documents, the others from places that the hash
    of the id picks. One count for each language comes to the driver, then these pieces; the network
    has an output for each language, so there are few. Texts are not shuffled.
    """
    counts = train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    spot = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 40))
    reach = F.lit(0)
    for row in counts:
        share = min(1.0, per_language / 3 / row["n"])
        reach = F.when(F.col("lang") == row["lang"], F.lit(int(share * (1 << 40)))).otherwise(reach)
    chosen = train.where(spot < reach)
    last = F.greatest(F.length("text") - WINDOW + 1, F.lit(1))
    places = [F.lit(1)] + [F.pmod(F.xxhash64(F.lit(seed + k), F.col("doc_id")), last.cast("long")).cast("int") + 1 for k in (1, 2)]
    pieces = chosen.select("lang", F.explode(F.array(*[F.substr(F.col("text"), p.cast("int"), F.lit(WINDOW)) for p in places])).alias("piece"))
    return pieces.where(F.col("piece").rlike(r"\p{L}"))


def train_network(
    train: DataFrame, *, per_language: int = 1500, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 4
) -> Network | None:
    """Fit to (doc_id, text, lang). None without a labelled text.

    The sample is bounded by ``per_language`` pieces of WINDOW characters for each language.
    """
    got = sample_windows(train, per_language, seed).orderBy("lang", "piece").collect()
    languages = tuple(sorted({r["lang"] for r in got}))
    if not languages:
        return None
    data, offsets = raw(pa.array([r["piece"] for r in got], pa.string()))
    rows, owner = cut_windows(data, offsets)
    first = np.unique(owner, return_index=True)[1]
    y = np.array([languages.index(r["lang"]) for r in got])
    return fit(rows[first], y, languages, epochs=epochs, batch=batch, rate=rate, seed=seed)


def _predictor(net: Network | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 1 << 18):
                n = piece.num_rows
                known = piece.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
                best, score = [UNKNOWN] * n, np.zeros(n)
                if net is not None and known.any():
                    rows, owner = cut_windows(*raw(piece.column("text")))
                    weight = (rows[:, :WINDOW] > 64).sum(axis=1) + 1e-3
                    total = np.zeros((n, len(net.languages)))
                    for a in range(0, len(rows), 1024):
                        p = net.probabilities(rows[a : a + 1024])
                        np.add.at(total, owner[a : a + 1024], p * weight[a : a + 1024, None])
                    size = np.maximum(total.sum(axis=1), 1e-9)
                    at = total.argmax(axis=1)
                    score = np.where(known, np.clip(total[np.arange(n), at] / size, 0, 1), 0.0)
                    best = [net.languages[i] if k else UNKNOWN for i, k in zip(at, known, strict=True)]
                rest = piece.drop_columns(["text", "lettered"])
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(best, pa.string()), pa.array(score)], [*rest.schema.names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred and score of every document, from its whole text alone.

    All windows of a text are scored; their probabilities are averaged by the number of their
    letters and signs above "@". A text that is null or has no letter is ``und`` with score 0, and
    so is every text if there was nothing to learn from. One pass without a shuffle.
    """
    text = whole("text")
    picked = docs.select("doc_id", text.rlike(r"\p{L}").alias("lettered"), text.alias("text"))
    return picked.mapInArrow(_predictor(net), f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def held_out(docs: DataFrame, n: int = 4, fold: int = 2):
    return crc_mod("doc_id", n) == fold


@query("op3_language_id")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labelled = docs.where(~held_out(docs) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    net = train_network(labelled.select("doc_id", "text", "lang"))
    found = predict(docs, net)
    return found.select("doc_id", held_out(found).alias("held_out"), "lang_pred", "score")
