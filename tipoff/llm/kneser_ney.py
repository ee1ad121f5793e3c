"""Language-model scores: an interpolated modified Kneser-Ney bigram model in mapped files."""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.common import crc_mod, power_of_two, query, settle, table, whole
from tipoff.llm.textbytes import SpanHash, Words, mix64, raw, slices
from tipoff.session import shared_dir

#: Tokens that no text holds: before a text, and behind it.
BEGIN, END = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
SALTS = 16
RUN = "shard int, kind int, keys binary, counts binary"
FLUSH = 4_000_000


# -- files in the shared folder ---------------------------------------------------------------


def put(uri: str, data: np.ndarray) -> None:
    """Write an array as it is in memory. A second attempt of the same task writes the same bytes."""
    fs, path = pafs.FileSystem.from_uri(uri)
    draft = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as out:
        out.write(np.ascontiguousarray(data).tobytes())
    fs.move(draft, path)


def mapped(uri: str, dtype) -> np.ndarray:
    """The array of a file, memory-mapped. A file in a store without local paths is copied to an
    unnamed local file first, which is gone when the worker lets go of it."""
    fs, path = pafs.FileSystem.from_uri(uri)
    size = fs.get_file_info(path).size
    if not size:
        return np.zeros(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        with open(path, "rb") as f:
            view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        with tempfile.TemporaryFile() as f, fs.open_input_stream(path) as source:
            while block := source.read(1 << 22):
                f.write(block)
            f.flush()
            view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    return np.frombuffer(view, dtype)


def make_folder(uri: str) -> str:
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri else os.path.abspath(uri))
    fs.create_dir(path, recursive=True)
    return uri


# -- tokens ------------------------------------------------------------------------------------


def tokens(data: np.ndarray, offsets: np.ndarray, hasher: SpanHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of some texts, of the token before each, and the texts they are of.

    Tokens are words, A-Z lower-cased, then one end for each text.
    """
    words = Words(data, offsets)
    n = len(offsets) - 1
    owner = words.owner()
    out = np.empty(len(words) + n, np.uint64)
    out[np.arange(len(words)) + owner] = hasher.load(data).spans(words.starts, words.ends)
    out[words.range[1:] + np.arange(n)] = END
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[words.range[:-1] + np.arange(n)] = BEGIN
    return out, before, np.repeat(np.arange(n), words.counts + 1)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def runs(shard: np.ndarray, kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One row for each shard: its sorted keys and their counts. ``keys`` come sorted."""
    order = np.argsort(shard, kind="stable")
    shard, keys, counts = shard[order], keys[order], counts[order]
    cut = np.flatnonzero(np.concatenate([[len(shard) > 0], shard[1:] != shard[:-1]]))
    pairs = list(zip(cut.tolist(), [*cut[1:].tolist(), len(shard)], strict=False))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(shard[cut].astype(np.int32)),
            pa.array(np.full(len(cut), kind, np.int32)),
            pa.array([keys[a:b].tobytes() for a, b in pairs], pa.binary()),
            pa.array([counts[a:b].astype(np.uint32).tobytes() for a, b in pairs], pa.binary()),
        ],
        ["shard", "kind", "keys", "counts"],
    )


class Heap:
    """Keys with counts that a task has seen, made distinct when they become many."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> bool:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts.astype(np.int64))
        self.size += len(keys)
        return self.size >= FLUSH

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = summed(np.concatenate([np.zeros(0, np.uint64), *self.keys]), np.concatenate([np.zeros(0, np.int64), *self.counts]))
        self.__init__()
        return out


def merged_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, tuple[np.ndarray, np.ndarray]]]]:
    """(shard, {kind: (keys, counts)}) of rows that come sorted by shard."""
    shard, parts = None, {}

    def done():
        return shard, {k: summed(np.concatenate([a for a, _ in v]), np.concatenate([b for _, b in v])) for k, v in parts.items()}

    for batch in batches:
        for s, kind, keys, counts in zip(*(batch.column(c) for c in ("shard", "kind", "keys", "counts")), strict=True):
            if s.as_py() != shard:
                if parts:
                    yield done()
                shard, parts = s.as_py(), {}
            pair = np.frombuffer(keys.as_py(), np.uint64), np.frombuffer(counts.as_py(), np.uint32).astype(np.int64)
            parts.setdefault(kind.as_py(), []).append(pair)
    if parts:
        yield done()


def dealt(df: DataFrame) -> DataFrame:
    return df.repartition("shard").sortWithinPartitions("shard")


# -- the model ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """Where the model's files are and how keys are dealt to them.

    Words are dealt by the first ``bits`` of their hash; a word's number is its place among all
    words in hash order. Pairs are dealt by their first word, and by both words if the first is more
    frequent than ``hot``, so that no file holds all that follows a very frequent word.
    """

    folder: str
    bits: int
    pair_shards: int
    base: tuple[int, ...] = ()
    hot: int = 0

    def word_shard(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_shard(self, first: np.ndarray, second: np.ndarray, first_count: np.ndarray) -> np.ndarray:
        salt = np.where(first_count > self.hot, mix64(second) % np.uint64(SALTS) + np.uint64(1), np.uint64(0))
        return (mix64(first * np.uint64(SALTS + 1) + salt) % np.uint64(self.pair_shards)).astype(np.int64)

    def file(self, name: str, shard: int) -> str:
        return f"{self.folder}/{name}-{shard:06d}"


class Store:
    """Reads a model's files in a worker, each mapped when it is first needed."""

    KINDS = {"words": np.uint64, "counts": np.uint32, "pairs": np.uint64, "pair_counts": np.uint32, "before": np.uint32, "after": np.uint32}

    def __init__(self, layout: Layout):
        self.layout, self.open = layout, {}

    def array(self, name: str, shard: int) -> np.ndarray:
        key = name, shard
        if key not in self.open:
            self.open[key] = mapped(self.layout.file(name, shard), self.KINDS[name])
        return self.open[key]

    def _find(self, keys, shard, name, value) -> tuple[np.ndarray, np.ndarray]:
        """Place in the shard of each distinct sorted key, -1 if it is not there, and its value."""
        place, found = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        order = np.argsort(shard, kind="stable")
        cut = np.flatnonzero(np.diff(shard[order])) + 1
        for part in np.split(order, cut) if len(order) else []:
            s = int(shard[part[0]])
            there = self.array(name, s)
            if not len(there):
                continue
            spot = np.minimum(np.searchsorted(there, keys[part]), len(there) - 1)
            hit = there[spot] == keys[part]
            place[part[hit]] = spot[hit]
            found[part[hit]] = self.array(value, s)[spot[hit]]
        return place, found

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1 if unknown) and count of each token."""
        distinct, inverse = np.unique(hashes, return_inverse=True)
        shard = self.layout.word_shard(distinct)
        place, count = self._find(distinct, shard, "words", "counts")
        number = np.where(place >= 0, place + np.array(self.layout.base, np.int64)[shard], -1)
        return number[inverse], count[inverse]

    def pairs(self, first: np.ndarray, second: np.ndarray, first_count: np.ndarray) -> np.ndarray:
        """How often each pair of word numbers was seen."""
        key = (first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        distinct, at, inverse = np.unique(key, return_index=True, return_inverse=True)
        shard = self.layout.pair_shard(first[at].astype(np.uint64), second[at].astype(np.uint64), first_count[at])
        return self._find(distinct, shard, "pairs", "pair_counts")[1][inverse]

    def by_number(self, name: str, numbers: np.ndarray, columns: int) -> np.ndarray:
        """Rows of a dense table of the words, by word number."""
        base = np.array(self.layout.base, np.int64)
        distinct, inverse = np.unique(numbers, return_inverse=True)
        out = np.zeros((len(distinct), columns), np.int64)
        shard = np.searchsorted(base, distinct, side="right") - 1
        for s in np.unique(shard).tolist():
            there = self.array(name, s)
            if len(there):
                out[shard == s] = there.reshape(-1, columns)[distinct[shard == s] - base[s]]
        return out[inverse]


@dataclass(frozen=True)
class Model:
    layout: Layout
    n_tokens: int
    n_words: int
    discounts: tuple[float, ...]
    lower_discounts: tuple[float, ...]
    pair_types: int
    lower_mass: float

    def log10(self, store: Store, hashes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each token after the one before it, and its training count.

        p(w | u) = max(c(uw) - D(c), 0) / c(u) + mass(u) * p(w), and p(w) the same one order lower
        over the number of different words before w, interpolated with 1 / (words + 1), where the
        one more is for unknown words.
        """
        number, count = store.words(hashes)
        first, first_count = store.words(before)
        known = number >= 0
        lower = np.full(len(hashes), self.lower_mass / (self.n_words + 1))
        if known.any():
            kinds = store.by_number("before", number[known], 1)[:, 0]
            lower[known] += np.maximum(kinds - discount(kinds, self.lower_discounts), 0) / max(1, self.pair_types)
        p = lower.copy()
        led = first >= 0
        if led.any():
            after = store.by_number("after", first[led], 3)
            mass = (after * np.array(self.discounts)).sum(axis=1) / np.maximum(first_count[led], 1)
            p[led] = mass * lower[led]
        both = led & known
        if both.any():
            seen = store.pairs(first[both], number[both], first_count[both])
            p[both] += np.maximum(seen - discount(seen, self.discounts), 0) / first_count[both]
        return np.log10(np.maximum(p, 1e-300)), count


def discount(counts: np.ndarray, of: tuple[float, ...]) -> np.ndarray:
    return np.array([0.0, *of])[np.minimum(counts, 3)]


def modified_discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from how many keys have the counts 1, 2, 3, 4.

    Where a small corpus lacks one of these counts, 0.5, 1 and 1.5 stand in.
    """
    if min(n) <= 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    out = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return tuple(float(min(max(d, 0.05), k - 0.05)) if k > 1 else float(min(max(d, 0.05), 0.95)) for k, d in zip((1, 2, 3), out, strict=True))


def _count_words(layout: Layout) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, heap = SpanHash(2, lower=True), Heap()

        def out():
            keys, counts = heap.take()
            return runs(layout.word_shard(keys), 0, keys, counts)

        for batch in batches:
            for piece in slices(batch, "text"):
                hashes, _, _ = tokens(*raw(piece.column("text")), hasher)
                heap.add(np.array([BEGIN]), np.array([piece.num_rows]))
                if heap.add(hashes):
                    yield out()
        if heap.size:
            yield out()

    return run


def _write_words(layout: Layout) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in merged_shards(batches):
            keys, counts = parts[0]
            put(layout.file("words", shard), keys)
            put(layout.file("counts", shard), counts.astype(np.uint32))
            begins = int(counts[keys == BEGIN].sum())
            row = [shard, len(keys), int(counts.sum()) - begins, int(begins > 0)]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in row], ["shard", "words", "tokens", "begins"])

    return run


def _count_pairs(layout: Layout) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, store, heap = SpanHash(2, lower=True), Store(layout), Heap()
        base = np.array(layout.base, np.int64)

        def out():
            keys, counts = heap.take()
            first = keys >> np.uint64(32)
            shard_of = np.searchsorted(base, first.astype(np.int64), side="right") - 1
            # Counts of first words, to deal the frequent ones by their second word too.
            first_count = np.zeros(len(keys), np.int64)
            edges = np.searchsorted(shard_of, np.arange(len(base) + 1))
            for s in np.unique(shard_of).tolist():
                a, b = edges[s], edges[s + 1]
                first_count[a:b] = store.array("counts", s)[first[a:b].astype(np.int64) - base[s]]
            second = keys & np.uint64(0xFFFFFFFF)
            return runs(layout.pair_shard(first, second, first_count), 0, keys, counts)

        for batch in batches:
            for piece in slices(batch, "text"):
                hashes, before, _ = tokens(*raw(piece.column("text")), hasher)
                number, first = store.words(hashes)[0], store.words(before)[0]
                if heap.add((first.astype(np.uint64) << np.uint64(32)) | number.astype(np.uint64)):
                    yield out()
        if heap.size:
            yield out()

    return run


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _write_pairs(layout: Layout) -> Callable:
    """Writes a shard of the pairs, and gives what its pairs tell of their words: for each second
    word how many different words come before it (kind 0), for each first word how many pairs have
    count 1, 2 and more (kinds 1 to 3), and counts of counts (kind 9 in shard -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.array(layout.base, np.int64)
        for shard, parts in merged_shards(batches):
            keys, counts = parts[0]
            put(layout.file("pairs", shard), keys)
            put(layout.file("pair_counts", shard), counts.astype(np.uint32))
            first, second = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
            for kind, words in enumerate([second, *(first[np.minimum(counts, 3) == k] for k in (1, 2, 3))]):
                numbers, seen = np.unique(words, return_counts=True)
                yield runs(np.searchsorted(base, numbers.astype(np.int64), side="right") - 1, kind, numbers, seen)
            marks = np.array([1, 2, 3, 4], np.uint64)
            yield runs(np.full(4, -1), 9, marks, np.array(_counts_of_counts(counts)))

    return run


def _write_tables(layout: Layout, sizes: tuple[int, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.array(layout.base, np.int64)
        for shard, parts in merged_shards(batches):
            if shard < 0:
                row = [shard, *parts[9][1].tolist(), 0, 0]
            else:
                before, after = np.zeros(sizes[shard], np.uint32), np.zeros((sizes[shard], 3), np.uint32)
                for kind, (numbers, seen) in parts.items():
                    place = numbers.astype(np.int64) - base[shard]
                    if kind == 0:
                        before[place] = seen
                    else:
                        after[place, kind - 1] = seen
                put(layout.file("before", shard), before)
                put(layout.file("after", shard), after)
                row = [shard, *_counts_of_counts(before), int((before >= 3).sum()), int(before.sum(dtype=np.int64))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], pa.int64()) for v in row], ["shard", "c1", "c2", "c3", "c4", "more", "types"]
            )

    return run


def train(docs: DataFrame, shard_bytes: int = 64 << 20) -> Model:
    """Count the words and pairs of all whole texts (column text; null as empty) and store the model.

    Tasks turn their texts into sorted runs of distinct keys with counts, one for each shard; a
    shard's runs are merged in one task. The number of shards follows the bytes of the texts, so
    the size of a shard, of a task and of a file does not grow with the corpus. Only sizes and
    counts of counts come to the driver.
    """
    spark = docs.sparkSession
    texts = docs.select(whole("text").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    word_shards = power_of_two(max(16, total // shard_bytes))
    folder = make_folder(f"{shared_dir(spark)}/bigrams-{uuid.uuid4().hex}")
    layout = Layout(folder, word_shards.bit_length() - 1, power_of_two(max(32, 4 * total // shard_bytes)))

    counted = dealt(texts.mapInArrow(_count_words(layout), RUN))
    made = counted.mapInArrow(_write_words(layout), "shard long, words long, tokens long, begins long").collect()
    sizes = dict.fromkeys(range(word_shards), 0) | {r["shard"]: r["words"] for r in made}
    for s in set(sizes) - {r["shard"] for r in made}:
        put(layout.file("words", s), np.zeros(0, np.uint64))
        put(layout.file("counts", s), np.zeros(0, np.uint32))
    ends = np.cumsum([sizes[s] for s in range(word_shards)])
    n_tokens, n_words = sum(r["tokens"] for r in made), int(ends[-1]) - sum(r["begins"] for r in made)
    if ends[-1] >= 1 << 32:
        raise ValueError("word numbers take 32 bits")
    base = tuple(int(e) - sizes[s] for s, e in enumerate(ends))
    layout = Layout(folder, layout.bits, layout.pair_shards, base, max(1000, n_tokens // (4 * layout.pair_shards)))

    pairs = dealt(texts.mapInArrow(_count_pairs(layout), RUN))
    about = settle(pairs.mapInArrow(_write_pairs(layout), RUN), "bigram-words")
    schema = "shard long, c1 long, c2 long, c3 long, c4 long, more long, types long"
    tables = dealt(about).mapInArrow(_write_tables(layout, tuple(sizes[s] for s in range(word_shards))), schema).collect()
    _fill_missing(layout, tables, word_shards, sizes)
    of_pairs = [sum(r[f"c{k}"] for r in tables if r["shard"] < 0) for k in (1, 2, 3, 4)]
    of_words = [sum(r[f"c{k}"] for r in tables if r["shard"] >= 0) for k in (1, 2, 3, 4)]
    more, types = (sum(r[c] for r in tables if r["shard"] >= 0) for c in ("more", "types"))
    lower = modified_discounts(of_words)
    mass = (lower[0] * of_words[0] + lower[1] * of_words[1] + lower[2] * more) / types if types else 1.0
    return Model(layout, n_tokens, n_words, modified_discounts(of_pairs), lower, types, mass)


def _fill_missing(layout: Layout, tables: list, word_shards: int, sizes: dict[int, int]) -> None:
    """Files of shards that no word or pair was dealt to."""
    for s in set(range(word_shards)) - {r["shard"] for r in tables}:
        put(layout.file("before", s), np.zeros(sizes[s], np.uint32))
        put(layout.file("after", s), np.zeros((sizes[s], 3), np.uint32))
    fs, path = pafs.FileSystem.from_uri(layout.folder)
    there = {os.path.basename(f.path) for f in fs.get_file_info(pafs.FileSelector(path))}
    for s in range(layout.pair_shards):
        if f"pairs-{s:06d}" not in there:
            put(layout.file("pairs", s), np.zeros(0, np.uint64))
            put(layout.file("pair_counts", s), np.zeros(0, np.uint32))


def _scorer(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, store = SpanHash(2, lower=True), Store(model.layout)
        for batch in batches:
            for piece in slices(batch, "text"):
                n = piece.num_rows
                hashes, before, owner = tokens(*raw(piece.column("text")), hasher)
                log, count = model.log10(store, hashes, before)
                base = np.log10((count + 0.5) / (model.n_tokens + 0.5 * (model.n_words + 1)))
                columns = [
                    np.bincount(owner, minlength=n),
                    np.bincount(owner, weights=count > 0, minlength=n).astype(np.int64),
                    np.full(n, model.n_tokens, np.int64),
                    np.bincount(owner, weights=base, minlength=n),
                    np.bincount(owner, weights=log, minlength=n),
                ]
                rest = piece.drop_columns(["text"])
                names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
                yield pa.RecordBatch.from_arrays([*rest.columns, *map(pa.array, columns)], [*rest.schema.names, *names])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    ``score`` is the model's log10 probability of the text and its end; -score / n_tokens is the
    log10 of the perplexity. ``base_score`` is that of smoothed word counts. A null or empty text is
    its end alone. One pass without a shuffle; workers map the model's files in the shared folder.
    """
    picked = docs.select("doc_id", whole("text").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    return picked.mapInArrow(
        _scorer(model), f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


@query("op2_kneser_ney")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 5) == 1
    found = score(docs, train(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
