"""Repeated passages: a depth-limited radix sort of the windows of a corpus, in bytes or in words."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.common import query, settle, table, whole
from tipoff.llm.textbytes import SpanHash, Words, mix64, raw, slices
from tipoff.session import drop_staged, staged_tables

#: Bytes and words of an anchor.
GRAM, WORD_GRAM = 16, 3
#: A node packs its anchor's place and its range of offsets in one number.
BITS = 12
SLICE = 1 << 20


@dataclass(frozen=True)
class Depth:
    """Sizes of the passes for windows of ``length`` bytes or words: blocks of offsets, coarse to single ones.

    A size is a multiple of the next one. Otherwise a fine block would lie in two coarse ones, and
    the two halves of it that one anchor has would count as two places.
    """

    length: int
    words: bool = False

    @property
    def gram(self) -> int:
        return WORD_GRAM if self.words else GRAM

    @property
    def offsets(self) -> int:
        return self.length - self.gram + 1

    @property
    def blocks(self) -> list[int]:
        fine = -(-self.offsets // 24)
        sizes = sorted({8 * fine, fine, 1}, reverse=True)
        assert all(a % b == 0 for a, b in zip(sizes, sizes[1:], strict=False))
        return sizes


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` values in a row."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(-1, width)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - width + 1], head[width - 1 : n])


def load(texts: pa.Array, hasher: SpanHash, depth: Depth) -> np.ndarray:
    """Give ``hasher`` the bytes or words of some texts; offsets of the texts among them."""
    data, offsets = raw(texts)
    hasher.load(data)
    if not depth.words:
        return offsets
    words = Words(data, offsets)
    hasher.load_numbers(hasher.spans(words.starts, words.ends))
    return words.range


def anchors(offsets: np.ndarray, hasher: SpanHash, depth: Depth):
    """(text, anchor, least offset, largest offset) of all windows of some texts.

    The anchor of a window is its gram with the smallest hash, the leftmost among equals: equal
    windows have it at the same offset. The windows of one anchor start at consecutive places.
    """
    empty = np.zeros(0, np.int64)
    n = int(offsets[-1])
    if n < depth.length:
        return empty, empty, empty, empty
    place = np.arange(n - depth.gram + 1)
    mark = (hasher.spans(place, place + depth.gram) & np.uint64(0xFFFFFFFF00000000)) | place.astype(np.uint64)
    least = sliding_least(mark, depth.offsets)
    step = np.zeros(n + 1, np.int32)
    long = np.diff(offsets) >= depth.length
    np.add.at(step, offsets[:-1][long], 1)
    np.add.at(step, offsets[1:][long] - depth.length + 1, -1)
    start = np.flatnonzero(np.cumsum(step[:n]))
    if not len(start):
        return empty, empty, empty, empty
    anchor = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(start) != 1)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(start)]]) - 1
    text = np.searchsorted(offsets, start[first], side="right") - 1
    return text, anchor[first], anchor[first] - start[last], anchor[first] - start[first]


def split_blocks(text, anchor, low, high, size: int):
    """Cut ranges of offsets at the multiples of ``size`` within their anchor."""
    a, b = low // size, high // size
    times = b - a + 1
    row = np.repeat(np.arange(len(a)), times)
    block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + a[row]
    return text[row], anchor[row], np.maximum(low[row], block * size), np.minimum(high[row], (block + 1) * size - 1)


def _rows(offsets, hasher, refs, text, anchor, low, high, size, depth) -> pa.RecordBatch:
    """Digits of nodes: hashes of what all windows of a block share, and of all that they span.

    Nodes of one piece that agree in both are repeated for certain: only one of them, standing for
    all, has ``copies`` above 0 and goes on to the shuffle.
    """
    text, anchor, low, high = split_blocks(text, anchor, low, high, size)
    first = low // size * size
    last = np.minimum(first + size, depth.offsets) - 1
    # The lowest offset of the block is its last start.
    core = mix64(hasher.spans(anchor - first, anchor - last + depth.length) + (first + 1).astype(np.uint64))
    a, b = anchor - last, anchor - first + depth.length
    inside = (a >= offsets[text]) & (b <= offsets[text + 1])
    node = ((anchor - offsets[text]) << (2 * BITS)) | (low << BITS) | high
    own = mix64(refs[text].view(np.uint64) + mix64(node.astype(np.uint64)))
    outer = np.where(inside, hasher.spans(np.where(inside, a, 0), np.where(inside, b, 0)), own)
    _, where, count = np.unique(mix64(core + mix64(outer)), return_index=True, return_counts=True)
    copies = np.zeros(len(core), np.int32)
    copies[where] = count
    return pa.RecordBatch.from_arrays(
        [pa.array(core.view(np.int64)), pa.array(outer.view(np.int64)), pa.array(refs[text]), pa.array(node), pa.array(copies)],
        ["core", "outer", "ref", "node", "copies"],
    )


ROWS = "core long, outer long, ref long, node long, copies int"


def _first_pass(depth: Depth) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash(7)
        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                offsets = load(piece.column("text"), hasher, depth)
                refs = piece.column("ref").to_numpy()
                found = anchors(offsets, hasher, depth)
                yield _rows(offsets, hasher, refs, *found, depth.blocks[0], depth)

    return run


def _next_pass(depth: Depth, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash(7)
        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                offsets = load(piece.column("text"), hasher, depth)
                nodes = piece.column("nodes")
                text = np.repeat(np.arange(len(nodes)), nodes.value_lengths().to_numpy())
                node = nodes.flatten().to_numpy()
                low, high = (node >> BITS) & ((1 << BITS) - 1), node & ((1 << BITS) - 1)
                anchor = (node >> (2 * BITS)) + offsets[text]
                refs = piece.column("ref").to_numpy()
                yield _rows(offsets, hasher, refs, text, anchor, low, high, size, depth)

    return run


def radix_pass(rows: DataFrame, last: bool) -> tuple[DataFrame, DataFrame]:
    """(ref, node) of the nodes whose windows are all repeated, and of those to be cut finer.

    A core found once ends there: none of its windows is repeated. Nodes that agree in the outer
    digit as well are repeated whole. The others of a core go on, and with them one node for each
    outer digit found twice, as their partners may be among those. Cores are counted with partial
    sums and joined back, so a core that a third of all nodes share is split over tasks.
    """
    known = rows.where("copies = 0").select("ref", "node")
    counted = rows.where("copies > 0")
    # Written before they are joined: a join right above an aggregate cannot be split by key.
    cores = settle(counted.groupBy("core").agg(F.sum("copies").alias("in_core")).where("in_core > 1"), "radix-cores")
    alive = settle(counted.join(cores, "core"), "radix-alive")
    digits = alive.groupBy("core", "outer").agg(
        F.sum("copies").alias("in_both"), F.min(F.struct("ref", "node")).alias("first")
    )
    digits = settle(digits, "radix-digits")
    judged = settle(
        alive.join(digits, ["core", "outer"])
        .withColumn("is_first", F.col("first") == F.struct("ref", "node"))
        .where("in_both > 1 OR is_first")
        .select("ref", "node", "in_core", "in_both", "is_first"),
        "radix",
    )
    whole_nodes = judged.where("in_both > 1").select("ref", "node").unionByName(known)
    rest = judged.where("in_core > in_both AND is_first").select("ref", "node") if not last else None
    return whole_nodes, rest


def spans_of(nodes: DataFrame, length: int) -> DataFrame:
    """(ref, a, b): the bytes or words that the windows of each node cover."""
    mask = (1 << BITS) - 1
    anchor, low, high = F.shiftright("node", 2 * BITS), F.shiftright("node", BITS).bitwiseAND(mask), F.col("node").bitwiseAND(mask)
    return nodes.select("ref", (anchor - high).alias("a"), (anchor - low + length).alias("b"))


def repeated_spans(docs: DataFrame, length: int = 400, words: bool = False) -> DataFrame:
    """(ref, a, b) byte spans of ``docs`` (ref, text) whose union is all bytes in repeated windows.

    With ``words``, windows are ``length`` words and spans count words from the start of the text.
    Windows are ordered only through ``length`` bytes, by most significant digit first, where a
    window's digits are read outwards from its anchor. All windows of one anchor share bytes, so
    they pass as one node for each block of offsets instead of one by one: pass 1 compares what a
    third of the offsets share, pass 2 an eighth of that, pass 3 single windows. A block whose
    shared bytes are found once is done, and so is one whose whole span is found twice, so that
    only the ends of repeated passages reach pass 3. Equal groups there are the repeated windows.
    """
    depth = Depth(length, words)
    rows = settle(docs.select("ref", "text").mapInArrow(_first_pass(depth), ROWS), "radix-1")
    done, rest = radix_pass(rows, last=depth.blocks[0] == 1)
    found = spans_of(done, length)
    for number, size in enumerate(depth.blocks[1:], start=2):
        lists = rest.groupBy("ref").agg(F.collect_set("node").alias("nodes"))
        held = docs.select("ref", "text").join(lists, "ref")
        rows = settle(held.mapInArrow(_next_pass(depth, size), ROWS), f"radix-{number}")
        done, rest = radix_pass(rows, last=size == 1)
        found = found.unionByName(spans_of(done, length))
    return found


def span_lists(docs: DataFrame, length: int, words: bool, name: str) -> DataFrame:
    """(ref, ``name``): the spans of each text as a list, stored; the passes behind them are removed."""
    before = staged_tables(docs.sparkSession)
    found = repeated_spans(docs, length, words).groupBy("ref").agg(F.collect_list(F.struct("a", "b")).alias(name))
    found = settle(found, "radix-spans")
    drop_staged(docs.sparkSession, staged_tables(docs.sparkSession)[len(before) : -1])
    return found


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of spans as maximal runs in order."""
    order = np.argsort(starts, kind="stable")
    out: list[tuple[int, int]] = []
    for a, b in zip(starts[order].tolist(), ends[order].tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _runs(spans: pa.ListScalar) -> list[tuple[int, int]]:
    return merged(spans.values.field("a").to_numpy(), spans.values.field("b").to_numpy()) if spans.is_valid else []


def _cutter(output: str, words: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            texts = batch.column("text").fill_null("").cast(pa.large_binary())
            for text, spans in zip(texts, batch.column("spans"), strict=True):
                content, runs = text.as_py(), _runs(spans)
                kept, at = [], 0
                for a, b in runs:
                    kept.append(content[at:a])
                    at = b
                kept.append(content[at:])
                rest = b"".join(kept)
                columns[0].append(len(content))
                columns[1].append(len(content) - len(rest))
                columns[2].append(len(runs))
                columns[3].append(hashlib.sha256(rest).hexdigest() if output == "digest" else [{"a": a, "b": b} for a, b in runs])
            kind = pa.string() if output == "digest" else pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            arrays = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], kind)]
            name = "kept_sha256" if output == "digest" else "spans"
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", name]
            if words:
                arrays.append(pa.array([sum(b - a for a, b in _runs(spans)) for spans in batch.column("word_spans")], pa.int64()))
                names.append("n_repeated_words")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def cut_repeats(docs: DataFrame, length: int = 400, output: str = "spans", words: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans and the removed spans or, with
    ``output`` "digest", kept_sha256 of the bytes that stay.

    A byte goes if a string of ``length`` bytes that covers it also starts at any other place of
    any text, its own included. A null text is empty. Texts shorter than ``length`` stay whole.
    Rows that repeat id and text are two documents. Other columns are ignored.

    With ``words``, n_repeated_words follows: how many words of the whole text are covered by
    ``words`` words in a row that also start at any other place. It tells passages that are too
    short in bytes to go; nothing is removed for them. Words are parted by ASCII white space.
    """
    if not GRAM < length < 1 << BITS:
        raise ValueError(f"length must be between {GRAM} and {1 << BITS}")
    if words is not None and not WORD_GRAM < words < 1 << BITS:
        raise ValueError(f"words must be between {WORD_GRAM} and {1 << BITS}")
    text = whole("text")
    known = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("doc_id", text).alias("ref"))
    found = span_lists(known, length, False, "spans")
    columns = ["doc_id", "text", "spans"]
    last = "kept_sha256 string" if output == "digest" else "spans array<struct<a: long, b: long>>"
    if words:
        found = found.join(span_lists(known, words, True, "word_spans"), "ref", "full")
        columns.append("word_spans")
        last += ", n_repeated_words long"
    joined = known.join(found, "ref", "left").select(columns)
    return joined.mapInArrow(_cutter(output, words is not None), f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}")


@query("op7_radix_repeats")
def op7(spark, sf_dir):
    return cut_repeats(table(spark, sf_dir, "documents"), output="digest", words=51)
