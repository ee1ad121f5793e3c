"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.common import query, settle, table
from tipoff.llm.textbytes import slices

#: A piece of text that both tokenizers treat alone: neither joins a character to a blank or a line
#: feed behind it.
UNIT = re.compile(r"[ \n]\s*(?:\S++(?:[^\S \n]\s*)?)*+")
#: Rows of an Arrow step, about: byte offsets, in characters of text.
STEP = 1 << 19
#: Links of a block of documents, about; a block has one dictionary of id pairs.
BLOCK_LINKS = 3_000_000
OFFSET_BITS = 40

ROWS = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "slots array<int>, times array<long>, keys array<long>, docs array<long>"
)
RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def byte_letters() -> dict[str, int]:
    """The byte behind each letter of byte-level entries: printable ones stand for themselves, the
    others for letters from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def _ids(path_a: str, path_b: str) -> Ids:
    """One for each Python worker, so that its tasks share what was learned."""
    return Ids(path_a, path_b)


class Growing:
    """An array that is added to; its room doubles."""

    def __init__(self, kind: type):
        self.room, self.n = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            room = np.zeros(max(2 * len(self.room), self.n + len(values)), self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.room[at]


class Ids:
    """Token ids of units in a row, each distinct unit encoded once."""

    def __init__(self, path_a: str, path_b: str, most_units: int = 500_000):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab().items():
            known = all(c in letters for c in entry)
            self.bytes_a[i] = bytes(letters[c] for c in entry) if known else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        if max(len(self.bytes_a), len(self.bytes_b)) > 1 << 16:
            raise ValueError("ids are held in 16 bits")
        self.sizes_a = pa.array([len(x) for x in self.bytes_a], pa.int64())
        self.sizes_b = pa.array([len(x) for x in self.bytes_b], pa.int64())
        self.most_units = most_units
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.good = Growing(bool)
        self.ids = [Growing(np.uint16), Growing(np.uint16)]
        self.at = [Growing(np.int64), Growing(np.int64)]
        self.size = [Growing(np.int64), Growing(np.int64)]

    def numbers(self, units: list[str]) -> np.ndarray:
        """The number of each unit, learning new ones."""
        new = [u for u in dict.fromkeys(units) if u not in self.known]
        if new:
            lists_a = [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)]
            # The model puts a blank in front; before a line feed both are tokens of their own.
            lists_b = [x[2:] for x in self.b.encode(["\n" + u for u in new], num_threads=1)]
            good = np.ones(len(new), bool)
            whole = "".join(new).encode()
            spelled = [b"".join(map(of.__getitem__, chain.from_iterable(x))) for of, x in ((self.bytes_a, lists_a), (self.bytes_b, lists_b))]
            if not spelled[0] == whole == spelled[1]:
                for i, (unit, a, b) in enumerate(zip(new, lists_a, lists_b, strict=True)):
                    want = unit.encode()
                    good[i] = b"".join(map(self.bytes_a.__getitem__, a)) == want == b"".join(map(self.bytes_b.__getitem__, b))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.good.add(good)
            for side, lists in enumerate((lists_a, lists_b)):
                size = np.fromiter(map(len, lists), np.int64, len(lists))
                self.at[side].add(self.ids[side].n + np.cumsum(size) - size)
                self.size[side].add(size)
                self.ids[side].add(np.fromiter(chain.from_iterable(lists), np.uint16, int(size.sum())))
        return np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))

    def lists(self, numbers: np.ndarray, ends: np.ndarray, side: int) -> pa.LargeListArray:
        """One list of ids for each run of units."""
        size = self.size[side][numbers]
        after = np.cumsum(size)
        total = int(after[-1]) if len(after) else 0
        source = np.arange(total) + np.repeat(self.at[side][numbers] - (after - size), size)
        bounds = np.concatenate([[0], after])[np.concatenate([[0], ends])]
        return pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pa.array(self.ids[side][source].astype(np.int64)))


def ends_of(lists: pa.LargeListArray, sizes: pa.Array, side: str) -> pa.Table:
    """(end, place): the key of a text and a byte offset where a token ends, and the token's place."""
    flat, parent = lists.flatten(), pc.list_parent_indices(lists)
    run = pc.cumulative_sum(pc.take(sizes, flat))
    before = pc.subtract(run, pc.take(sizes, flat))
    # Segmented: a text's sums start from what came before its first token.
    starts = lists.offsets.slice(0, len(lists))
    first = pc.take(before, pc.if_else(pc.less(starts, len(flat)), starts, pa.scalar(None, pa.int64())))
    offset = pc.subtract(run, pc.take(first, parent))
    end = pc.add(pc.shift_left(parent, pa.scalar(OFFSET_BITS, pa.int64())), offset)
    return pa.table({"end": end, side: pa.array(np.arange(len(flat)))})


def aligned(a: pa.LargeListArray, b: pa.LargeListArray, sizes_a: pa.Array, sizes_b: pa.Array) -> tuple[pa.Table, pa.Table]:
    """Links (text, a, b as places of tokens) of texts encoded twice, and of them the ones that end a group.

    Every byte offset where a token of either side ends closes one pair of tokens that overlap, and
    it is the last one that they share. The other side's token there is the next to end.
    """
    joined = ends_of(a, sizes_a, "a").join(ends_of(b, sizes_b, "b"), "end", join_type="full outer", use_threads=False)
    joined = joined.sort_by("end").combine_chunks()
    closes = pc.and_(pc.is_valid(joined["a"]), pc.is_valid(joined["b"]))
    links = pa.table(
        {
            "text": pc.shift_right(joined["end"], pa.scalar(OFFSET_BITS, pa.int64())),
            "a": pc.fill_null_backward(joined["a"]),
            "b": pc.fill_null_backward(joined["b"]),
        }
    )
    return links, links.filter(closes)


def group_strings(a: pa.LargeListArray, b: pa.LargeListArray, groups: pa.Table, words: dict[str, pa.Array]) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of each text."""
    ids_a, ids_b = a.flatten().to_numpy(), b.flatten().to_numpy()
    last_a, last_b = groups["a"].to_numpy(), groups["b"].to_numpy()
    group_a = np.searchsorted(last_a, np.arange(len(ids_a)))
    group_b = np.searchsorted(last_b, np.arange(len(ids_b)))
    # A's tokens come after B's of the groups before theirs, B's after A's of their own group.
    place_a = np.arange(len(ids_a)) + np.concatenate([[-1], last_b])[group_a] + 1
    place_b = np.arange(len(ids_b)) + last_a[group_b] + 1
    n = len(words["all"]) // 3
    code = np.empty(len(ids_a) + len(ids_b), np.int64)
    mark_a, mark_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    mark_a[last_a], mark_b[last_b] = 1, 2
    code[place_a], code[place_b] = ids_a + mark_a * n, ids_b + mark_b * n
    bounds = pc.add(a.offsets, b.offsets)
    items = pc.take(words["all"], pa.array(code))
    joined = pc.binary_join(pa.LargeListArray.from_arrays(bounds, items), pa.scalar("", items.type))
    return joined.to_pylist()


class Blocks:
    """Aligned documents of one task, given out in blocks with a dictionary of their id pairs."""

    def __init__(self, ids: Ids, number: int):
        self.ids, self.number = ids, number
        n = max(len(ids.sizes_a), len(ids.sizes_b))
        names = [str(i) for i in range(n)]
        self.words = {"all": pa.array([x + mark for mark in ",|;" for x in names], pa.large_string())}
        self.width = len(ids.sizes_b)
        self.clear()

    def clear(self) -> None:
        self.docs: list[list] = []
        self.pairs: list[pa.Table] = []
        self.links = 0

    def add(self, doc_id: int | None) -> int:
        """A document without tokens so far."""
        self.docs.append([doc_id, 0, 0, 0, 0, hashlib.sha256()])
        return len(self.docs) - 1

    def align(self, rows: list[int], runs: list[np.ndarray]) -> None:
        """Add ``runs`` of units to the documents ``rows``."""
        if not runs:
            return
        numbers, ends = np.concatenate(runs), np.cumsum([len(x) for x in runs])
        a, b = self.ids.lists(numbers, ends, 0), self.ids.lists(numbers, ends, 1)
        links, groups = aligned(a, b, self.ids.sizes_a, self.ids.sizes_b)
        row = pa.array(rows, pa.int64())
        key = pc.add(pc.multiply(pc.take(a.flatten(), links["a"]), self.width), pc.take(b.flatten(), links["b"]))
        found = pa.table({"row": pc.take(row, links["text"]), "key": key})
        self.pairs.append(found.group_by(["row", "key"], use_threads=False).aggregate([([], "count_all")]))
        strings = group_strings(a, b, groups, self.words)
        count = {name: np.bincount(t["text"].to_numpy(), minlength=len(rows)) for name, t in (("links", links), ("groups", groups))}
        sizes = zip(pc.list_value_length(a).to_pylist(), pc.list_value_length(b).to_pylist(), strict=True)
        for k, (i, (n_a, n_b)) in enumerate(zip(rows, sizes, strict=True)):
            doc = self.docs[i]
            for field, n in enumerate((n_a, n_b, int(count["groups"][k]), int(count["links"][k])), start=1):
                doc[field] += n
            doc[5].update(b";" * (doc[1] > n_a) + strings[k][:-1].encode())
        self.links += links.num_rows

    def take(self) -> Iterator[pa.RecordBatch]:
        """The block's documents, then its dictionary, and start the next block."""
        if not self.docs:
            return
        n = len(self.docs)
        pairs = pa.concat_tables(self.pairs) if self.pairs else pa.table({"row": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "count_all": pa.array([], pa.int64())})
        # A long document comes in several runs.
        pairs = pairs.group_by(["row", "key"], use_threads=False).aggregate([("count_all", "sum")]).sort_by("row")
        partial = pairs.group_by("key", use_threads=False).aggregate([([], "count_all")])
        keys = partial["key"].to_numpy()
        order = np.argsort(keys)
        slots = np.searchsorted(keys[order], pairs["key"].to_numpy())
        bounds = np.searchsorted(pairs["row"].to_numpy(), np.arange(n + 1))
        schema = pa.schema(
            [(x, pa.int64()) for x in ("block", "doc_id", "n_a", "n_b", "n_groups", "n_links")]
            + [("groups_sha256", pa.string()), ("slots", pa.list_(pa.int32()))]
            + [(x, pa.list_(pa.int64())) for x in ("times", "keys", "docs")]
        )
        for start in range(0, n, 512):
            part = self.docs[start : start + 512]
            at = bounds[start : start + len(part) + 1]
            offsets = pa.array(at - at[0], pa.int32())
            columns = [pa.array([self.number] * len(part), pa.int64())]
            columns += [pa.array([d[k] for d in part], pa.int64()) for k in range(5)]
            columns += [
                pa.array([d[5].hexdigest() if d[1] else "" for d in part]),
                pa.ListArray.from_arrays(offsets, pa.array(slots[at[0] : at[-1]], pa.int32())),
                pa.ListArray.from_arrays(offsets, pairs["count_all_sum"].combine_chunks().slice(at[0], at[-1] - at[0])),
            ]
            columns += [pa.nulls(len(part), pa.list_(pa.int64()))] * 2
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
        one = {f.name: pa.nulls(1, f.type) for f in schema}
        one["block"] = pa.array([self.number], pa.int64())
        one["keys"] = pa.array([keys[order]], pa.list_(pa.int64()))
        one["docs"] = pa.array([partial["count_all"].to_numpy()[order]], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(list(one.values()), schema=schema)
        self.number += 1
        self.clear()


def parts(text: str, step: int = STEP) -> Iterator[str]:
    """Cut a long text where a unit starts, about every ``step`` characters."""
    cut, start = re.compile(r"(?<=\S)[ \n]"), 0
    while len(text) - start > 2 * step and (found := cut.search(text, start + step)):
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def _aligner(path_a: str, path_b: str, step: int, block_links: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(path_a, path_b)
        blocks = Blocks(ids, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for piece in slices(batch, "text", step):
                if len(ids.known) > ids.most_units:
                    ids.forget()
                rows, runs, held = [], [], 0
                texts = piece.column("text").to_pylist()
                units = [UNIT.findall(p) for t in texts if t for p in parts(" " + t, step)]
                numbers = iter(np.split(ids.numbers(list(chain.from_iterable(units))), np.cumsum([len(u) for u in units])[:-1]))
                for doc_id, text in zip(piece.column("doc_id").to_pylist(), texts, strict=True):
                    row = blocks.add(doc_id)
                    own = [next(numbers) for _ in parts(" " + text, step)] if text else []
                    if not all(ids.good[x].all() for x in own):
                        continue
                    for x in own:
                        rows.append(row)
                        runs.append(x)
                        held += len(x)
                        if held > step // 4:
                            blocks.align(rows, runs)
                            rows, runs, held = [], [], 0
                blocks.align(rows, runs)
                if blocks.links > block_links:
                    yield from blocks.take()
        yield from blocks.take()

    return run


def _weigh(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Sums over the links of a block's documents."""
    size = counts.num_rows
    count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    slot = counts["slot"].to_numpy()
    count[slot], best[slot] = counts["count"].to_numpy(), counts["is_best"].to_numpy(zero_copy_only=False)
    out = {name: docs[name] for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    slots, times = docs["slots"].combine_chunks(), docs["times"].combine_chunks()
    owner = pc.list_parent_indices(slots).to_numpy()
    at, n = slots.flatten().to_numpy(), times.flatten().to_numpy()
    for name, weight in (("n_best", best), ("count_sum", count)):
        total = np.zeros(docs.num_rows, np.int64)
        np.add.at(total, owner, weight[at] * n)
        out[name] = pa.array(total)
    out["groups_sha256"] = docs["groups_sha256"]
    return pa.table(out)


def align_tokenizers(
    docs: DataFrame,
    *,
    path_a: str,
    path_b: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    step: int = STEP,
    block_links: int = BLOCK_LINKS,
) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``path_a`` is a byte-level tokenizer file, ``path_b`` a sentencepiece model; both encode a blank
    and the text. Tokens are flattened lists with parent indices; segmented sums of their byte
    lengths give the ends, and a hash join of both sides' ends on (text, end) gives links and
    groups. An id pair's documents are counted in its block first, then by Spark, so what is
    shuffled are one row per pair and block and, once, the documents' places in their block's
    dictionary; the texts are read once and not shuffled. A pair occurs once per block at most,
    so no key is hot, and a block is of bounded size.

    A null or empty text, and one that a side's tokens do not spell, has zeros and ''. Rows that
    repeat a document are documents of their own, and count as such. A null id stays null. Long
    texts are aligned in parts, cut where both tokenizers start anew. Extra columns are ignored,
    an empty table gives an empty result.
    """
    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    rows = settle(picked.mapInArrow(_aligner(path_a, path_b, step, block_links), ROWS), "alignment")
    words = rows.where("keys IS NOT NULL").select("block", F.posexplode(F.arrays_zip("keys", "docs")).alias("slot", "x"))
    words = words.select("block", "slot", F.col("x.keys").alias("key"), F.col("x.docs").alias("docs"))
    counts = settle(words.groupBy("key").agg(F.sum("docs").alias("count")), "alignment-counts")
    counts = counts.withColumn("a", F.expr(f"key DIV {_width(path_b)}"))
    top = counts.groupBy("a").agg(F.max("count").alias("top"))
    judged = counts.join(top, "a").select("key", "count", (F.col("count") == F.col("top")).alias("is_best"))
    back = words.drop("docs").join(judged, "key").select(F.col("block").alias("of"), "slot", "count", "is_best")
    held = rows.where("keys IS NULL").drop("keys", "docs")
    return held.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_weigh, RESULT)


def _width(path_b: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path_b).get_piece_size()


@query("op11_token_alignment")
def op11(spark, sf_dir):
    import public_tokenizers

    return align_tokenizers(
        table(spark, sf_dir, "documents"),
        path_a=public_tokenizers.path("byte_bpe_50k.json"),
        path_b=public_tokenizers.path("piece_bpe_32k.model"),
    )
