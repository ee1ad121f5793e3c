"""Packing by power-of-two decomposition."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tipoff.llm.common import query, table
from tipoff.llm.textbytes import SPACE, SpanHash, Words, raw, slices

END_ID = 0
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
#: Characters that the tokenizer's pattern takes for white space, besides blank and line feed.
OTHER_SPACE = (
    "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


class WordTokenizer:
    """Ids of whole texts as the tokenizer file gives them, each distinct word encoded once.

    The file's pattern never joins characters over a blank or a line feed, except that one blank
    goes to the word behind it. So in a text whose words are parted by single blanks and line
    feeds, ids are those of its words in a row, each with its blank. Any other text (runs of white
    space, white space at an end, other space characters, the end-of-text mark) is encoded whole.
    """

    def __init__(self, folder: str | None = None, name: str = "byte_bpe_50k", most_words: int = 2_000_000):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        def at(file: str) -> str:
            return os.path.join(folder, file) if folder else public_tokenizers.path(file)

        self.whole = Tokenizer.from_file(at(f"{name}.json"))
        with open(at(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.words = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.line_feed = self.words.encode_ordinary("\n")
        self.hasher, self.most_words = SpanHash(8), most_words
        self._empty()

    def _empty(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        lists = [self.words.encode_ordinary(w) for w in words]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter((i for one in lists for i in one), np.uint32, int(size.sum()))
        at = len(self.ids) + np.cumsum(size) - size
        spot = np.searchsorted(self.known, keys)
        self.known = np.insert(self.known, spot, keys)
        self.at, self.size = np.insert(self.at, spot, at), np.insert(self.size, spot, size)
        self.ids = np.concatenate([self.ids, ids])

    def regular(self, text: str) -> bool:
        return not (
            text[:1] in ("", " ", "\n")
            or text[-1] in " \n"
            or "  " in text
            or "\n\n" in text
            or " \n" in text
            or "\n " in text
            or "<|endoftext|>" in text
            or any(c in text for c in OTHER_SPACE)
        )

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        strings = texts.fill_null("").to_pylist()
        regular = np.fromiter(map(self.regular, strings), bool, len(strings))
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(strings)
        odd = np.flatnonzero(~regular)
        for i, e in zip(odd, self.whole.encode_batch([strings[i] for i in odd], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32)
        if not regular.any():
            return out
        data, offsets = raw(texts.filter(pa.array(regular)))
        words = Words(data, offsets)
        starts = words.starts
        blank = np.zeros(len(starts), bool)
        blank[1:] = data[starts[1:] - 1] == 32
        first = np.zeros(len(starts), bool)
        first[words.range[:-1]] = True
        blank &= ~first
        # A word with its blank, and one without, are different keys.
        keys = self.hasher.load(data).spans(starts - blank, words.ends)
        distinct, where, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) > self.most_words:
            self._empty()
        spot = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = spot < len(self.known)
        new[inside] = self.known[spot[inside]] != distinct[inside]
        if new.any():
            i = where[new]
            view = data.tobytes()
            spans = zip((starts - blank)[i].tolist(), words.ends[i].tolist(), strict=True)
            self._learn(distinct[new], [view[a:b].decode() for a, b in spans])
            spot = np.searchsorted(self.known, distinct)
        # Line feeds are one id in front of the word they precede.
        feed = (~blank & ~first).astype(np.int64)
        at, size = self.at[spot][inverse], self.size[spot][inverse]
        full = size + feed * len(self.line_feed)
        ends = np.cumsum(full)
        n = int(ends[-1]) if len(ends) else 0
        ids = np.empty(n, np.uint32)
        run = np.arange(n) - np.repeat(ends - full, full)
        lead = run < np.repeat(feed * len(self.line_feed), full)
        source = np.repeat(at - (feed * len(self.line_feed)), full) + run
        ids[lead] = self.line_feed[0]
        ids[~lead] = self.ids[source[~lead]]
        bounds = np.concatenate([[0], ends])[words.range]
        for i, a, b in zip(np.flatnonzero(regular), bounds[:-1], bounds[1:], strict=True):
            out[i] = ids[a:b]
        return out


def binary_pieces(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: as many of the longest as fit, then one for each
    binary digit of the rest, long ones first."""
    pieces = [(s, longest) for s in range(0, n - longest + 1, longest)]
    start, rest = n - n % longest, n % longest
    while rest:
        length = 1 << (rest.bit_length() - 1)
        pieces.append((start, length))
        start, rest = start + length, rest - length
    return pieces


def _packer(folder: str | None, longest: int, end_id: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(folder)
        # Numbers of a task's sequences: its partition, then a count.
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for piece in slices(batch, "text"):
                columns: list[list] = [[] for _ in range(8)]
                for doc_id, ids in zip(piece.column("doc_id").to_pylist(), tokenizer.encode(piece.column("text")), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for start, length in binary_pieces(len(ids), longest):
                        part = ids[start : start + length]
                        row = (doc_id, start, length, zlib.crc32(part.tobytes()), len(ids), number, 0)
                        for column, value in zip(columns, row, strict=False):
                            column.append(value)
                        if with_ids:
                            columns[7].append(part)
                        number += 1
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
                if with_ids:
                    names.append("ids")
                    arrays.append(pa.array(columns[7], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    longest: int = 1024,
    end_id: int = END_ID,
    tokenizer_folder: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (, ids).

    A document's ids, with ``end_id`` behind them, are cut into pieces whose lengths are powers of
    two, at most ``longest``. Every piece is a sequence of its own, so none holds two documents and
    none is padded, and batches are drawn from the bucket of one ``length``; ``write_buckets``
    stores them so. It takes one pass over the texts and no shuffle, whatever the sources' sizes.

    Without ``tokenizer_folder`` each worker takes the files of its own ``public_tokenizers``.

    A null or empty text is the end id alone. Rows that repeat a document are packed as often as
    they come. A null id stays null. Sequence numbers are unique in one result; they follow the
    partitions of the input. Extra columns are ignored, an empty table gives an empty result.
    """
    if longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    schema = PIECES + (", ids array<int>" if with_ids else "")
    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return picked.mapInArrow(_packer(tokenizer_folder, longest, end_id, with_ids), schema)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Store pieces in one folder for each length, which is the bucket that batches are drawn from."""
    pieces.write.partitionBy("length").parquet(path)


@query("op8_binary_packing")
def op8(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
