from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tests.llm.conftest import ODD
from tokenizers import Tokenizer

from tipoff.llm.packing import WordTokenizer, binary_pieces, pack, write_buckets

TRICKY = [
    "", " a", "a ", "a  b", "a\nb", "a\n b", "foo\xa0bar baz", "it's I'll don't 12abc,", "x\ty", "a <|endoftext|> b",
    "été ça\nÜber 3²x", "日本語 テキスト\nabc", "a\n\nb", "don' t\n's x", "\x1c a", "b　c", "naïve—dash “q”", "🙂 x🙂\ny",
]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_tokenizer(plain, documents):
    texts = TRICKY + [t for _, t in documents[1]]
    got = WordTokenizer(most_words=500).encode(pa.array(texts))
    want = plain.encode_batch(texts, add_special_tokens=False)
    assert [g.tolist() for g in got] == [w.ids for w in want]


def test_binary_pieces():
    for n in (1, 2, 3, 1023, 1024, 1025, 5000):
        pieces = binary_pieces(n, 1024)
        assert [s for s, _ in pieces] == np.cumsum([0] + [k for _, k in pieces])[:-1].tolist()
        assert sum(k for _, k in pieces) == n
        assert all(k & (k - 1) == 0 and k <= 1024 for _, k in pieces)


def test_pieces_cover_each_document(make, plain):
    got = pack(make(), with_ids=True).collect()
    by_doc, sequences = defaultdict(list), set()
    for r in got:
        by_doc[r["doc_id"]].append(r)
        assert r["offset"] == 0 and r["sequence_id"] not in sequences
        sequences.add(r["sequence_id"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for doc_id, text, *_ in ODD:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        times = sum(d == doc_id for d, *_ in ODD)
        pieces = sorted(by_doc[doc_id], key=lambda r: r["start"])[::times]
        assert [i for r in pieces for i in r["ids"]] == ids
        assert {r["doc_tokens"] for r in pieces} == {len(ids)}


def test_pack_nothing(make):
    assert pack(make([])).count() == 0


def test_buckets_hold_one_length_each(make, documents, tmp_path):
    """Stored pieces: a folder for each length, and the documents' ids back from all of them."""
    picked = sorted(documents[1])[:60]
    pieces = pack(make([(i, t, "en", "a") for i, t in picked]), with_ids=True)
    path = str(tmp_path / "buckets")
    write_buckets(pieces, path)
    stored = pieces.sparkSession.read.parquet(path)
    back: dict = {}
    for r in sorted(stored.collect(), key=lambda r: (r["doc_id"], r["start"])):
        assert len(r["ids"]) == r["length"] and r["length"] & (r["length"] - 1) == 0
        back.setdefault(r["doc_id"], []).extend(r["ids"])
    want = {r["doc_id"]: [] for r in pieces.collect()}
    for r in sorted(pieces.collect(), key=lambda r: (r["doc_id"], r["start"])):
        want[r["doc_id"]].extend(r["ids"])
    assert back == want
    one = pieces.sparkSession.read.parquet(f"{path}/length=64")
    assert one.count() == pieces.where("length = 64").count()
