from __future__ import annotations

import bisect
import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tests.llm.conftest import ODD
from tokenizers import Tokenizer

from tipoff.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ZERO = (0, 0, 0, 0, 0, 0, "")


def brute(rows):
    """Every pair of tokens by its byte range, whole texts, no cutting."""
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = alignment.byte_letters()
    entries = {i: bytes(letters.get(c, 0) for c in t) for t, i in a.get_vocab().items()}

    def spell(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def spans(ids, of):
        out, at = [], 0
        for i in ids:
            out.append((at, at + len(of(i)), i))
            at = out[-1][1]
        return out

    docs = []
    for doc_id, text in rows:
        want = (" " + (text or "")).encode()
        ids = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        if not text or b"".join(map(entries.get, ids[0])) != want or b"".join(map(spell, ids[1])) != want:
            docs.append((doc_id, [], [], [], ""))
            continue
        x, y = spans(ids[0], entries.get), spans(ids[1], spell)
        cuts = sorted({s[1] for s in x} & {s[1] for s in y})
        held = [([], []) for _ in cuts]
        for side, spans_of_side in enumerate((x, y)):
            for s in spans_of_side:
                held[bisect.bisect_right(cuts, s[0])][side].append(str(s[2]))
        groups = ["|".join(",".join(side) for side in both) for both in held]
        links, low = [], 0
        for s in x:
            while y[low][1] <= s[0]:
                low += 1
            k = low
            while k < len(y) and y[k][0] < s[1]:
                links.append((s[2], y[k][2]))
                k += 1
        docs.append((doc_id, x, y, links, ";".join(groups)))
    counts = Counter(p for d in docs for p in set(d[3]))
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    out = []
    for doc_id, x, y, links, text in docs:
        n_best = sum(counts[p] == best[p[0]] for p in links)
        digest = hashlib.sha256(text.encode()).hexdigest() if x else ""
        out.append((doc_id, len(x), len(y), text.count(";") + bool(x), len(links), n_best, sum(counts[p] for p in links), digest))
    return sorted(out, key=str)


def got(df, **sizes):
    return sorted((tuple(r) for r in alignment.align_tokenizers(df, path_a=A, path_b=B, **sizes).collect()), key=str)


def test_odd_rows(make):
    odd = ["a  b\n\n c \n", "\n", " ", "a\tb c\t\td \t", "x y z  w　", "a\x1cb !\x1c c", "<|endoftext|> a <s> b</s>"]
    odd += ["<0x41> ▁q", "́a é ́", "\r\n a\r\nb", "it's 's 'll don't\n't", "\U0001f389 ‍ x"]
    rows = [r[:2] for r in ODD] + [(100 + i, t) for i, t in enumerate(odd)] + [(100, odd[0])]
    result = got(make([(i, t, "en", "a") for i, t in rows]))
    assert result == brute(rows)
    assert [r[1:] for r in result if r[0] == 107] == [ZERO]


def test_documents(make, documents):
    picked = sorted(documents[1])[:80]
    assert got(make([(i, t, "en", "a") for i, t in picked])) == brute(picked)


def test_long_text_in_parts(make):
    """Parts of a megabyte text give what the whole text gives."""
    text = "".join(f"word{i * 7919 % 1000}é x{i % 13}{' ' if i % 3 else chr(10)}" for i in range(40_000))
    assert len(text) > 400_000 and len(list(alignment.parts(text, 50_000))) > 5
    assert "".join(alignment.parts(text, 1000)) == text
    rows = [(1, text), (2, text[:5000]), (3, "a" * 3000), (4, text[:50_000])]
    assert got(make([(i, t, "en", "a") for i, t in rows]), step=50_000) == brute(rows)


def test_many_blocks(make, documents):
    """Dictionaries of many small blocks are merged."""
    picked = sorted(documents[1])[:40]
    assert got(make([(i, t, "en", "a") for i, t in picked]), step=500, block_links=100) == brute(picked)


def test_forgotten_units(documents):
    """A cleared cache learns again."""
    ids = alignment.Ids(A, B)
    units = alignment.UNIT.findall(" " + documents[1][0][1])
    first = ids.lists(ids.numbers(units), [len(units)], 0).to_pylist()
    ids.forget()
    assert ids.lists(ids.numbers(units), [len(units)], 0).to_pylist() == first


def test_nothing(make):
    assert alignment.align_tokenizers(make([]), path_a=A, path_b=B).count() == 0


@pytest.mark.parametrize("text", ["", " ", "\n", "a b", "a\nb  c", " x", "x "])
def test_units_tile_the_text(text):
    assert "".join(alignment.UNIT.findall(" " + text)) == " " + text
