from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
from tests.llm.conftest import ODD

from tipoff.llm.lines import Cuckoo, LineIndex, drop_lines, line_digests, line_key

FRAME = "This line is the frame of every page of the site, Menu | Home"


def brute(rows, least=40, min_docs=5):
    holders = defaultdict(list)
    for doc_id, text in rows:
        for key in {line_key(x) for x in (text or "").split("\n")}:
            if len(key.decode()) >= least:
                holders[key].append(doc_id)
    top = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if line_key(x) not in top or top[line_key(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def framed(n):
    pads = ["", "  ", "\t"]
    return [(100 + i, f"{pads[i % 3]}{FRAME.upper() if i % 2 else FRAME} \nown line {i}\n{FRAME}", "en", "a") for i in range(n)]


def digests(make, index, rows):
    return sorted((tuple(r) for r in line_digests(make(rows), index).collect()), key=str)


def test_digests_of_documents(make, llm, documents):
    for rows in (ODD + framed(30), [(i, t, "en", "a") for i, t in documents[1]], framed(4), framed(5)):
        index = LineIndex.empty(llm).insert(make(rows))
        assert digests(make, index, rows) == brute([r[:2] for r in rows])


def test_batches_can_be_taken_back(make, llm):
    first, second = framed(6), [(500 + i, f"{FRAME}\nsecond {i}\n" + "y" * 50, "en", "b") for i in range(6)]
    index = LineIndex.empty(llm, shards=4).insert(make(first))
    both = index.insert(make(second))
    assert digests(make, both, first + second) == brute([r[:2] for r in first + second])
    back = both.delete(make(second).select("doc_id"))
    assert sorted(map(tuple, back.refs.collect())) == sorted(map(tuple, index.refs.collect()))
    assert digests(make, back, first) == brute([r[:2] for r in first])
    few = back.delete(make(first[:3]).select("doc_id"))
    assert digests(make, few, first[3:]) == brute([r[:2] for r in first[3:]])
    assert few.drops().count() == 0


def test_a_batch_tried_again_changes_nothing(make, llm):
    rows = framed(4) + [(None, f"{FRAME}\nno id", "en", "a")]
    once = LineIndex.empty(llm, shards=4).insert(make(rows))
    again = once.insert(make(rows)).insert(make(rows[:2]))
    for name in ("refs", "holders"):
        assert Counter(map(tuple, getattr(again, name).collect())) == Counter(map(tuple, getattr(once, name).collect()))
    assert digests(make, again, rows) == brute([r[:2] for r in rows])
    more = again.insert(make([(900, FRAME, "en", "a"), *rows[:1]]))
    assert more.refs.agg({"n_docs": "max"}).first()[0] == 6


def test_text_and_other_columns_stay(make, llm):
    rows = ODD + framed(6)
    docs = make(rows)
    out = drop_lines(docs, LineIndex.empty(llm).insert(docs))
    assert out.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[1] is None and texts[2] == "" and texts[100] == "own line 0"
    assert texts[105].count("\n") == 2


def test_empty_index(make, llm):
    assert line_digests(make([]), LineIndex.empty(llm).insert(make([]))).count() == 0


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    cuckoo = Cuckoo.sized(len(keys))
    assert cuckoo.insert(keys) and cuckoo.contains(keys).all()
    assert cuckoo.contains(rng.integers(1 << 63, (1 << 64) - 1, 20_000, dtype=np.uint64)).mean() < 0.01
    cuckoo.delete(keys[:10_000])
    assert cuckoo.contains(keys[10_000:]).all()
    assert cuckoo.contains(keys[:10_000]).mean() < 0.01
