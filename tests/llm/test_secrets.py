from __future__ import annotations

import random
import re

import duckdb
import pandas as pd
from tests.llm.conftest import ODD

from tipoff.llm.common import QUERIES
from tipoff.llm.secrets import BASE, BREAK, WEAK, Part, scan

KEY = "AKIA" + "Z7" * 8
BLOB = "wJalrXUtnFEMIK7MDENGbPxRfiCYzzEXAMPLE0KEY"
HEX = "0123456789abcdef" * 2


def brute(text, base=BASE, weak=WEAK, reach=400):
    """All pairs of parts of one text."""
    parts = [*base, *weak]
    found = []
    for i, p in enumerate(parts):
        for m in re.finditer(p.pattern, text or ""):
            if len(m[p.group]) >= p.least and all(re.search(c, m[0]) for c in p.also):
                found.append((m.start(), i, m.end()))
    breaks = [m.start() for m in re.finditer(BREAK, text or "")]
    strong = [s for s in found if s[1] < len(base)]
    scope = {s: sum(b <= s[0] for b in breaks) for s in found}
    free = [s for s in found if s[1] >= len(base) and not any(t[:2] < s[:2] and t[2] >= s[2] for t in strong)]
    out = []
    for s in free:
        near = {parts[q[1]].role for q in strong + free if scope[q] == scope[s] and q[0] <= s[2] + reach and q[2] >= max(s[0] - reach, 0)}
        if set(parts[s[1]].needs) <= near:
            out.append(s)
    return [(k, a, b) for a, k, b in sorted(strong)], [(k, a, b) for a, k, b in sorted(out)]


def got(df, **settings):
    rows = scan(df, **settings).collect()
    return sorted(((r["doc_id"], [tuple(s) for s in r["base"]], [tuple(s) for s in r["linked"]]) for r in rows), key=str)


def want(rows, **settings):
    return sorted(((i, *brute(t, **settings)) for i, t in rows), key=str)


def check(make, texts):
    rows = [r[:2] for r in ODD] + [(100 + i, t) for i, t in enumerate(texts)]
    result = got(make([(i, t, "en", "a") for i, t in rows]))
    assert result == want(rows)
    return {i: (b, w) for i, b, w in result if i is not None and i >= 100}


def test_complements(make):
    cases = [
        f"client_id: app77\n{BLOB}",
        f"client_id: app77\n\n{BLOB}",
        f"client_id: app77 {'x ' * 300} {BLOB}",
        BLOB,
        "see https://example.com/a now",
        f"{KEY} {BLOB} https://db.example.com:5432/x",
        f"{KEY} https://db.example.com:5432/x",
        "user = root\npassword = hunter22\nssh://host.example.com",
        f"user=root \n \t\n secret: {HEX}",
        f"日本 🎉 login = 'ann_b' , token='{HEX}'",
        f"{KEY}{KEY} AKIAAKIA{'A' * 12} AKIASHORT",
        "PASSWORD=token:abcdef passwd = abc secret=secret=abcdef ToKeN\"  :  \"x.y=z/w\"",
    ]
    found = check(make, cases)
    kinds = [[s[0] for s in found[100 + i][1]] for i in range(len(cases))]
    assert kinds[:10] == [[3, 4], [], [], [], [], [4, 5], [], [3, 5], [], [3]]


def test_random_texts(make):
    """Parts in any order, at every distance around the reach, over breaks and long gaps."""
    rng = random.Random(11)
    bits = [KEY, BLOB, HEX, "user=abc", "password: secret99", "https://h.example.com/p", "\n\n", "\n \n", "é " * 40, "w " * 199, "w " * 205]
    texts = ["".join(f"{rng.choice(bits)}{rng.choice([' ', chr(10), ' , '])}" for _ in range(rng.randrange(1, 30))) for _ in range(120)]
    check(make, texts)


def test_long_text(make):
    """Megabytes of parts in one text."""
    line = f"user=abc {BLOB} https://h.example.com/p {HEX}\n"
    rows = [(1, line * 8000)]
    ((_, base, linked),) = got(make([(1, rows[0][1], "en", "a")]))
    assert len(base) == 8000 and len(linked) == 24000


def test_repeated_rows_and_own_parts(make):
    """A row that repeats is answered each time; parts can be the caller's."""
    text = "id=7 key=abcdefgh"
    base, weak = (Part("key", "secret", r"key=([a-z]+)", 4, 1),), (Part("id", "identifier", r"id=\d", needs=("secret",)),)
    rows = [(5, text), (5, text), (5, "id=7"), (None, text)]
    settings = {"base": base, "weak": weak, "reach": 20}
    assert got(make([(i, t, "en", "a") for i, t in rows]), **settings) == want(rows, **settings)


def test_sql_on_made_texts(make, tmp_path):
    texts = [f"{KEY} {BLOB} https://x.example.com", "Token = 'abcdef' \n\n user=joe", None, "", f"é {HEX} login: me.too"]
    df = make([(i, t, "en", "a") for i, t in enumerate(texts)], clash=False)
    path = str(tmp_path / "in")
    df.coalesce(1).write.parquet(f"{path}/documents.parquet")
    found = QUERIES["op13_secret_links"].run(df.sparkSession, path).toPandas()
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
        said = db.sql(QUERIES["op13_secret_links"].sql).df()
    columns = list(said.columns)
    a, b = (x[columns].sort_values("doc_id", ignore_index=True) for x in (found, said))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_nothing(make):
    assert got(make([])) == []
