"""Secret scans: parts of credentials, and weak ones linked by what stands near them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipoff.llm.common import query, settle, table


def either_case(letters: str) -> str:
    """A pattern of ASCII letters in either case; other characters are kept."""
    return "".join(f"[{c.upper()}{c}]" if c.isascii() and c.isalpha() else c for c in letters)


def named(words: str, value: str) -> str:
    """``word = "value"`` and its relatives."""
    return rf"({either_case(words)})[\"']?\x20*[:=]\x20*[\"']?({value})"


@dataclass(frozen=True)
class Part:
    """A kind of part: what it is in a credential, how it is found, and whether it counts by itself.

    ``least`` is the least length of the span, or of group ``group``. A weak part needs a part of each
    role in ``needs`` in its scope. All patterns of ``also`` must be found in a match.
    """

    kind: str
    role: str
    pattern: str
    least: int = 1
    group: int = 0
    needs: tuple[str, ...] = ()
    also: tuple[str, ...] = ()


# Kinds and patterns of the parts that count by themselves. A run of letters that is
# too short is left out by the pattern, as nothing can start inside it and be longer.
BASE = (
    Part("assign", "secret", named("password|passwd|secret|token|api_?key", r"[A-Za-z0-9+/_.=-]+"), 6, 2),
    Part("access", "identifier", r"AKIA[A-Z0-9]{16,}"),
    Part("hex", "secret", r"[0-9a-f]{24,}"),
)
#: Parts that are reported only beside their complements.
WEAK = (
    Part(
        "user", "identifier", named("client_?id|access_?key_?id|account_?name|user_?name|user|login", r"[A-Za-z0-9._@+-]+"), 3, 2,
        needs=("secret",),
    ),
    Part(
        "blob", "secret", r"[A-Za-z0-9+/_-]{28,}={0,2}",
        needs=("identifier",), also=("[0-9]", "[a-z]", "[A-Z]"),
    ),
    Part(
        "endpoint", "endpoint",
        r"(?:https?|s3|sb|amqps?|postgres|postgresql|mysql|mongodb|redis|ftps?|ssh)://[^\x20\x09-\x0D\"'<>]+", 8,
        needs=("identifier", "secret"),
    ),
)
ROLES = ("identifier", "secret", "endpoint")
#: A scope ends at a blank line.
BREAK = r"\n[\x20\x09\r]*\n"
SPAN = "struct<kind: int, start: long, end: long>"


def spans_of(text: str, pattern: re.Pattern, part: Part) -> Iterator[tuple[int, int]]:
    """(start, end) of the matches that are long enough, in code points."""
    for m in pattern.finditer(text):
        if len(m[part.group]) >= part.least and (not part.also or all(re.search(c, m[0]) for c in part.also)):
            yield m.span()


def _finder(base: tuple[Part, ...], weak: tuple[Part, ...]) -> Callable:
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    def find(text: str, parts: list[tuple[int, re.Pattern, Part]]) -> list[dict]:
        return [{"kind": i, "start": a, "end": b} for i, pattern, p in parts for a, b in spans_of(text, pattern, p)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [(i, re.compile(p.pattern), p) for i, p in enumerate((*base, *weak, Part("break", "", BREAK)))]
        first, rest, breaks = every[: len(base)], every[len(base) : -1], every[-1:]
        for batch in batches:
            strong, other = [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                strong.append(sorted(find(text, first), key=lambda s: (s["start"], s["kind"])))
                found = find(text, rest)
                # A text without weak parts has nothing to link, so its scopes do not matter.
                other.append(found + find(text, breaks) if found else [])
            arrays = [batch.column("of"), batch.column("mark"), pa.array(strong, kind), pa.array(other, kind)]
            yield pa.RecordBatch.from_arrays(arrays, ["of", "mark", "base", "weak"])

    return run


def label(parts: tuple[Part, ...], found: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    names = F.array(*(F.lit(p.kind) for p in parts))
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def in_order(found: Column) -> Column:
    keyed = F.transform(found, lambda s: F.struct(s["start"], s["kind"], s["end"]))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"], s["start"], s["end"]))


def candidates(found: DataFrame, parts: tuple[Part, ...], n_strong: int) -> DataFrame:
    """(of, mark, scope, kind, start, end) of all parts of texts that have a weak one.

    Scopes are counted by the breaks before a part. A weak part inside a strong one is a part of that
    and left out. Rows of one text are ordered for it; a text is the only group.
    """
    weak = F.exists("weak", lambda s: s["kind"] < len(parts))
    rows = found.where(weak).select("of", "mark", F.explode(F.concat("base", "weak")).alias("s")).distinct()
    rows = rows.select("of", "mark", F.col("s.kind").alias("kind"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    order = "PARTITION BY of, mark ORDER BY start, kind, end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    placed = rows.select(
        "*",
        F.expr(f"count_if(kind = {len(parts)}) OVER ({order})").alias("scope"),
        F.expr(f"max(IF(kind < {n_strong}, end, -1)) OVER ({order})").alias("covered"),
    )
    return placed.where(f"kind < {len(parts)} AND (kind < {n_strong} OR end > covered)").drop("covered")


def linked(rows: DataFrame, parts: tuple[Part, ...], n_strong: int, reach: int) -> DataFrame:
    """The weak rows of ``candidates`` that stand within ``reach`` of all their complements.

    An interval join: a weak part's interval, ``reach`` wider on both sides, and the other parts'
    intervals are dealt to cells of ``reach`` code points and meet in their scope and cell. A cell has
    room for few parts, so it forms few pairs, however long the text.
    """
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / reach), F.floor(high / reach))).alias("cell")
    roles = F.array(*(F.lit(ROLES.index(p.role)) for p in parts))
    needs = F.array(*(F.lit(sum(1 << ROLES.index(r) for r in p.needs)) for p in parts))
    low, high = F.greatest(F.col("start") - reach, F.lit(0)), F.col("end") + reach
    ask = rows.where(f"kind >= {n_strong}").select("*", low.alias("low"), high.alias("high")).select("*", cells(F.col("low"), F.col("high")))
    give = rows.select(
        F.col("of").alias("of2"), F.col("mark").alias("mark2"), F.col("scope").alias("scope2"),
        F.get(roles, F.col("kind")).alias("role"), F.col("start").alias("a"), F.col("end").alias("b"),
        cells(F.col("start"), F.col("end")),
    ).withColumnRenamed("cell", "cell2")
    meet = (
        F.col("of").eqNullSafe(F.col("of2")) & (F.col("mark") == F.col("mark2")) & (F.col("scope") == F.col("scope2"))
        & (F.col("cell") == F.col("cell2")) & (F.col("a") <= F.col("high")) & (F.col("b") >= F.col("low"))
    )
    met = ask.join(give, meet).groupBy("of", "mark", "kind", "start", "end")
    had = met.agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("role"))).alias("had"))
    need = F.get(needs, F.col("kind"))
    return had.where(F.col("had").bitwiseAND(need) == need).select("of", "mark", "kind", "start", "end")


def scan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: tuple[Part, ...] = BASE,
    weak: tuple[Part, ...] = WEAK,
    reach: int = 400,
) -> DataFrame:
    """One row per document: doc_id, base and linked, both arrays of (kind, start, end) by start and kind.

    ``kind`` counts through ``base`` and then ``weak``; places are code points, the end excluded. Base
    parts are found by themselves: all matches of their pattern that are long enough. Weak ones are
    reported where parts of all roles that complete them lie in the same scope, text without a blank
    line, at most ``reach`` away. Any part can complete another, weak ones too.

    Texts are read once and not shuffled. Only parts of texts that have a weak one are joined. A null
    or empty text has no parts. A null id stays null, rows that repeat are scanned alike and all stay.
    Long texts are one row, and their parts are spread over tasks by scope and cell. Extra columns are
    ignored, an empty table gives an empty result. Texts of one document id are told apart by a
    64-bit hash.
    """
    parts = (*base, *weak)
    none = F.array().cast(f"array<{SPAN}>")
    picked = docs.select(docs[id_col].cast("long").alias("of"), docs[text_col].alias("text"))
    picked = picked.select("of", F.xxhash64("text").alias("mark"), "text")
    schema = f"of long, mark long, base array<{SPAN}>, weak array<{SPAN}>"
    found = settle(picked.mapInArrow(_finder(base, weak), schema), "secret-parts")
    rows = settle(candidates(found, parts, len(base)), "secret-candidates")
    held = linked(rows, parts, len(base), reach).select(
        F.col("of").alias("of2"), F.col("mark").alias("mark2"), F.struct("kind", "start", "end").alias("s")
    )
    held = held.groupBy("of2", "mark2").agg(F.collect_list("s").alias("linked"))
    same = F.col("of").eqNullSafe(F.col("of2")) & (F.col("mark") == F.col("mark2"))
    return found.join(held, same, "left").select(
        F.col("of").alias("doc_id"), "base", in_order(F.coalesce("linked", none)).alias("linked")
    )


def _sql(base: tuple[Part, ...], weak: tuple[Part, ...], reach: int) -> str:
    """The same scan in DuckDB's SQL: matches and gaps in turn, then an interval join in scopes."""
    parts, selects = (*base, *weak), []
    for i, p in enumerate((*parts, Part("break", "", BREAK))):
        pattern = p.pattern.replace("'", "''")
        also = "".join(f" AND regexp_matches(m, '{c}')" for c in p.also)
        selects.append(f"""
  SELECT doc_id, {i} AS kind, place AS start, place + length(m) AS stop FROM (
    SELECT doc_id, m, held,
           sum(length(gap) + length(before)) OVER (PARTITION BY doc_id ORDER BY k) AS place
    FROM (SELECT doc_id, k, gaps[k] AS gap, found[k] AS m, held[k] AS held,
                 CASE WHEN k = 1 THEN '' ELSE found[k - 1] END AS before
          FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}', 0) AS found,
                       regexp_extract_all(text, '{pattern}', {p.group}) AS held FROM documents),
               LATERAL (SELECT unnest(range(1, len(found) + 1)) AS k)))
  WHERE length(held) >= {p.least} {also}""")
    role = "CASE kind " + " ".join(f"WHEN {i} THEN '{p.role}'" for i, p in enumerate(parts)) + " END"
    name = "CASE kind " + " ".join(f"WHEN {i} THEN '{p.kind}'" for i, p in enumerate(parts)) + " END"
    needs = " OR ".join(
        f"(kind = {i} AND " + " AND ".join(f"list_contains(roles, '{r}')" for r in p.needs) + ")"
        for i, p in enumerate(weak, start=len(base))
    )
    n, strong = len(parts), len(base)
    order = "PARTITION BY doc_id ORDER BY start, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    said = f"string_agg({name} || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    counts = ", ".join(f"count(*) FILTER (kind = {i}) AS n_{p.kind}" for i, p in enumerate(base))
    zeros = ", ".join(f"coalesce(n_{p.kind}, 0) AS n_{p.kind}" for p in base)
    return f"""
WITH found AS ({" UNION ALL ".join(selects)}),
placed AS (
  SELECT *, count(*) FILTER (kind = {n}) OVER ({order}) AS scope,
         max(CASE WHEN kind < {strong} THEN stop ELSE -1 END) OVER ({order}) AS covered
  FROM found
),
parts AS (
  SELECT doc_id, kind, start, stop, scope, {role} AS role FROM placed WHERE kind < {strong} OR (kind < {n} AND stop > covered)
),
met AS (
  SELECT w.doc_id, w.kind, w.start, w.stop, list(DISTINCT q.role) AS roles
  FROM parts w JOIN parts q ON w.doc_id = q.doc_id AND w.scope = q.scope
    AND q.start <= w.stop + {reach} AND q.stop >= greatest(w.start - {reach}, 0)
  WHERE w.kind >= {strong} GROUP BY ALL
),
spans AS (
  SELECT doc_id, kind, start, stop FROM parts WHERE kind < {strong}
  UNION ALL
  SELECT doc_id, kind, start, stop FROM met WHERE {needs}
),
told AS (
  SELECT doc_id, {counts},
         {said} FILTER (kind < {strong}) AS base, {said} AS spans
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN told t ON t.doc_id = d.doc_id
"""


@query("op13_secret_links", _sql(BASE, WEAK, 400))
def op13(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = {i})) AS LONG)").alias(f"n_{p.kind}") for i, p in enumerate(BASE)]
    said = label((*BASE, *WEAK), in_order(F.concat("base", "linked")))
    return found.select("doc_id", *counts, F.sha2(label(BASE, F.col("base")), 256).alias("base_sha256"), said.alias("spans"))
