"""Spelling variants: words one letter apart, found by pairs of trie nodes."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipoff.llm.common import query, settle, table

#: A run of letters, after A-Z are lower-cased.
RUN = r"[a-zÀ-ÿ]"
NODE_BYTES = 16
#: Distinct words that a task counts before it hands them on.
MOST_WORDS = 300_000
#: Every form is at least twice as frequent as its word, so a chain of forms in 64-bit counts is
#: shorter than 2 to the power of this.
DOUBLINGS = 6


def damaged(run: str, doc_id: str, every: int) -> str:
    """``run`` without one letter, if the hash of document and run says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    at = h % len(run)
    return run[:at] + run[at + 1 :] if h % every == 0 else run


def _counter(least: int, every: int) -> Callable:
    runs = re.compile(f"{RUN}{{{least},}}")

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if not text.is_valid:
                    continue
                # Lower-casing bytes leaves all letters but A-Z alone.
                found = Counter(runs.findall(text.as_buffer().to_pybytes().lower().decode()))
                for word, n in found.items():
                    result = damaged(word, "" if doc_id is None else doc_id, every) if every else word
                    if len(result) >= least:
                        counts[result] += n
                if len(counts) > MOST_WORDS:
                    yield batch_of(counts)
                    counts.clear()
        yield batch_of(counts)

    return run


def word_counts(docs: DataFrame, *, id_col: str, text_col: str, least: int, every: int) -> DataFrame:
    """(word, n) over all texts; counted in tasks first."""
    picked = docs.select(docs[id_col].cast("string").alias("doc_id"), docs[text_col].alias("text"))
    return picked.mapInArrow(_counter(least, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def path_numbers(word: str) -> list[bytes]:
    """The numbers of the trie nodes on a word's path, the root's first.

    A node's 128-bit number is made from the letters that lead to it, one more than its parent's, so
    tasks number the same node alike without sharing a trie. That two of m nodes have one number has
    the chance m * m / 2**129: below 1e-12 for 10**13 nodes.
    """
    state = hashlib.blake2b(digest_size=NODE_BYTES)
    out = [state.digest()]
    for letter in word:
        state.update(letter.encode())
        out.append(state.digest())
    return out


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (prefix node, suffix node) of each word: around each letter, and around each gap.

    ``first`` marks the first of a run of equal letters: leaving out any of them gives one word.
    """

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.binary(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
        arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["pair", "word", "n", "gap", "first"])

    rows: list[tuple] = []
    for batch in batches:
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            before, after = path_numbers(word), path_numbers(word[::-1])[::-1]
            for i, letter in enumerate(word):
                rows.append((before[i] + after[i + 1], word, n, False, not i or word[i - 1] != letter))
                if len(rows) >= 20_000:
                    yield batch_of(rows)
                    rows = []
            for i in range(len(word) + 1):
                rows.append((before[i] + after[i], word, n, True, False))
            if len(rows) >= 20_000:
                yield batch_of(rows)
                rows = []
    if rows:
        yield batch_of(rows)


def _ranked(n: str, word: str) -> Column:
    """Least for the largest count, then for the smallest word."""
    return F.struct((-F.col(n)).alias("less"), F.col(word).alias("word"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best) for words that have near ones; ``best`` is (-n, word) of the first of them.

    Words of one pair around a letter differ in that letter only; the word of the same pair around a
    gap is theirs without it. The letter's alphabet bounds a pair's words, so they are held as a list
    and answered for at once: how many are near, and the best of the others. A word with a letter
    left out is counted at the first of equal letters, so no near word counts twice.
    """
    pairs = words.mapInArrow(_pairs, "pair binary, word string, n long, gap boolean, first boolean")
    ranked = F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"), F.col("first").alias("first"))
    held = (
        pairs.groupBy("pair")
        .agg(
            F.array_sort(F.collect_list(F.when(~F.col("gap"), ranked))).alias("skips"),
            # Prefix and suffix spell the word, so a pair has one word around its gap.
            F.min(F.when(F.col("gap"), _ranked("n", "word"))).alias("gap"),
        )
        .where("size(skips) + IF(gap IS NULL, 0, 1) > 1 AND size(skips) > 0")
        .withColumn("firsts", F.expr("filter(skips, s -> s.first)"))
    )
    from_skips = F.expr(
        """transform(skips, (s, i) -> named_struct(
             'word', s.word,
             'near', CAST(size(skips) - 1 + IF(s.first AND gap IS NOT NULL, 1, 0) AS LONG),
             'best', least(
               IF(size(skips) = 1, NULL, named_struct('less', skips[IF(i = 0, 1, 0)].less, 'word', skips[IF(i = 0, 1, 0)].word)),
               IF(s.first, gap, NULL))))"""
    )
    from_gap = F.expr(
        """IF(gap IS NULL OR size(firsts) = 0, array(), array(named_struct(
             'word', gap.word,
             'near', CAST(size(firsts) AS LONG),
             'best', named_struct('less', firsts[0].less, 'word', firsts[0].word))))"""
    )
    said = held.select(F.explode(F.concat(from_skips, from_gap)).alias("x")).select("x.*").where("near > 0")
    return said.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(words: DataFrame) -> DataFrame:
    """(word, root) of words with a form: where their forms lead in the end.

    Each round doubles the steps. Forms are more frequent by a factor, so rounds are few and known.
    """
    paths = settle(words.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "variant-paths")
    for _ in range(DOUBLINGS):
        onward = paths.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = paths.join(onward, "root", "left")
        paths = settle(step.select("word", F.coalesce("further", "root").alias("root")), "variant-paths")
    return paths


def group_variants(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_letters: int = 6,
    least_count: int = 5,
    factor: int = 5,
    damage_every: int = 0,
) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    Words are runs of letters, A-Z lower-cased, with ``least_letters`` code points found
    ``least_count`` times. Near words differ by one letter inserted, deleted or replaced. A word's
    form is its near word of largest n (ties: smallest), if that is ``factor`` times its own n; root is
    the end of its forms, the word itself without one. With ``damage_every``, a run of a document
    loses a letter if that number divides the checksum of both.

    Null and empty texts have no words; a null id is written as nothing. Rows that repeat count as
    often as they come. Long texts are counted whole, one at a time. Extra columns are ignored, an
    empty table gives an empty result.
    """
    if factor < 2:
        raise ValueError("a form must be at least twice as frequent as its word")
    counted = word_counts(docs, id_col=id_col, text_col=text_col, least=least_letters, every=damage_every)
    words = settle(counted.where(F.col("n") >= least_count), "variant-words")
    near = near_words(words)
    formed = words.join(near, "word", "left").withColumn("is_form", -F.col("best.less") >= factor * F.col("n"))
    formed = settle(
        formed.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(F.col("is_form"), F.col("best.word")).alias("form"),
            F.when(F.col("is_form"), -F.col("best.less")).alias("form_n"),
        ),
        "variant-forms",
    )
    return formed.join(roots(formed), "word", "left").withColumn("root", F.coalesce("root", "word"))


#: Leaves a letter out as ``damaged`` does. DuckDB has no crc32, so its table is made here.
SQL = """
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, i::UBIGINT AS c FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM bits WHERE k < 8
),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents
),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (
  SELECT doc_id, run, n, encode(coalesce(doc_id::VARCHAR, '') || ':' || run) AS b FROM counted
),
hashed AS (
  SELECT doc_id, run, n,
         xor(list_reduce(
           list_prepend(4294967295::UBIGINT,
             list_transform(range(octet_length(b)), lambda i: ('0x' || substr(hex(b), 2 * i::INT + 1, 2))::UBIGINT)),
           lambda h, x: xor(h >> 8, t[xor(h & 255, x)::INT + 1])), 4294967295::UBIGINT) AS h
  FROM bytes, crc
),
words AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 199 = 0
                    THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
                    ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
),
skips AS (
  SELECT word, n, left(word, i::INT) AS p, substr(word, i::INT + 2) AS s
  FROM words, LATERAL (SELECT unnest(range(length(word))) AS i)
),
near AS (
  SELECT a.word, b.word AS other, b.n FROM skips a JOIN skips b ON a.p = b.p AND a.s = b.s AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM skips a JOIN words b ON a.p || a.s = b.word
  UNION
  SELECT b.word, a.word, a.n FROM skips a JOIN words b ON a.p || a.s = b.word
),
formed AS (
  SELECT w.word, w.n, coalesce(g.n_near, 0) AS n_near,
         CASE WHEN g.best_n >= 5 * w.n THEN g.best END AS form,
         CASE WHEN g.best_n >= 5 * w.n THEN g.best_n END AS form_n
  FROM words w LEFT JOIN (
    SELECT word, count(*) AS n_near, max(n) AS best_n, (list(other ORDER BY n DESC, other))[1] AS best
    FROM near GROUP BY word) g ON g.word = w.word
),
chain AS (
  SELECT word, word AS at FROM formed
  UNION ALL
  SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM formed f
JOIN chain c ON c.word = f.word
JOIN formed e ON e.word = c.at AND e.form IS NULL
"""


@query("op12_spelling_variants", SQL)
def op12(spark, sf_dir):
    found = group_variants(table(spark, sf_dir, "documents"), damage_every=199)
    return found.select("word", "form", "root", "n", "n_near", "form_n")
