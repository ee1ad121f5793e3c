"""Line dedup that can be taken back: sharded cuckoo filters over exact reference counts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff.llm.common import BLANKS, power_of_two, query, shuffle_partitions, table
from tipoff.llm.textbytes import mix64
from tipoff.session import staged

SLOTS = 4
LOAD = 0.8
KICKS = 500
#: Columns that join a document with its dropped lines for a moment.
DROP_ID, DROP_KEYS = "__line_drop_id", "__line_drop_keys"


class Cuckoo:
    """A cuckoo filter: 16-bit fingerprints, four to a bucket, two buckets for each key.

    Numpy places all keys of a call in rounds: those that find room in one of their buckets are
    put there at once, the few others push fingerprints along one by one.
    """

    def __init__(self, cells: np.ndarray):
        self.cells = cells.reshape(-1, SLOTS)

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        buckets = power_of_two(max(1, int(keys / (SLOTS * LOAD)) + 1))
        return cls(np.zeros(buckets * SLOTS, np.uint16))

    def room(self) -> int:
        return int(self.cells.size * LOAD)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        spread = mix64(keys.astype(np.uint64))
        prints = (spread >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        mask = np.uint64(len(self.cells) - 1)
        one = spread & mask
        two = one ^ (mix64(prints.astype(np.uint64)) & mask)
        return prints, one.astype(np.int64), two.astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, one, two = self._places(keys)
        mine = prints[:, None]
        return (self.cells[one] == mine).any(axis=1) | (self.cells[two] == mine).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if a key found no place; the filter is then to be made anew, larger."""
        prints, one, two = self._places(keys)
        for turn in range(4):
            at = two if turn % 2 else one
            order = np.argsort(at, kind="stable")
            begin = np.searchsorted(at[order], at[order])
            rank = np.arange(len(order)) - begin
            rows = self.cells[at[order]]
            free = rows == 0
            spot = np.argmax(np.cumsum(free, axis=1) == (rank + 1)[:, None], axis=1)
            fits = free.sum(axis=1) > rank
            self.cells[at[order][fits], spot[fits]] = prints[order][fits]
            left = order[~fits]
            prints, one, two = prints[left], one[left], two[left]
        return all(self._push(int(p), int(a)) for p, a in zip(prints, one, strict=True))

    def _push(self, mark: int, at: int) -> bool:
        mask = np.uint64(len(self.cells) - 1)
        for kick in range(KICKS):
            row = self.cells[at]
            free = np.flatnonzero(row == 0)
            if len(free):
                row[free[0]] = mark
                return True
            spot = (kick * 7 + mark) % SLOTS
            mark, row[spot] = int(row[spot]), mark
            at ^= int(mix64(np.array([mark], np.uint64))[0] & mask)
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Take out one fingerprint for each key; every key must have been inserted."""
        prints, one, two = self._places(keys)
        for p, a, b in zip(prints, one, two, strict=True):
            for at in (a, b):
                spot = np.flatnonzero(self.cells[at] == p)
                if len(spot):
                    self.cells[at, spot[0]] = 0
                    break


def line_key(line: str) -> bytes:
    """A line without white space at its ends, A-Z in lower case."""
    return line.strip(BLANKS).encode("utf-8", "surrogatepass").lower()


def _digest(key: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(key, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _points(key: bytes) -> int:
    return len(key.decode("utf-8", "surrogatepass"))


def _key_rows(least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, k1, k2 = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                keys = {line_key(line) for line in (text or "").split("\n") if len(line) >= least}
                for a, b in (_digest(k) for k in keys if _points(k) >= least):
                    ids.append(doc_id)
                    k1.append(a)
                    k2.append(b)
            arrays = [pa.array(ids, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "k1", "k2"])

    return run


def _shard_pass(batches: Iterator[pa.RecordBatch], probe: bool) -> Iterator[pa.RecordBatch]:
    """Rows of a shard come in a row: its filter (kind 0), then keys to insert (1), delete (2) or probe (3).

    ``probe`` gives the probed rows that the filter may hold, else each shard's filter.
    """
    shard, cuckoo, full, grown = None, None, False, []

    def close() -> pa.RecordBatch:
        nonlocal cuckoo, full
        if grown:
            keys = np.concatenate(grown)
            if cuckoo is None:
                cuckoo = Cuckoo.sized(len(keys))
            if not full and not cuckoo.insert(keys):
                full = True  # the exact counts alone decide for this shard
        cells = None if full or cuckoo is None else cuckoo.cells.tobytes()
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([cells], pa.binary())], ["shard", "cells"])

    for batch in batches:
        shards, kinds = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
        k1 = batch.column("k1").fill_null(0).to_numpy().view(np.uint64)
        cut = np.flatnonzero(np.diff(shards) | np.diff(kinds)) + 1
        for a, b in zip([0, *cut], [*cut, len(shards)], strict=True):
            if a == b:
                continue
            if shards[a] != shard:
                if shard is not None and not probe:
                    yield close()
                shard, cuckoo, full, grown = int(shards[a]), None, False, []
            if kinds[a] == 0:
                for i in range(a, b):
                    cells = batch.column("cells")[i].as_py()
                    full = cells is None
                    cuckoo = None if full else Cuckoo(np.frombuffer(cells, np.uint16).copy())
            elif kinds[a] == 1:
                grown.append(k1[a:b])
            elif kinds[a] == 2:
                if cuckoo is not None:
                    cuckoo.delete(k1[a:b])
            else:
                hit = np.ones(b - a, bool) if full else np.zeros(b - a, bool)
                if cuckoo is not None:
                    hit = cuckoo.contains(k1[a:b])
                part = batch.slice(a, b - a).select(["doc_id", "k1", "k2"])
                yield part.filter(pa.array(hit))
    if shard is not None and not probe:
        yield close()


def _probe(batches):
    yield from _shard_pass(batches, True)


def _build(batches):
    yield from _shard_pass(batches, False)


@dataclass(frozen=True)
class LineIndex:
    """Which documents hold which lines, and which lines are held by many.

    holders  (doc_id, k1, k2): one row for each document and distinct key; k1, k2 are a 128-bit digest
    refs     (k1, k2, n_docs, top_doc): the exact reference count of each key and its largest holder
    filters  (shard, cells): for each shard of the keys a cuckoo filter of those with ``min_docs``
             holders or more

    All three are tables in the shared folder. ``insert`` and ``delete`` give a new index, so a
    batch of documents can be taken back: counts and filters are then those of the rest.
    """

    holders: DataFrame
    refs: DataFrame
    filters: DataFrame
    least: int
    min_docs: int
    shards: int

    @classmethod
    def empty(cls, spark: SparkSession, *, least: int = 40, min_docs: int = 5, shards: int | None = None) -> LineIndex:
        """Keys shorter than ``least`` code points are left out."""

        def none(**columns: str) -> DataFrame:
            fields = ", ".join(f"CAST(NULL AS {kind}) AS {name}" for name, kind in columns.items())
            return spark.sql(f"SELECT {fields} WHERE false")

        return cls(
            none(doc_id="long", k1="long", k2="long"),
            none(k1="long", k2="long", n_docs="long", top_doc="long"),
            none(shard="int", cells="binary"),
            least,
            min_docs,
            power_of_two(shards or max(64, shuffle_partitions(spark))),
        )

    def shard(self) -> Column:
        return F.pmod(F.col("k1"), F.lit(self.shards)).cast("int")

    def keys_of(self, docs: DataFrame) -> DataFrame:
        picked = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
        return picked.mapInArrow(_key_rows(self.least), "doc_id long, k1 long, k2 long")

    def _counted(self, holders: DataFrame) -> DataFrame:
        return holders.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("top_doc"))

    def _frequent(self, refs: DataFrame) -> DataFrame:
        return refs.where(F.col("n_docs") >= self.min_docs)

    def _refilter(self, refs: DataFrame) -> DataFrame:
        """Filters for ``refs``: deletes in place, and a filter that has no room left is built anew."""
        size = self._frequent(refs).groupBy(self.shard().alias("shard")).agg(F.count(F.lit(1)).alias("want"))
        room = F.octet_length("cells") / 2 * LOAD
        kept = self.filters.join(size, "shard").where(F.col("want") <= room).select("shard", "cells")
        before = self._frequent(self.refs).select("k1", "k2", self.shard().alias("shard"))
        now = self._frequent(refs).select("k1", "k2", self.shard().alias("shard"))
        fresh = now.join(kept.select("shard"), "shard", "left_anti")
        added = now.join(kept.select("shard"), "shard", "left_semi").join(before, ["k1", "k2", "shard"], "left_anti")
        lost = before.join(kept.select("shard"), "shard", "left_semi").join(now, ["k1", "k2", "shard"], "left_anti")
        rows = kept.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("k1"), "cells")
        for keys, kind in ((fresh, 1), (added, 1), (lost, 2)):
            rows = rows.unionByName(keys.select("shard", F.lit(kind).alias("kind"), "k1"), allowMissingColumns=True)
        dealt = rows.repartition("shard").sortWithinPartitions("shard", "kind")
        return staged(dealt.mapInArrow(_build, "shard int, cells binary"), "line-filters")

    def _news(self, found: DataFrame) -> DataFrame:
        """The rows of ``found`` that ``holders`` lacks; a null id is an id."""
        held = self.holders.select(F.col("doc_id").alias("held_id"), F.col("k1").alias("held_1"), F.col("k2").alias("held_2"))
        same = (found["k1"] == held["held_1"]) & (found["k2"] == held["held_2"]) & found["doc_id"].eqNullSafe(held["held_id"])
        return found.join(held, same, "left_anti")

    def insert(self, docs: DataFrame) -> LineIndex:
        """Add documents. What a document is known to hold already counts once, so that a batch that
        is tried again changes nothing; rows that share an id within one batch count each.
        """
        new = staged(self._news(self.keys_of(docs)), "line-holders")
        both = self.refs.unionByName(self._counted(new)).groupBy("k1", "k2")
        refs = staged(both.agg(F.sum("n_docs").alias("n_docs"), F.max("top_doc").alias("top_doc")), "line-refs")
        return replace(self, holders=self.holders.unionByName(new), refs=refs, filters=self._refilter(refs))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Take back documents by id. Only keys that they held are counted again."""
        gone = self.holders.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
        touched = gone.select("k1", "k2").distinct()
        holders = staged(self.holders.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti"), "line-holders")
        again = self._counted(holders.join(touched, ["k1", "k2"], "left_semi"))
        refs = staged(self.refs.join(touched, ["k1", "k2"], "left_anti").unionByName(again), "line-refs")
        return replace(self, holders=holders, refs=refs, filters=self._refilter(refs))

    def drops(self, holders: DataFrame | None = None) -> DataFrame:
        """(doc_id, keys): the frequent keys that a document holds and is not the largest holder of.

        Rows of a shard are dealt over several tasks, each with the shard's filter, so that a line
        that most documents hold is spread. What the filter lets through is held against the exact
        counts, which removes its false hits.
        """
        holders = self.holders if holders is None else holders
        salts = 16
        asked = holders.select(
            self.shard().alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"),
            F.lit(3).alias("kind"), "doc_id", "k1", "k2",
        )
        filters = self.filters.select(
            "shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), "cells"
        )
        rows = asked.unionByName(filters, allowMissingColumns=True)
        dealt = rows.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
        likely = dealt.drop("salt").mapInArrow(_probe, "doc_id long, k1 long, k2 long")
        known = self._frequent(self.refs).select("k1", "k2", "top_doc")
        sure = likely.join(known, ["k1", "k2"]).where(~F.col("doc_id").eqNullSafe(F.col("top_doc")))
        return sure.groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("keys"))


def _stays(text: str | None, keys: list | None, least: int) -> tuple[list[str], list[str]]:
    """All lines of a text, and those that stay."""
    lines = (text or "").split("\n")
    if not keys:
        return lines, lines
    gone = {(k["k1"], k["k2"]) for k in keys}

    def dropped(line: str) -> bool:
        if len(line) < least:
            return False
        key = line_key(line)
        return _points(key) >= least and _digest(key) in gone

    return lines, [line for line in lines if not dropped(line)]


def _cut_text(least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, keys in zip(batch.column("text").to_pylist(), batch.column(DROP_KEYS).to_pylist(), strict=True):
                lines, stay = _stays(text, keys, least)
                texts.append(text if len(stay) == len(lines) else "\n".join(stay))
            spot = batch.schema.get_field_index("text")
            rest = batch.set_column(spot, "text", pa.array(texts, pa.string()))
            yield rest.drop_columns([DROP_KEYS])

    return run


def _cut_digest(least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, dropped, digests = [], [], []
            for text, keys in zip(batch.column("text").to_pylist(), batch.column(DROP_KEYS).to_pylist(), strict=True):
                lines, stay = _stays(text, keys, least)
                counts.append(len(lines))
                dropped.append(len(lines) - len(stay))
                digests.append(hashlib.sha256("\n".join(stay).encode("utf-8", "surrogatepass")).hexdigest())
            arrays = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return run


def _with_drops(docs: DataFrame, index: LineIndex) -> DataFrame:
    drops = index.drops().select(F.col("doc_id").alias(DROP_ID), F.col("keys").alias(DROP_KEYS))
    return docs.join(drops, docs["doc_id"].cast("long").eqNullSafe(F.col(DROP_ID)), "left").drop(DROP_ID)


def drop_lines(docs: DataFrame, index: LineIndex) -> DataFrame:
    """The documents, all columns, with the lines that the index drops taken out of ``text``.

    The text of a document that loses nothing stays as it is, null included; one that loses all its
    lines becomes empty. Rows that share an id are cut alike.
    """
    return _with_drops(docs, index).mapInArrow(_cut_text(index.least), docs.schema)


def line_digests(docs: DataFrame, index: LineIndex) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of what ``drop_lines`` leaves; null is one empty line."""
    picked = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"
    return _with_drops(picked, index).mapInArrow(_cut_digest(index.least), schema)


@query(
    "op9_line_dedup",
    r"""
    WITH l AS (
        SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                     generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
    k AS (SELECT key, max(doc_id) AS top FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
    FROM (SELECT l.*, k.key IS NOT NULL AND doc_id <> top AS gone FROM l LEFT JOIN k ON l.key = k.key)
    GROUP BY doc_id
    """,
)
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_digests(docs, LineIndex.empty(spark).insert(docs))
