"""Near duplicates: a Jaccard join over word shingles with a tree of count vectors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipoff.llm.common import query, settle, table, whole
from tipoff.llm.graph import components
from tipoff.llm.textbytes import SpanHash, Words, mix64, raw, slices, windows

GROUPS = 64
LEAF = 32
ELEMENT_BITS = 48


@dataclass(frozen=True)
class Bound:
    """Documents link when 100 * intersection >= percent * union."""

    percent: int = 80
    growth: float = 1.4

    def shared(self, sizes: np.ndarray) -> np.ndarray:
        """The least intersection of two linked sets whose sizes add up to ``sizes``."""
        return -(-self.percent * sizes // (100 + self.percent))

    def linked(self, both, sizes):
        return 100 * both >= self.percent * (sizes - both)

    def rare(self, n):
        """How many of the first elements of a set of ``n``, in any order that all sets share, linked
        sets cannot do without: if none of them is among the same many first ones of the other set,
        too few are left to link."""
        return n - -(-n * self.percent // 100) + 1

    @property
    def counted(self) -> float:
        """The part of all elements that is ordered by how many sets hold it, before the others: two
        and a half times what ``rare`` takes of a set, so that it is to be found there and the more
        frequent elements are still left behind."""
        return min(1.0, 2.5 * (100 - self.percent) / 100)

    @cached_property
    def smallest(self) -> int:
        """Sets below this size link only with equal ones."""
        n = 1
        while 100 * n < self.percent * (n + 1):
            n += 1
        return n

    def cells(self, n: Column) -> Column:
        """The cells of sizes that a set of ``n`` elements belongs to: its own, and the one of the
        smallest set it links with. A cell is no narrower than the sizes of two linked sets are
        apart, so they have a cell in common, whatever their sizes."""
        width = math.log(max(100 / self.percent, 1.01)) * (1 + 1e-9)
        least = F.floor((n * self.percent + 99) / 100)
        return F.array_distinct(F.array(*(F.floor(F.log(size.cast("double")) / width) for size in (n, least))))

    def bands(self, largest: int) -> np.ndarray:
        edges = [self.smallest]
        while edges[-1] <= largest:
            edges.append(max(edges[-1] + 1, int(edges[-1] * self.growth)))
        return np.array(edges)

    def zones(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each band how many zones sets are cut into, and how many may be empty.

        The smaller set of a linked pair lies in the band. The two differ in at most ``apart``
        elements, which touch as many zones at most; so with ``apart`` + 1 + spare zones, at least
        spare + 1 zones are equal, and one of these is not empty in a set with up to spare empty ones.
        """
        small = edges[1:] - 1
        sizes = small + small * 100 // self.percent
        apart = sizes - 2 * self.shared(sizes)
        spare = np.array([_spare(int(a) + 1, int(low)) for a, low in zip(apart, edges[:-1], strict=True)])
        return apart + 1 + spare, spare


@lru_cache(maxsize=4096)
def _spare(zones: int, size: int) -> int:
    """How many zones to add so that few sets of ``size`` elements have more empty ones than that.

    More zones are smaller, and more of them empty: the first number is taken that leaves less than
    one set in 100, or else the one that leaves the fewest. Empty zones are counted as Poisson.
    """
    best = (1.0, 1)
    for spare in range(1, 400):
        rate = (zones + spare) * math.exp(-size / (zones + spare))
        term = total = math.exp(-rate)
        for k in range(1, spare + 1):
            term *= rate / k
            total += term
        if 1 - total < 0.01:
            return spare
        best = min(best, (1 - total, spare))
    return best[1]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, hasher: SpanHash, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text: their owners and 48-bit hashes, sorted by both.

    A text of fewer than ``width`` words, but one at least, has its whole sequence as its only one.
    """
    words = Words(data, offsets)
    hashes, owner = hasher.load(data).spans(words.starts, words.ends), words.owner()
    shingles, first = windows(hashes, owner, width)
    parts, owners = [shingles], [owner[first]]
    for n in range(1, width):
        few = words.counts[owner] == n
        whole_text, first = windows(hashes[few], owner[few], n)
        parts.append(mix64(whole_text + np.uint64(n)))
        owners.append(owner[few][first])
    shift = np.uint64(ELEMENT_BITS)
    key = (np.concatenate(owners).astype(np.uint64) << shift) | (np.concatenate(parts) >> np.uint64(64 - ELEMENT_BITS))
    key = np.sort(key)
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return (key >> shift).astype(np.int64), key & np.uint64((1 << ELEMENT_BITS) - 1)


def _add(slots: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    np.add.at(out, slots, values)
    return out


def zone_keys(owner: np.ndarray, elements: np.ndarray, sizes: np.ndarray, bound: Bound, take: np.ndarray):
    """Keys of the texts in ``take``: (text, key). Linked sets that differ share a key.

    A set is cut into the zones of its own size band, and of lower bands that can hold a smaller
    partner. A key stands for the elements of one zone. A set with more empty zones than the band
    allows for gets, besides, the key of all such sets.
    """
    edges = bound.bands(int(sizes.max(initial=0)))
    if len(edges) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    zones, spare = bound.zones(edges)
    home = np.searchsorted(edges, sizes, side="right") - 1
    least = -(-sizes * bound.percent // 100)
    spread = mix64(elements)
    texts, keys = [], []
    for back in range(len(edges)):
        band = home - back
        ok = take & (home >= 0) & (band >= 0)
        ok[ok] = (back == 0) | (edges[band[ok] + 1] - 1 >= least[ok])
        if not ok.any():
            break
        who = np.flatnonzero(ok)
        k = zones[band[who]]
        base = np.cumsum(k) - k
        rank = np.full(len(sizes), -1)
        rank[who] = np.arange(len(who))
        mine = np.flatnonzero(rank[owner] >= 0)
        r = rank[owner[mine]]
        zone = ((elements[mine] & np.uint64(0xFFFFFFFF)) * k[r].astype(np.uint64)) >> np.uint64(32)
        slot = base[r] + zone.astype(np.int64)
        n = int(k.sum())
        content, filled = _add(slot, spread[mine], n), np.bincount(slot, minlength=n) > 0
        text = np.repeat(who, k)
        number = np.arange(n) - np.repeat(base, k)
        seed = mix64((band[text] * 1_000_003 + number).astype(np.uint64))
        texts.append(text[filled])
        keys.append(mix64(content + seed)[filled])
        empty = k - np.add.reduceat(filled, base)
        odd = who[empty > spare[band[who]]]
        texts.append(odd)
        keys.append(mix64((band[odd] + 77).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return np.concatenate(texts), np.concatenate(keys)


def _set_hash(owner: np.ndarray, elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = _add(owner, mix64(elements + np.uint64(0x51ED270B)), len(sizes))
    return mix64(total + sizes.astype(np.uint64)).view(np.int64)


def _lists(text: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """Values as a list for each of n texts."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[np.argsort(text, kind="stable")]))


def _sketches(width: int, bound: Bound) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash(5, lower=True)
        for batch in batches:
            for piece in slices(batch, "text"):
                owner, elements = shingle_sets(*raw(piece.column("text")), hasher, width)
                sizes = np.bincount(owner, minlength=piece.num_rows)
                node = _set_hash(owner, elements, sizes)
                # Equal sets have equal keys: one of them brings the keys for all.
                take = np.zeros(len(sizes), bool)
                take[np.unique(node, return_index=True)[1]] = True
                text, key = zone_keys(owner, elements, sizes, bound, take)
                # Of the sets of a piece that share a key, one brings it, the others link to that one.
                _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
                holder = text[first[inverse]]
                brings = np.zeros(len(key), bool)
                brings[first] = True
                keys = _lists(text[brings], key[brings].view(np.int64), len(sizes))
                pairs = np.unique(np.stack([text, holder])[:, text != holder], axis=1)
                links = _lists(pairs[0], node[pairs[1]], len(sizes))
                arrays = [piece.column("doc_id"), piece.column("ref"), pa.array(node), pa.array(sizes, pa.int64()), keys, links]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ref", "node", "n_shingles", "keys", "links"])

    return run


def _packed(elements: np.ndarray) -> bytes:
    """Elements at ELEMENT_BITS each, the upper bytes left out."""
    return elements.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : ELEMENT_BITS // 8].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) * 8 // ELEMENT_BITS, 8), np.uint8)
    out[:, : ELEMENT_BITS // 8] = np.frombuffer(data, np.uint8).reshape(-1, ELEMENT_BITS // 8)
    return out.view("<u8").ravel()


def _sets(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash(5, lower=True)
        for batch in batches:
            for piece in slices(batch, "text"):
                owner, elements = shingle_sets(*raw(piece.column("text")), hasher, width)
                begin = np.searchsorted(owner, np.arange(piece.num_rows + 1))
                sets = [_packed(elements[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
                rest = piece.drop_columns(["text"])
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(sets, pa.binary())], [*rest.schema.names, "elements"])

    return run


class CountTree:
    """A tree over count vectors. Leaves hold points of like size; a node keeps the largest count
    of each coordinate, so a query's overlap with any of its points is at most the sum of the
    smaller coordinates of the two, and whole nodes are passed over."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        half = counts[:, : GROUPS // 2].sum(axis=1)
        self.order = np.lexsort((half, sizes))
        self.counts, self.sizes = counts[self.order], sizes[self.order]
        self.levels = []
        tops, least = self.counts, self.sizes
        while len(tops) > LEAF or not self.levels:
            cut = np.arange(0, len(tops), LEAF)
            tops, least = np.maximum.reduceat(tops, cut, axis=0), np.minimum.reduceat(least, cut)
            self.levels.append((tops, least))

    def near(self, counts: np.ndarray, size: int, bound: Bound) -> np.ndarray:
        """Points whose bound on the overlap reaches what a link needs."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            tops, least = self.levels[depth]
            overlap = np.minimum(tops[at], counts).sum(axis=1, dtype=np.int64)
            at = at[overlap >= bound.shared(least[at] + size)]
            below = len(self.levels[depth - 1][0]) if depth else len(self.sizes)
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < below]
        overlap = np.minimum(self.counts[at], counts).sum(axis=1, dtype=np.int64)
        return self.order[at[overlap >= bound.shared(self.sizes[at] + size)]]


def link_block(nodes: np.ndarray, sets: list[np.ndarray], core: np.ndarray, home: np.ndarray, bound: Bound) -> list[tuple[int, int]]:
    """Links between the members of a block that join its components: a forest, not all pairs.

    Core members are known to be linked with each other through their pivot and are not compared
    among themselves. Members that only visit are compared with those at home.
    """
    n = len(nodes)
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    cores = np.flatnonzero(core)
    for i in cores[1:]:
        parent[find(int(i))] = find(int(cores[0]))
    sizes = np.array([len(s) for s in sets])
    counts = np.array([np.bincount(s & np.uint64(GROUPS - 1), minlength=GROUPS) for s in sets]).astype(np.int32)
    tree = CountTree(counts, sizes) if n > LEAF else None
    for i in np.flatnonzero(~core).tolist():
        if tree is None:
            overlap = np.minimum(counts, counts[i]).sum(axis=1)
            near = np.flatnonzero(overlap >= bound.shared(sizes + sizes[i]))
        else:
            near = tree.near(counts[i], int(sizes[i]), bound)
        for j in near.tolist():
            if i == j or not (home[i] or home[j]) or (not core[j] and home[i] and home[j] and j < i) or find(i) == find(j):
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if bound.linked(both, int(sizes[i] + sizes[j])):
                links.append((int(nodes[i]), int(nodes[j])))
                parent[find(i)] = find(j)
    return links


def _block_links(bound: Bound) -> Callable:
    """Rows come sorted by (super, block); each such block is linked on its own."""

    def link(block: pa.Table) -> pa.RecordBatch:
        node = block.column("node").to_numpy()
        first = np.sort(np.unique(node, return_index=True)[1])
        sets = [_unpacked(block.column("elements")[int(i)].as_py()) for i in first]
        core, home = (block.column(c).to_numpy(zero_copy_only=False)[first].astype(bool) for c in ("core", "home"))
        links = link_block(node[first], sets, core, home, bound) if len(first) > 1 else []
        return pa.RecordBatch.from_arrays(
            [pa.array([u for u, _ in links], pa.int64()), pa.array([v for _, v in links], pa.int64())], ["u", "v"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            group = [batch.column(c).to_numpy() for c in ("super", "block")]
            cut = np.flatnonzero((np.diff(group[0]) != 0) | (np.diff(group[1]) != 0)) + 1
            for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                piece = batch.slice(a, b - a)
                if waiting and any(waiting[-1].column(c)[0] != piece.column(c)[0] for c in ("super", "block")):
                    yield link(pa.Table.from_batches(waiting))
                    waiting = []
                if piece.num_rows:
                    waiting.append(piece)
        if waiting:
            yield link(pa.Table.from_batches(waiting))

    return run


def _against_pivot(bound: Bound) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            core = []
            for mine, pivot in zip(batch.column("elements"), batch.column("pivot_elements"), strict=True):
                a, b = _unpacked(mine.as_py()), _unpacked(pivot.as_py())
                core.append(bool(bound.linked(len(np.intersect1d(a, b, assume_unique=True)), len(a) + len(b))))
            rest = batch.drop_columns(["pivot_elements"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(core)], [*rest.schema.names, "core"])

    return run


def _element_keys(bound: Bound) -> Callable:
    """Elements of each set as keys that hold within its class only: those that are counted, and of the
    others the smallest if the counted ones are fewer than ``Bound.rare``. ``own`` is by how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.uint64(min(int(bound.counted * 2**64), 2**64 - 1))
        for batch in batches:
            seeds = mix64(batch.column("super").to_numpy().view(np.uint64))
            sets, own = [], []
            for data, seed in zip(batch.column("elements"), seeds, strict=True):
                keys = np.sort(mix64(_unpacked(data.as_py()) + seed))
                counted, rare = int(np.searchsorted(keys, end, side="right")), int(bound.rare(len(keys)))
                sets.append(keys[: max(counted, rare)])
                own.append(rare - counted)
            ends = np.cumsum([0, *map(len, sets)])
            keys = pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), keys)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(own, pa.int64()), lists], ["node", "own", "keys"])

    return run


def rare_classes(sets: DataFrame, bound: Bound) -> DataFrame:
    """(node, super): classes inside the given ones. Linked sets stay together; a set alone is left out.

    ``sets`` has super, node and elements, each node once. Inside a class, elements are ordered: first the
    part ``Bound.counted`` of them, by hash, from rare to frequent, then the others by key. Two linked sets
    share one of their ``Bound.rare`` first elements, so sets that share
    none are parted: a passage that many texts quote brings none of them together, as each has
    rarer elements of its own. Only elements that can be among the first ones are shuffled. Elements of
    one set alone count for the order, but are not joined.
    """
    listed = sets.select("super", "node", "elements").mapInArrow(_element_keys(bound), "node long, own long, keys array<long>")
    held = listed.select("node", "own", F.explode("keys").alias("key"))
    often = held.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    shared = held.join(often.hint("merge"), "key")
    # The shared elements of one set, of which there is one row: no more than it has.
    ordered = shared.groupBy("node").agg(
        F.first("own").alias("own"), F.array_sort(F.collect_list(F.struct("held", "key"))).alias("keys")
    )
    # Where the others are listed, all that is shared has room.
    room = F.greatest(F.lit(0), F.col("own") + F.size("keys")).cast("int")
    first = settle(ordered.select("node", F.explode(F.slice("keys", F.lit(1), room)).alias("at")).select("node", "at.key"), "rare")
    least = first.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = first.join(least.hint("merge"), "key").where("node <> first")
    parted = components(edges.select(F.col("node").alias("u"), F.col("first").alias("v")))
    return parted.select("node", F.col("root").alias("super")).unionByName(
        parted.select(F.col("root").alias("node"), F.col("root").alias("super")).distinct()
    )


MEMBER = "super long, node long, blocks int, pivot long, elements binary"


def verified_links(members: DataFrame, bound: Bound) -> DataFrame:
    """(u, v) links that join the true components inside each candidate class.

    ``members``: the columns of MEMBER. A class of one block is compared at once. A larger one is
    compared with one of its members first, its pivot: those linked with it are its core, held in
    many blocks, one each; the others visit every block. So pairs inside the core, which would be
    nearly all pairs of a large group of near copies, are never formed.
    """
    # Stored, as they are read twice: every read would shuffle the elements of all classes.
    large = settle(members.where("blocks > 1"), "large")
    pivots = large.where("node = pivot").select("super", F.col("elements").alias("pivot_elements")).dropDuplicates(["super"])
    judged = settle(
        large.join(pivots, "super").mapInArrow(_against_pivot(bound), f"{MEMBER}, core boolean"), "pivoted"
    )
    rows = members.where("blocks = 1").withColumn("core", F.lit(False)).unionByName(judged)
    spot = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    spread = rows.withColumn("spot", spot).withColumn(
        "block", F.explode(F.when(F.col("core"), F.array("spot")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    dealt = spread.select("super", "block", "node", "elements", "core", (F.col("block") == F.col("spot")).alias("home"))
    dealt = dealt.repartition("super", "block").sortWithinPartitions("super", "block")
    found = dealt.mapInArrow(_block_links(bound), "u long, v long")
    return found.unionByName(judged.where("core AND node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v")))


def _larger(sets: DataFrame, block_size: int) -> DataFrame:
    """The classes (super) whose sets have more than ``block_size`` elements together."""
    return sets.groupBy("super").agg(F.sum("n").alias("all")).where(F.col("all") > block_size).select("super")


def near_groups(
    docs: DataFrame, *, width: int = 5, percent: int = 80, block_size: int = 2_000_000
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Two documents link when their sets have at least ``percent`` of their union in common. Words are
    lower-cased for A-Z and parted at ASCII white space; a document's set is its distinct runs of
    ``width`` words, or its whole sequence if it has fewer. Documents with equal sets are one node. Nodes that agree in a zone of
    their sets become one candidate class, which holds every true component whole; a large class is
    parted by the rare elements of its sets. In a class, a
    tree over counts of 64 shingle groups bounds the overlap by summed minima, and what is left is
    compared element by element. Only links that join components are kept.

    A tree alone cannot deal the work out: group counts of unrelated texts differ little in any
    one coordinate, so its upper nodes would overlap. Hence zones bring sets together.

    A null text, or one without words, is empty, has the set size 0 and its own doc_id. Rows that
    repeat an id and text are one document written twice. Null ids count as larger than any other.
    Other columns are ignored; an empty table gives an empty result.
    """
    bound = Bound(percent)
    text = whole("text")
    known = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("doc_id", text).alias("ref"))
    schema = "doc_id long, ref long, node long, n_shingles long, keys array<long>, links array<long>"
    sketched = known.mapInArrow(_sketches(width, bound), schema)
    # Keys are many times as large as the rest: they are made once more for the one shuffle they
    # go through, and are not written besides.
    base = settle(sketched.select("doc_id", "ref", "node", "n_shingles"), "sketches")

    # Each piece of a task brings a key once, so the rows of a key are as many as the pieces at
    # most; they are sorted and read in a row, never held together. A link is a key of its own, as
    # links and keys must come from one run over the same pieces.
    holders = Window.partitionBy("key").orderBy("node")
    own = F.transform("keys", lambda key: F.struct(F.col("node").alias("node"), key.alias("key")))
    linked = F.flatten(F.transform("links", lambda other: F.transform(
        F.array("node", other), lambda end: F.struct(end.alias("node"), F.xxhash64("node", other).alias("key"))
    )))
    entries = sketched.select(F.explode(F.concat(own, linked)).alias("entry")).select("entry.node", "entry.key")
    postings = entries.withColumn("first", F.first("node").over(holders))
    classes = components(postings.where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v")))
    classes = classes.select("node", F.col("root").alias("super")).unionByName(
        classes.select(F.col("root").alias("node"), F.col("root").alias("super")).distinct()
    )

    nodes = base.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.min("ref").alias("ref"), F.max("n_shingles").alias("n"))
    wanted = nodes.join(classes, "node").select("ref", "node", "super", "n")
    # One plan at every size: texts are joined by a shuffle, however few documents are wanted.
    # Rows that repeat an id and text lie side by side after it; one of them is kept.
    texts = known.select("ref", "text").join(wanted.hint("merge"), "ref").dropDuplicates(["ref"]).select("node", "super", "n", "text")
    sets = settle(texts.mapInArrow(_sets(width), "node long, super long, n long, elements binary"), "sets")

    # A class of more than ``block_size`` elements is parted by the rare elements of its sets, and
    # one that stays as large by size; what is still larger is cut into blocks.
    kept = sets.select("node", "super", "n")
    # Stored, one row a class, so that it is known to be small: the elements stay in place.
    large = settle(_larger(kept, block_size), "larger")
    finer = rare_classes(sets.join(large, "super"), bound)
    kept = kept.join(large, "super", "left_anti").unionByName(kept.drop("super").join(finer, "node").select("node", "super", "n"))
    kept = settle(kept, "kept")
    cells = F.transform(bound.cells(F.col("n")), lambda cell: F.xxhash64("super", cell))
    parts = kept.join(_larger(kept, block_size).withColumn("large", F.lit(True)), "super", "left").withColumn(
        "super", F.explode(F.when(F.col("large"), cells).otherwise(F.array("super")))
    )
    blocks = F.ceil(F.sum("n") / block_size).cast("int").alias("blocks")
    sizes = parts.groupBy("super").agg(blocks, F.min("node").alias("pivot"))
    places = parts.join(sizes, "super").select("super", "node", "blocks", "pivot")
    members = sets.select("node", "elements").join(places.hint("merge"), "node").select("super", "node", "blocks", "pivot", "elements")

    roots = components(verified_links(members, bound))
    labelled = nodes.join(roots, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = labelled.join(least, "root").select("node", "component_id")
    joined = base.select("doc_id", "node", "n_shingles").join(named, "node")
    alone = F.col("n_shingles") == 0
    return joined.select(
        "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


@query("op5_jaccard_join")
def op5(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents"), width=3, percent=90)
