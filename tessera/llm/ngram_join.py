"""N-gram Jaccard join: token-combination prefixes find candidates, bitmaps and exact sets verify them.

A document's set holds its distinct k-word shingles. All sets are ordered alike, rare shingles first. A
pair that reaches the threshold shares at least ``least(n)`` of a set's n shingles, so at most
``slack = n - least(n)`` are missing, and a prefix one longer shares a shingle with any partner's prefix.
Frequent shingles make poor keys alone. They are therefore dealt into groups, prefixes that reach into
them are extended by one shingle for each group that they touch, and pairs of frequent shingles of one
group are indexed instead (after Wang et al., "Local Similarity Search for Unstructured Text"). Rare ones
are indexed singly. A pair over the threshold shares an indexed key.

Steps, each over all documents:

1. Sizes, set digests and a table of hashed shingle counts of bounded size (a one-row count-min sketch; its
   cells order the shingles, so collisions cost time, never results). Half of all shingles, by their hash, are
   counted: that fills the cells less, and is far more than the prefixes need; the others come last. A
   cell that one document alone reached proves its shingles to be in no other: they make no key, and a
   document with more of them than ``slack`` has no partner and no keys at all.
2. Keys. Inside a task, documents with an equal key and like size are chained and one of them goes on;
   the shuffle sees a key once for each task and size. Chains give candidate pairs of distinct sets, a few for
   each set, however many share a key.
3. Parity bitmaps of a few bits a shingle bound the symmetric difference of a pair from below; what they let pass
   is compared set by set. The links join their documents to parts, so a family of near copies costs work in
   proportion to its members.
4. Parts that a chain leads out of may still be linked across. Parts that chains connect make a family. Documents of its
   largest part meet only those of its other parts, in blocks of both, and their sets are compared where these
   are of parts that no link has joined yet. A family with many documents outside its largest part is compared key by key instead: under each key
   documents of different parts are held against each other by bitmaps. Of two parts
   a task names up to ``TRIALS`` pairs, which are compared set by set; where it had more to name, parts that these have
   not joined are compared again with ``MORE`` times as many, until none is left out. So no link is lost, and what a
   task names grows only for parts that many likely pairs have failed to join.
5. Components of the links, carried to all documents by digest.

Shingles are 64-bit hashes; two texts would have to collide in them to change a result. Null texts count as
empty; documents without words have size 0 and no links. Repeated rows fall into one set and get the
same result; rows that share an id but not the text go by their own sets, linked by any. A null id
gets its size and a null component. Extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import collections
import hashlib
import math
import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import free_worker, mix, shingle_hashes, small_batches, text_bytes, tidied, without, word_hashes, written
from tessera.llm.components import components

#: Cells of the count table for each document, and the least and largest number of cells; a byte each in a task and in the broadcast.
CELLS_PER_DOCUMENT, LEAST_CELLS, MOST_CELLS = 256, 1 << 20, 1 << 27
#: A task counts no further than this in a cell.
MOST_COUNT = 255
_SLICE = 1 << 14
#: Steps of the count scale for each doubling, the scale of a count of one, and that of shingles that aren't counted.
_STEPS = 8
ALONE, UNCOUNTED = _STEPS, 255
#: A shingle is frequent from this count on, or from this many times the mean of a cell.
FREQUENT, OVER_MEAN = 32, 4
#: Frequent shingles of a prefix that share a group, about.
GROUP = 8
#: Documents of a block, pairs of two parts that a task names in the first round, and by how much these rise with each round.
BLOCK, TRIALS, MORE = 256, 16, 4
#: Families with more documents outside their largest part are compared by keys.
OTHERS = 4096
#: More documents than this are joined with their texts by a shuffle, fewer are broadcast (two numbers each).
BROADCAST_ROWS = 500_000
#: Keys that a task holds before it passes them on.
HELD = 1_000_000


def sets_of(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a batch."""
    hashes, begin = shingle_hashes(*word_hashes(*text_bytes(batch.column("text"))), k)
    for i in range(batch.num_rows):
        yield np.unique(hashes[begin[i] : begin[i + 1]])


def digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _counted(own: np.ndarray) -> np.ndarray:
    """Which of some shingles are counted: every other one, by a bit that chooses no cell."""
    return own >> np.uint64(63) == 0


def _packed(cells: np.ndarray) -> bytes:
    """A slice of counts as gaps between the cells that aren't zero, and their counts: its size follows their number."""
    at = np.flatnonzero(cells)
    gaps = np.diff(at, prepend=0).astype(np.uint16)
    return zlib.compress((gaps & 255).astype(np.uint8).tobytes() + (gaps >> 8).astype(np.uint8).tobytes() + cells[at].tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The cells and counts of a packed slice."""
    low, high, counts = np.frombuffer(zlib.decompress(data), np.uint8).reshape(3, -1)
    return np.cumsum(low + high.astype(np.int64) * 256), counts


def _statistics(docs: DataFrame, k: int) -> tuple[DataFrame, np.ndarray, int]:
    """(id, n, hi, lo, bits) of every row, written; the scale of each count cell; the scale of frequent shingles."""

    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (CELLS_PER_DOCUMENT * docs.count()).bit_length()))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        counts = np.zeros(cells, np.uint8)
        for batch in batches:
            n, digests, bits = [], [], []
            for own in sets_of(batch, k):
                n.append(len(own))
                bits.append(bitmap(own).view(np.int64))
                digests.append(digest(own))
                # A document counts once in a cell, whichever of its shingles meet there.
                at = (own[_counted(own)] & np.uint64(cells - 1)).astype(np.int64)
                counts[at] = np.minimum(counts[at], MOST_COUNT - 1) + 1
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            empty = pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())
            width = np.concatenate([[0], np.cumsum([len(b) for b in bits])]).astype(np.int32)
            maps = pa.ListArray.from_arrays(pa.array(width), pa.array(np.concatenate([*bits, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), maps, *empty], _STATS)
        if counts.any():
            reached = np.flatnonzero(counts.reshape(-1, _SLICE).any(1)).tolist()
            parts = [(i, _packed(counts[i * _SLICE : (i + 1) * _SLICE])) for i in reached]
            none = [*[pa.nulls(len(parts), pa.int64())] * 4, pa.nulls(len(parts), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*none, pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], _STATS)

    found = written(docs.mapInArrow(measured, "id long, n long, hi long, lo long, bits array<long>, slice int, cells binary"), "shingle-sets")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total.setdefault(i, np.zeros(_SLICE, np.int32))
                at, more = _unpacked(part)
                total[i][at] += more
        scale = [np.round(_STEPS * np.log2(x + 1)).astype(np.uint8).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(scale, pa.binary()), pa.array([int(x.sum()) for x in total.values()], pa.int64())], ["slice", "scale", "total"])

    # A byte a cell in all.
    slices = found.filter("slice IS NOT NULL").select("slice", "cells").repartition("slice").mapInArrow(summed, "slice int, scale binary, total long").collect()
    scale = np.zeros(cells, np.uint8)
    for row in slices:
        scale[row["slice"] * _SLICE : (row["slice"] + 1) * _SLICE] = np.frombuffer(row["scale"], np.uint8)
    mean = sum(row["total"] for row in slices) / cells
    return found.filter("slice IS NULL").select("id", "n", "hi", "lo", "bits"), scale, round(_STEPS * math.log2(max(FREQUENT, OVER_MEAN * mean) + 1))


#: From a sorted set of hashes to the keys that it is indexed by.
Keys = Callable[[np.ndarray], np.ndarray]
_STATS = ["id", "n", "hi", "lo", "bits", "slice", "cells"]


class Threshold:
    """Jaccard similarity of at least ``percent`` hundredths, in whole numbers."""

    def __init__(self, percent: int):
        self.percent = percent
        self.bin = -math.log(percent / 100) * 1.02  # two sizes that can link lie in neighbouring bins

    def slack(self, n: int) -> int:
        return n - -(-self.percent * n // 100)

    def most_apart(self, n, m):
        """The largest symmetric difference of linked sets of sizes n and m."""
        both = n + m
        return both - 2 * -(-self.percent * both // (100 + self.percent))

    def links(self, n: int, m: int, common: int) -> bool:
        return 100 * common >= self.percent * (n + m - common)

    def size_bin(self, n: int) -> int:
        return int(math.log(n) / self.bin)

    def classes(self, n: int) -> tuple[int, ...]:
        """The size classes (powers of two) that a set is indexed in: its own, and that of a larger partner."""
        own, far = n.bit_length(), (100 * n // self.percent).bit_length()
        return (own,) if own == far else (own, far)


def keys(own: np.ndarray, scale: np.ndarray, frequent: int, threshold: Threshold) -> np.ndarray:
    """The index keys of one sorted set: rare shingles of its prefix, and pairs of frequent ones."""
    slack = threshold.slack(len(own))
    level = np.where(_counted(own), scale[(own & np.uint64(len(scale) - 1)).astype(np.int64)], UNCOUNTED)
    order = np.argsort(level, kind="stable")
    ordered, alone, rare = own[order], int((level <= ALONE).sum()), int((level < frequent).sum())
    if rare > slack:
        return ordered[alone : slack + 1]
    found, rest = [ordered[alone:rare]], ordered[rare:]
    for size in threshold.classes(len(own)):
        groups = max(1, ((1 << (size - 1)) * (100 - threshold.percent) // 100) // GROUP)
        group = mix(rest) % np.uint64(groups)
        # The first shingle of each group adds nothing to what must be shared.
        adds = np.ones(len(rest), np.int64)
        adds[np.unique(group, return_index=True)[1]] = 0
        reached = rare + np.cumsum(adds)
        taken = int(np.searchsorted(reached, slack, side="right")) + 1
        group, chosen = group[:taken], rest[:taken]
        by = np.argsort(group, kind="stable")
        group, chosen = group[by], chosen[by]
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        for s, e in zip(starts, [*starts[1:], len(group)], strict=True):
            i, j = np.triu_indices(e - s, 1)
            # Inside a group the shingles keep the common order, so a pair has one key.
            found.append(mix(chosen[s + i] * np.uint64(0x9E3779B97F4A7C15) + mix(chosen[s + j] + np.uint64(size))))
    return np.concatenate(found)


def prefix_keys(spark: SparkSession, scale: np.ndarray, frequent: int, threshold: Threshold) -> Keys:
    """:func:`keys` over a broadcast count table."""
    held = spark.sparkContext.broadcast(scale)
    return lambda own: keys(own, held.value, frequent, threshold)


def candidate_edges(docs: DataFrame, k: int, find: Keys, threshold: Threshold) -> DataFrame:
    """(a, b): chains through sets (first halves of their digests) that share a key and have sizes of neighbouring bins."""

    def combined(held: list[tuple[np.ndarray, int, int]]) -> pa.RecordBatch:
        key = np.concatenate([x[0] for x in held])
        times = [len(x[0]) for x in held]
        doc, size = np.repeat(np.array([x[1] for x in held], np.int64), times), np.repeat(np.array([x[2] for x in held], np.int32), times)
        order = np.lexsort((doc, size, key))
        key, doc, size = key[order], doc[order], size[order]
        again = np.concatenate([[False], (key[1:] == key[:-1]) & (size[1:] == size[:-1])])
        ends = np.flatnonzero(again)
        chain = np.unique(np.stack([doc[ends - 1], doc[ends]], 1), axis=0)
        chain = chain[chain[:, 0] != chain[:, 1]]
        new = ~again
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([key[new].view(np.int64), chain[:, 0]])), pa.array(np.concatenate([size[new], np.full(len(chain), -1, np.int32)])), pa.array(np.concatenate([doc[new], chain[:, 1]]))],
            ["key", "size", "doc"],
        )

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        held, count = [], 0
        for batch in batches:
            for doc, own in zip(batch.column("id").to_pylist(), sets_of(batch, k), strict=True):
                if doc is None or not len(own):
                    continue
                found = find(own)
                if not len(found):
                    continue
                held.append((found, int.from_bytes(digest(own)[:8], sys.byteorder, signed=True), threshold.size_bin(len(own))))
                count += len(found)
                if count >= HELD:
                    yield combined(held)
                    held, count = [], 0
        if count:
            yield combined(held)

    # Rows of size -1 are finished edges (key, doc); they sort before a key's documents.
    postings = docs.mapInArrow(indexed, "key long, size int, doc long")
    by_key = Window.partitionBy("key").orderBy("size", "doc")
    before = F.lag(F.struct("size", "doc")).over(by_key)
    chained = postings.withColumn("before", before).withColumn("a", F.when(F.col("size") < 0, F.col("key")).when((F.col("before.size") >= 0) & (F.col("before.size") >= F.col("size") - 1), F.col("before.doc")))
    return chained.filter("a IS NOT NULL AND a != doc").select("a", F.col("doc").alias("b")).distinct()


def bitmap(own: np.ndarray) -> np.ndarray:
    """Parity bitmap of a set, of 2 to 4 bits a shingle: differing bits never outnumber the symmetric difference."""
    width = 64 << (2 * len(own) // 64).bit_length()
    odd = np.bincount((own >> np.uint64(20)).astype(np.int64) & (width - 1), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap brought to fewer words: parities add up."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _apart(a: Column, b: Column) -> Column:
    """The differing bits of two bitmaps, the wider one folded."""

    def folded(x: Column, other: Column) -> Column:
        half = F.when(F.size(x) > F.size(other), F.transform(F.slice(x, 1, F.size(other)), lambda v, i: v.bitwiseXOR(F.get(x, i + F.size(other)))))
        return F.coalesce(half, x)

    return F.aggregate(F.zip_with(folded(a, b), folded(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda total, n: total + n)


def _likely(n: Column, m: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether sizes and bitmaps of two sets let them link; one folding suffices, as sizes that link differ less than twofold."""
    most = n + m - 2 * F.ceil(percent * (n + m) / (100 + percent))
    sizes = F.least(n, m) * 100 >= percent * F.greatest(n, m)
    return sizes & (F.greatest(F.size(a), F.size(b)) <= 2 * F.least(F.size(a), F.size(b))) & (_apart(a, b) <= most)


def _with_text(source: DataFrame, members: DataFrame, *columns: str) -> DataFrame:
    """The rows of ``source`` (id, text) of the members (written), with columns of these."""
    members = members.select("id", *columns)
    chosen = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members
    return source.join(chosen, "id").select("id", "text", *columns)


def _verified(source: DataFrame, pairs: DataFrame, k: int, threshold: Threshold) -> DataFrame:
    """Those of the pairs (a, b; written) whose sets link; written. A set is sent to each ``a`` that asks for it."""
    asked = pairs.select("a", F.explode(F.array("a", "b")).alias("id")).distinct()
    members = written(asked.groupBy("id").agg(F.collect_set("a").alias("groups")), "asked")

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s.tobytes() for s in sets_of(batch, k)], pa.binary()), batch.column("groups")], ["id", "own", "groups"])

    sent = _with_text(source, members, "groups").mapInArrow(as_sets, "id long, own binary, groups array<long>").select("id", "own", F.explode("groups").alias("a"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        now, centres = None, []
        for batch in batches:
            links = []
            for a, node, value in zip(*(batch.column(c).to_pylist() for c in ("a", "id", "own")), strict=True):
                own = np.frombuffer(value, np.uint64)
                if a != now:
                    now, centres = a, []
                if node == a:  # these come first; one, but for rows that share an id
                    centres.append(own)
                elif any(threshold.links(len(c), len(own), shared(c, own)) for c in centres):
                    links.append((a, node))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    by_centre = sent.repartition("a").sortWithinPartitions("a", F.col("id") != F.col("a"))
    return written(by_centre.mapInArrow(compared, "a long, b long").distinct(), "links")


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    return int((large[at] == small).sum()) if len(large) else 0


def maybe(n: np.ndarray, part: np.ndarray, side: np.ndarray, bits: list[np.ndarray], threshold: Threshold) -> Iterator[tuple[int, int]]:
    """Places of two sets of different parts that sizes and bitmaps let link.

    Sets of side 0 meet only those of side 1; those of side 2 meet one another.
    """
    order = np.argsort(n, kind="stable")
    n, part, side, bits = n[order], part[order], side[order], [bits[i] for i in order]
    until = np.searchsorted(n, 100 * n // threshold.percent, side="right")
    words, first, maps = 0, 0, None
    for i in range(len(n)):
        j = np.arange(i + 1, until[i])
        j = j[((side[j] != side[i]) | (side[j] == 2)) & (part[j] != part[i])]
        if not len(j):
            continue
        if len(bits[i]) != words:
            # Sizes rise, so the maps of this width serve all that follow with it, and their partners.
            words, first = len(bits[i]), i
            same = next((x for x in range(i, len(n)) if len(bits[x]) != words), len(n))
            maps = np.stack([_folded(b, words) for b in bits[i : until[same - 1]]])
        apart = np.bitwise_count(maps[j - first] ^ maps[i - first]).sum(1)
        for x in order[j[apart <= threshold.most_apart(n[i], n[j])]].tolist():
            yield int(order[i]), x


def named(pairs: Iterator[tuple[int, int]], part: np.ndarray, trials: int) -> tuple[list[tuple[int, int]], bool]:
    """Up to ``trials`` of the pairs for each two parts; whether there are more."""
    found, count, more = [], collections.Counter(), False
    for i, x in pairs:
        parts = min(part[i], part[x]), max(part[i], part[x])
        count[parts] += 1
        if count[parts] <= trials:
            found.append((i, x))
        else:
            more = True
    return found, more


def joining(pairs: Iterator[tuple[int, int]], part: np.ndarray, sets: list[np.ndarray], threshold: Threshold) -> list[tuple[int, int]]:
    """Links among the pairs that join parts not joined before."""
    parent = {p: p for p in part.tolist()}

    def root(p: int) -> int:
        while parent[p] != p:
            parent[p] = parent[parent[p]]
            p = parent[p]
        return p

    links = []
    for i, x in pairs:
        a, b = root(int(part[i])), root(int(part[x]))
        if a != b and threshold.links(len(sets[i]), len(sets[x]), shared(sets[i], sets[x])):
            parent[b] = a
            links.append((i, x))
    return links


def _postings(source: DataFrame, members: DataFrame, k: int, find: Keys) -> DataFrame:
    """(key, id) of the members (id; written); written."""

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for batch in batches:
            found = [np.unique(find(own)) if len(own) else np.zeros(0, np.uint64) for own in sets_of(batch, k)]
            ids = np.repeat(batch.column("id").to_numpy(), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)), pa.array(ids)], ["key", "id"])

    return written(_with_text(source, members).mapInArrow(indexed, "key long, id long"), "postings")


def _dealt(placed: DataFrame) -> DataFrame:
    """(group, x, y, side, id): the rows (group, id, part) of each group of several parts, dealt to pairs of blocks.

    A group of up to ``BLOCK`` rows is one block. In a larger one the rows of its largest part aren't compared among
    themselves: they go to as many places as the others have blocks, so that a part that most rows are of costs work in proportion.
    """
    shares = written(placed.groupBy("group", "part").agg(F.count("*").alias("own")), "shares")
    sums = shares.groupBy("group").agg(F.sum("own").alias("m"), F.max("own").alias("most"), F.max_by("part", F.struct("own", "part")).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    large = F.col("m") > BLOCK
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    asked = written(sums.select("group", F.when(large, F.col("main")).alias("main"), F.when(large, blocks(F.col("most"))).otherwise(0).alias("mains"), F.when(large, blocks(F.col("m") - F.col("most"))).otherwise(1).alias("others")), "asked")
    rows = placed.join(F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked, "group")
    is_main = F.coalesce(F.col("part") == F.col("main"), F.lit(False))
    own = F.pmod(F.xxhash64("id"), F.when(is_main, F.col("mains")).otherwise(F.col("others"))).cast("int")
    every = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    # Blocks of the main part have numbers below 0; they meet the other blocks, and these one another.
    of_main = F.transform(every(F.col("others")), lambda y: F.struct((-1 - own).alias("x"), y.alias("y"), F.lit(0).alias("side")))
    with_main = F.transform(every(F.col("mains")), lambda x: F.struct((-1 - x).alias("x"), own.alias("y"), F.lit(1).alias("side")))
    with_other = F.transform(every(F.col("others")), lambda y: F.struct(F.least(own, y).alias("x"), F.greatest(own, y).alias("y"), F.when(own == y, 2).otherwise((own > y).cast("int")).alias("side")))
    met = F.explode(F.when(is_main, of_main).otherwise(F.concat(with_main, with_other))).alias("at")
    return rows.select("group", "id", "part", met).select("group", "at.x", "at.y", "at.side", "id", "part")


def _each_block(dealt: DataFrame, value: str, pairs_of: Callable[[list], list[tuple]]) -> DataFrame:
    """(a, b), written: what ``pairs_of`` gives for the rows [side, id, part, ``value``] of each block against a block."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        now, held = None, []

        def out(pairs: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            pairs = []
            for group, x, y, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (group, x, y) != now:
                    if len(held) > 1:
                        pairs += pairs_of(held)
                    now, held = (group, x, y), []
                held.append(row)
            yield out(pairs)
        if len(held) > 1:
            yield out(pairs_of(held))

    sent = dealt.select("group", "x", "y", "side", "id", "part", value)
    return written(sent.repartition("group", "x", "y").sortWithinPartitions("group", "x", "y").mapInArrow(compared, "a long, b long").distinct(), "pairs")


def _columns(held: list) -> tuple[np.ndarray, list[int], np.ndarray]:
    return np.array([h[0] for h in held]), [h[1] for h in held], np.array([h[2] for h in held], np.int64)


def _in_families(source: DataFrame, members: DataFrame, k: int, threshold: Threshold) -> DataFrame:
    """(a, b): links that join all parts of a family (id, part, family) that links join."""

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _PLACE), pa.array([s.tobytes() for s in sets_of(batch, k)], pa.binary())], [*_PLACE, "own"])

    def links_of(held: list) -> list[tuple[int, int]]:
        side, ids, part = _columns(held)
        sets = [np.frombuffer(h[3], np.uint64) for h in held]
        pairs = maybe(np.array([len(x) for x in sets], np.int64), part, side, [bitmap(x) for x in sets], threshold)
        return [(ids[i], ids[x]) for i, x in joining(pairs, part, sets, threshold)]

    dealt = written(_dealt(members.withColumnRenamed("family", "group")), "dealt")
    texts = _with_text(source, dealt, *_PLACE[:4], "part")
    return _each_block(texts.mapInArrow(as_sets, "group long, x int, y int, side int, id long, part long, own binary"), "own", links_of)


_PLACE = ("group", "x", "y", "side", "id", "part")


def _by_keys(postings: DataFrame, members: DataFrame, sets: DataFrame, threshold: Threshold, trials: int) -> DataFrame:
    """(a, b): pairs that :func:`named` gives under each key (key, id) of the members (id, part); nulls where a key has more."""

    def pairs_of(held: list) -> list[tuple]:
        side, ids, part = _columns(held)
        pairs = maybe(np.array([h[3]["n"] for h in held], np.int64), part, side, [np.array(h[3]["bits"], np.int64).view(np.uint64) for h in held], threshold)
        found, more = named(pairs, part, trials)
        return [*((min(ids[i], ids[x]), max(ids[i], ids[x])) for i, x in found), *[(None, None)] * more]

    dealt = _dealt(postings.join(members.select("id", "part"), "id").select(F.col("key").alias("group"), "id", "part"))
    return _each_block(dealt.join(sets.select("id", F.struct("n", "bits").alias("map")), "id"), "map", pairs_of)


def _parts(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, part) of all nodes (id): the component of each, or itself."""
    linked = components(links)
    return nodes.join(linked, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("part"))


def links_between(source: DataFrame, sets: DataFrame, chains: DataFrame, k: int, find: Keys, threshold: Threshold) -> DataFrame:
    """(a, b): links between distinct sets (hi, lo, id, n, bits) that join all that links join. ``chains``: (a, b) by ``hi``."""
    # Of two sets with an equal half of a digest both are meant: a pair too many does no harm.
    end = lambda side: sets.select(F.col("hi").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("id", "n", "bits")))
    met = chains.join(end("a"), "a").join(end("b"), "b").filter("id_a != id_b")
    pairs = written(met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), _likely(F.col("n_a"), F.col("n_b"), F.col("bits_a"), F.col("bits_b"), threshold.percent).alias("likely")), "candidates")
    links = _verified(source, pairs.filter("likely").select("a", "b"), k, threshold)
    nodes = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "nodes")
    parts = written(_parts(nodes, links), "parts")
    # A part is open if a chain leads out of it; open parts that chains connect are a family.
    side = lambda c: parts.select(F.col("id").alias(c), F.col("part").alias(f"part_{c}"))
    crossing = pairs.join(side("a"), "a").join(side("b"), "b").select(F.col("part_a").alias("a"), F.col("part_b").alias("b"))
    families = components(crossing).select(F.col("node").alias("part"), F.col("component").alias("family"))
    members = written(parts.join(families, "part").select("id", "part", "family"), "open")
    sums = members.groupBy("family", "part").agg(F.count("*").alias("own")).groupBy("family").agg((F.sum("own") - F.max("own")).alias("others"))
    wide = written(sums.filter(F.col("others") > OTHERS).select("family"), "wide")
    links = links.unionByName(_in_families(source, members.join(wide, "family", "left_anti"), k, threshold))
    if wide.isEmpty():
        return links
    members, trials = written(members.join(wide, "family", "left_semi"), "wide-members"), TRIALS
    postings = _postings(source, members, k, find)
    while True:
        met = _by_keys(postings, members, sets, threshold, trials)
        links = links.unionByName(_verified(source, met.filter("a IS NOT NULL"), k, threshold))
        if met.filter("a IS NULL").isEmpty():
            return links
        # Parts that are still apart are compared again, with more pairs named for each two of them.
        members, trials = written(_parts(members.select("id"), links), "wide-members"), max(1, MORE * trials)


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """(``key``, n_shingles, component_id) of every row of ``docs``; ``key`` is whole numbers."""
    small_batches(docs.sparkSession)
    threshold = Threshold(percent)
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    with tidied() as keep:
        stats, scale, frequent = _statistics(source, k)
        return keep(placed(source, stats, k, prefix_keys(docs.sparkSession, scale, frequent, threshold), threshold, key))


def placed(source: DataFrame, stats: DataFrame, k: int, find: Keys, threshold: Threshold, key: str) -> DataFrame:
    """(``key``, n_shingles, component_id) of all ``stats`` (id, n, hi, lo, bits; written); sets that share a key that ``find`` gives are candidates."""
    # One document stands for each distinct set.
    sets = written(stats.filter("n > 0 AND id IS NOT NULL").groupBy("hi", "lo").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bits").alias("bits")), "sets")
    linked = components(links_between(source, sets, candidate_edges(source, k, find, threshold), k, find, threshold)).withColumnRenamed("node", "id")
    of_set = written(sets.join(linked, "id", "left").select("hi", "lo", F.coalesce("component", "id").alias("component")), "placed")
    own = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return stats.join(of_set, ["hi", "lo"], "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), own).alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """One row of ``docs`` for each component: that of the least id. Rows with a null id stay."""
    with tidied() as keep:
        return keep(_one_each(docs, key, link(docs, key, text, k, percent)))


def _one_each(docs: DataFrame, key: str, linked: DataFrame) -> DataFrame:
    kept = without(docs, linked.filter(F.col(key) != F.col("component_id")).select(key), key)
    again = written(kept.groupBy(key).agg(F.count("*").alias("n")).filter(F.col(key).isNotNull() & (F.col("n") > 1)).select(key), "repeated")
    if again.isEmpty():
        return kept
    # Rows that repeat an id are few or equal; only they are shuffled.
    return without(kept, again, key).unionByName(kept.join(again, key, "left_semi").dropDuplicates([key]))


def oracle(k: int, percent: int) -> str:
    """:func:`link` by all pairs that share a shingle."""
    return _ORACLE.replace("{k}", str(k)).replace("{percent}", str(percent))


_ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= {k} THEN list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {percent} * (x.n + y.n - k)
), ab AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT ab.b, r.c FROM r JOIN ab ON ab.a = r.doc_id WHERE r.c < ab.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, d.c AS component_id
FROM (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) d LEFT JOIN n USING (doc_id)
"""
