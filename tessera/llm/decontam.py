"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

Words are lower-cased runs without ASCII blanks and punctuation. The seeds of a test item are its word
trigrams; of these its rarest three quarters stay (by the number of training documents that hold them, at least
``LEAST_SEEDS``), and every one that few documents hold. The choice is made inside each item, so a passage that
a large part of the corpus holds keeps its seeds. Where a document holds two seeds of an item close
together (one, if the item has no more), the words around them are aligned with the whole item. The score
is the alignment's share of a perfect one, so edited and paraphrased copies score by what they keep.

Items are a stated query set: they are taken in blocks, and only a block's seeds and words are broadcast.
Documents are read twice for each block and never shuffled; what is shuffled is a count for each seed and
task. Items of fewer than three words or with a null id are not tested. Null texts count as empty. A
repeated document gives its rows again, a null document id gives rows with a null id; an item is tested
once for each of its distinct texts. Extra columns are left out. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_worker, shingle_hashes, small_batches, text_bytes, without, word_hashes

SEED_WORDS = 3
LEAST_SEEDS = 8
#: A seed that no more than so many documents hold, or this share of them, is always kept.
RARE_DOCUMENTS, RARE_SHARE = 100, 0.001
#: The least share of a perfect alignment.
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Items in a block.
BLOCK_ITEMS = 20_000

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 0x20


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(column)
    return word_hashes(_PLAIN[data], offsets)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment: its share of a perfect one, and the words of the passage that it spans."""
    m, n = len(item), len(passage)
    column = np.arange(n + 1)
    row, begin = np.zeros(n + 1, np.int64), column
    best, span = 0, (0, 0)
    for i in range(m):
        equal = np.where(passage == item[i], MATCH, MISMATCH)
        slant = np.concatenate([[0], row[:-1] + equal])
        up = row + GAP
        now = np.maximum(np.maximum(slant, up), 0)
        origin = np.where(now == 0, column, np.where(slant >= up, np.concatenate([[0], begin[:-1]]), begin))
        # A gap in the item: the best cell to the left, less one for each word passed.
        reach = np.maximum.accumulate(now - GAP * column)
        source = np.maximum.accumulate(np.where(now - GAP * column == reach, column, 0))
        left = reach + GAP * column
        origin = np.where(left > now, origin[source], origin)
        row = np.maximum(now, left)
        begin = origin
        top = int(row.argmax())
        if row[top] > best:
            best, span = int(row[top]), (int(origin[top]), top)
    return best / (MATCH * m), *span


@dataclass
class Block:
    """A block of items: their words, and for each seed (sorted) the items and places that have it."""

    ids: np.ndarray
    words: list[np.ndarray]
    seeds: np.ndarray
    starts: np.ndarray
    item: np.ndarray
    place: np.ndarray
    needed: np.ndarray

    def __post_init__(self) -> None:
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.seeds & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` that are seeds, and the seeds' numbers."""
        maybe = np.flatnonzero(self.filter[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.searchsorted(self.seeds, hashes[maybe])
        at[at == len(self.seeds)] = 0
        right = self.seeds[at] == hashes[maybe] if len(self.seeds) else np.zeros(0, bool)
        return maybe[right], at[right]


def _block(ids: list[int], texts: list[str], kept: dict[int, set[int]] | None = None) -> Block:
    words, first = _words(pa.array(texts, pa.string()))
    hashes, begin = shingle_hashes(words, first, SEED_WORDS)
    seed, item, place = [], [], []
    for i in range(len(ids)):
        for p, h in enumerate(hashes[begin[i] : begin[i + 1]].tolist()):
            if first[i + 1] - first[i] >= SEED_WORDS and (kept is None or h in kept[i]):
                seed.append(h)
                item.append(i)
                place.append(p)
    order = np.argsort(np.array(seed, np.uint64), kind="stable")
    seed, item, place = np.array(seed, np.uint64)[order], np.array(item, np.int64)[order], np.array(place, np.int64)[order]
    seeds, starts = np.unique(seed, return_index=True)
    distinct = np.bincount(item[np.unique(np.stack([item, seed.view(np.int64)]), axis=1, return_index=True)[1]] if len(item) else item, minlength=len(ids))
    return Block(np.array(ids, np.int64), [words[first[i] : first[i + 1]] for i in range(len(ids))], seeds, np.append(starts, len(seed)), item, place, np.minimum(2, distinct))


def _chosen(block: Block, held: dict[int, int], n_docs: int) -> dict[int, set[int]]:
    """For each item its rare seeds: the rarest three quarters, at least LEAST_SEEDS, and all that few documents hold."""
    own: dict[int, set[int]] = {i: set() for i in range(len(block.ids))}
    for s, seed in enumerate(block.seeds.tolist()):
        for i in set(block.item[block.starts[s] : block.starts[s + 1]].tolist()):
            own[i].add(seed)
    chosen = {}
    for i, seeds in own.items():
        ranked = sorted(seeds, key=lambda x: (held.get(x, 0), x))
        keep = max(LEAST_SEEDS, -(-3 * len(ranked) // 4))
        chosen[i] = set(ranked[:keep]) | {x for x in ranked if held.get(x, 0) <= max(RARE_DOCUMENTS, RARE_SHARE * n_docs)}
    return chosen


def _document_leaks(words: np.ndarray, at: np.ndarray, seed: np.ndarray, block: Block, threshold: float) -> Iterator[tuple[int, float, int, int]]:
    """(item, score, first word, words' end) of each item that a document holds; of several passages the best."""
    times = np.diff(block.starts)[seed]
    if not len(times):
        return
    index = np.repeat(block.starts[:-1][seed] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
    place, item, seed = np.repeat(at, times), block.item[index], np.repeat(seed, times)
    order = np.lexsort((place, item))
    place, item, seed = place[order], item[order], seed[order]
    length = block.lengths[item]
    new = np.concatenate([[True], (item[1:] != item[:-1]) | (place[1:] - place[:-1] > length[1:])])
    starts = np.append(np.flatnonzero(new), len(item))
    best: dict[int, tuple[float, int, int]] = {}
    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        i = int(item[s])
        if e - s < block.needed[i] or (block.needed[i] > 1 and (seed[s:e] == seed[s]).all()):
            continue
        m = len(block.words[i])
        # A chain of seeds may run on far beyond the item; windows that overlap by two items cover it.
        low, high = max(0, int(place[s]) - m), min(len(words), int(place[e - 1]) + m + SEED_WORDS)
        for w in range(low, high, 4 * m):
            score, begin, end = align(block.words[i], words[w : min(high, w + 6 * m)])
            if score >= threshold and score > best.get(i, (0.0,))[0]:
                best[i] = score, w + begin, w + end
            if w + 6 * m >= high:
                break
    for i, found in sorted(best.items()):
        yield i, *found


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(``key``, ``item_key``, score, first_word, end_word) of the items that documents hold, from ``threshold`` on."""
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    asked = items.select(F.col(item_key).cast("long").alias("id"), F.col(item_text).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL").distinct()
    n_blocks = max(1, -(-asked.count() // BLOCK_ITEMS))
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)))
    n_docs = source.count()
    found = [_block_leaks(source, numbered.filter(F.col("block") == b), n_docs, threshold) for b in range(n_blocks)]
    return reduce(DataFrame.unionByName, found).withColumnsRenamed({"id": key, "item": item_key})


def _block_leaks(source: DataFrame, items: DataFrame, n_docs: int, threshold: float) -> DataFrame:
    spark = source.sparkSession
    rows = items.select("id", "text").orderBy("id", "text").collect()  # a block: BLOCK_ITEMS, about
    ids, texts = [r["id"] for r in rows], [r["text"] for r in rows]
    whole = spark.sparkContext.broadcast(_block(ids, texts))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        block = whole.value
        counts = np.zeros(len(block.seeds), np.int64)
        for batch in batches:
            hashes, begin = shingle_hashes(*_words(batch.column("text")), SEED_WORDS)
            at, seed = block.hits(hashes)
            text = np.searchsorted(begin, at, side="right")
            np.add.at(counts, np.unique(np.stack([text, seed]), axis=1)[1], 1)
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(block.seeds[own].view(np.int64)), pa.array(counts[own])], ["seed", "n"])

    held = source.mapInArrow(counted, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect()
    n = {r["seed"] % (1 << 64): r["n"] for r in held}
    rare = spark.sparkContext.broadcast(_block(ids, texts, _chosen(whole.value, n, n_docs)))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        block = rare.value
        for batch in batches:
            words, first = _words(batch.column("text"))
            hashes, begin = shingle_hashes(words, first, SEED_WORDS)
            at, seed = block.hits(hashes)
            cut = np.searchsorted(at, begin)
            out = []
            for d in np.flatnonzero(np.diff(cut)).tolist():
                s, e = cut[d], cut[d + 1]
                out += [(d, *x) for x in _document_leaks(words[first[d] : first[d + 1]], at[s:e] - begin[d], seed[s:e], block, threshold)]
            rows = np.array([x[0] for x in out], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(pa.int64()).take(pa.array(rows)), pa.array([int(block.ids[x[1]]) for x in out], pa.int64()), pa.array([x[2] for x in out], pa.float64()), pa.array([x[3] for x in out], pa.int64()), pa.array([x[4] for x in out], pa.int64())],
                ["id", "item", "score", "first_word", "end_word"],
            )

    return source.mapInArrow(found, "id long, item long, score double, first_word long, end_word long")


def drop_leaking(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` whose id holds no item; rows with a null id stay."""
    return without(docs, leaks(docs, items, key, text, **how).select(key), key)
