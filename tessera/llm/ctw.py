"""Language-model scores by context-tree weighting over bytes.

A text is its lower-cased (A-Z) UTF-8 bytes and an end mark. Each byte is eight binary decisions; each
decision has Krichevsky-Trofimov estimates in the contexts of the last 0 to ``depth`` bytes, mixed with the
weights of context-tree weighting (Willems, Shtarkov and Tjalkens): a node's block probability is half its
own estimate's and half the product of its children's. Weights are those after all training texts,
so a text's log-probability is a sum over its bytes and depends on no other text.

Counts cover every byte of every training text, and every context that occurs is a node of its own; the tree
grows with the input and is never whole in one process. A node's decisions depend on those of its children alone:
subtrees below a context of ``SPLIT`` bytes are weighed in one task each, and the levels above them by grouped tables,
from the deepest up. The grams of the texts to score are put into the tree with no counts (such nodes have probability
1 and change no weight), so each distinct gram gets its log-probability on the way down. Grams over ``GRAM_SHARE``
of the scored bytes are broadcast (their number is bounded by it), all others join that table.

Beside it, word unigrams: ``log10((c + 0.5) / (N + 0.5 (V + 1)))`` over words and one end token. Word
counts are grouped by a 64-bit hash; words over ``WORD_SHARE`` of all tokens are broadcast (their
number is bounded by it), all others join the count table by hash, so frequent words make no hot key.

Null texts count as empty: one end. Repeated rows get equal scores (rows have numbers of their own inside);
a null id counts as empty text for the fold. Extra columns are left out. Without training texts
every bit has probability 1/2 and every word counts as unknown. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, text_bytes, word_hashes, written

DEPTH = 5
#: Contexts of this many bytes have their subtrees weighed in one task.
SPLIT = 3
GRAM_SHARE = 2.0**-22
WORD_SHARE = 2.0**-21
#: Never a byte of UTF-8; bytes before a text's first are zeros.
END = 0xFF
_END_WORD = np.uint64(1)
#: Distinct grams and words that a task holds before it passes their counts on.
HELD = 3_000_000
#: Rows of whole subtrees that are weighed at once.
CHUNK = 400_000


def _symbols(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts with their ends, each text after ``depth`` zeros; and the places of all but the zeros."""
    n, length = len(offsets) - 1, np.diff(offsets)
    begin = offsets[:-1] + np.arange(n) * (depth + 1) + depth
    out = np.zeros(len(data) + n * (depth + 1), np.uint8)
    out[np.arange(len(data)) + np.repeat(begin - offsets[:-1], length)] = data
    out[begin + length] = END
    at = np.ones(len(out), bool)
    at[(begin[:, None] - np.arange(1, depth + 1)).ravel()] = False
    return out, np.flatnonzero(at)


def _grams(data: np.ndarray, offsets: np.ndarray, depth: int) -> np.ndarray:
    """Each byte of the texts and their ends (lowest), with the ``depth`` bytes before it."""
    symbols, at = _symbols(data, offsets, depth)
    key = np.zeros(len(at), np.uint64)
    for d in range(depth, -1, -1):
        key = key << np.uint64(8) | symbols[at - d]
    return key


class _Counts:
    """Counts of 64-bit keys that are passed on when there are many."""

    def __init__(self, kind: int):
        self.kind, self.keys, self.counts, self.held = kind, [], [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > HELD:
            self._merge()
            if self.held > HELD // 2:
                yield from self.take()

    def _merge(self) -> None:
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        keys, at = np.unique(keys, return_inverse=True)
        self.keys, self.counts, self.held = [keys], [np.bincount(at, counts).astype(np.int64)], len(keys)

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._merge()
            keys = self.keys[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), self.kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(self.counts[0])], ["kind", "key", "n"])
            self.keys, self.counts, self.held = [], [], 0


def _count(texts: DataFrame, depth: int, with_words: bool = True) -> DataFrame:
    """(kind, key, n), written: kind 0 are words by hash, kind 1 grams of ``depth`` bytes and the next one."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams = _Counts(0), _Counts(1)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            if with_words:
                found, _ = word_hashes(data, offsets)
                yield from words.add(np.concatenate([found, np.full(batch.num_rows, _END_WORD)]))
            yield from grams.add(_grams(data, offsets, depth))
        yield from words.take()
        yield from grams.take()

    return written(texts.mapInArrow(counted, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "ctw-counts")


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps up."""
    product = np.ones_like(x)
    for i in range(8):
        product *= x + i
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - np.log(product)


def _bits(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at each of the 255 decisions (heap order) of byte counts."""
    zeros, ones, level = [], [], table
    for _ in range(8):
        zeros.append(level[:, 0::2])
        ones.append(level[:, 1::2])
        level = level[:, 0::2] + level[:, 1::2]
    return np.concatenate(zeros[::-1], 1), np.concatenate(ones[::-1], 1)


def _block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - np.log(np.pi)


def _mask(d: int) -> int:
    """The bits of a gram or node that a context of ``d`` bytes and the lowest byte take."""
    return (1 << (8 * (d + 1))) - 1


def _subtrees(keys: np.ndarray, n: np.ndarray, depth: int, split: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Whole subtrees below contexts of ``split`` bytes, one bit of the next byte at a time.

    Nodes are contexts with the decision (heap order) as lowest byte. Of each bit: nodes at ``split``, their zeros, ones and
    log of the weighted probability; and of each gram the node, its bit, and the chance of a one from there.
    """
    for bit in range(8):
        byte = keys & 255
        ids, gram = np.unique((keys & ~255) | ((1 << bit) - 1 + (byte >> (8 - bit))), return_inverse=True)
        one = (byte >> (7 - bit)) & 1
        zeros, ones = np.bincount(gram, n * (1 - one)), np.bincount(gram, n * one)
        whole, chance, up = _block(zeros, ones), (ones + 0.5) / (zeros + ones + 1), np.arange(len(ids))
        for d in range(depth - 1, split - 1, -1):
            ids, at = np.unique(ids & _mask(d), return_inverse=True)
            zeros, ones, below = np.bincount(at, zeros), np.bincount(at, ones), np.bincount(at, whole)
            block = _block(zeros, ones)
            whole, up = np.logaddexp(block, below) + np.log(0.5), at[up]
            weight = np.exp(block + np.log(0.5) - whole)[up]
            chance = weight * ((ones + 0.5) / (zeros + ones + 1))[up] + (1 - weight) * chance
        yield ids, zeros, ones, whole, up[gram], one, chance[gram]


def _by_root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches that are sorted by ``root``, joined and cut so that no root is in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= CHUNK:
            rows = pa.Table.from_batches(held)
            root = rows.column("root").to_numpy()
            cut = int(np.searchsorted(root, root[-1]))
            if cut:
                yield rows.slice(0, cut)
            held = rows.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _gram_scores(grams: DataFrame, depth: int) -> DataFrame:
    """(key, times, log10), written: the log-probability of each gram's last byte. ``grams`` has key, n (in training) and times (in the texts to score)."""
    split = min(SPLIT, depth)
    root = F.shiftrightunsigned("id", 8).bitwiseAND(F.lit((1 << (8 * split)) - 1)).alias("root")
    grams = grams.select(F.col("key").alias("id"), "n", "times")

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_root(batches):
            for ids, zeros, ones, whole, *_ in _subtrees(rows.column("id").to_numpy(), rows.column("n").to_numpy(), depth, split):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(zeros), pa.array(ones), pa.array(whole)], ["id", "zeros", "ones", "whole"])

    grouped = grams.select(root, "id", "n").repartition("root").sortWithinPartitions("root")
    bottom = written(grouped.mapInArrow(weighed, "id long, zeros double, ones double, whole double"), "ctw-roots")
    levels, below = [], bottom
    zeros, ones = F.col("zeros"), F.col("ones")
    for d in range(split - 1, -1, -1):
        sums = below.groupBy(F.col("id").bitwiseAND(F.lit(_mask(d))).alias("id")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("whole").alias("below"))
        block = sums.withColumn("block", _log_gamma_column(zeros + 0.5) + _log_gamma_column(ones + 0.5) - _log_gamma_column(zeros + ones + 1) - F.lit(float(np.log(np.pi))))
        mixed = F.greatest("block", "below") + F.log1p(F.exp(-F.abs(F.col("block") - F.col("below")))) + F.lit(float(np.log(0.5)))
        below = written(block.select("id", "zeros", "ones", "block", mixed.alias("whole")), "ctw-level")
        levels.insert(0, below)
    # Down again: what the nodes so far contribute to the chance of a one, and what is left for the deeper ones.
    down = None
    for d, level in enumerate(levels):
        weight = F.exp(F.col("block") + F.lit(float(np.log(0.5))) - F.col("whole"))
        own = level.select("id", weight.alias("weight"), ((ones + 0.5) / (zeros + ones + 1)).alias("own"))
        if d:
            own = own.withColumn("up", F.col("id").bitwiseAND(F.lit(_mask(d - 1)))).join(down.withColumnRenamed("id", "up"), "up")
        else:
            own = own.withColumns({"said": F.lit(0.0), "left": F.lit(1.0)})
        down = written(own.select("id", (F.col("said") + F.col("left") * F.col("weight") * F.col("own")).alias("said"), (F.col("left") * (1 - F.col("weight"))).alias("left")), "ctw-down")
    roots = bottom.select("id")
    if down is None:
        roots = roots.withColumns({"said": F.lit(0.0), "left": F.lit(1.0)})
    else:
        roots = roots.withColumn("up", F.col("id").bitwiseAND(F.lit(_mask(split - 1)))).join(down.withColumnRenamed("id", "up"), "up")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_root(batches):
            node, n, times = rows.column("id").to_numpy(), rows.column("n").to_numpy(), rows.column("times").to_numpy()
            above, gram = n < 0, n >= 0
            order = np.argsort(node[above])
            said, left = (rows.column(c).to_numpy()[above][order] for c in ("said", "left"))
            keys, log10 = node[gram], np.zeros(gram.sum())
            for ids, _, _, _, at, one, chance in _subtrees(keys, n[gram], depth, split):
                here = np.searchsorted(node[above][order], ids)[at]
                p = said[here] + left[here] * chance
                log10 += np.log10(np.where(one == 1, p, 1 - p))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times[gram]), pa.array(log10)], ["key", "times", "log10"])

    zero = F.lit(0.0)
    both = roots.select(root, "id", F.lit(-1).cast("long").alias("n"), F.lit(0).cast("long").alias("times"), "said", "left").unionByName(grams.select(root, "id", "n", "times", zero.alias("said"), zero.alias("left")))
    return written(both.repartition("root").sortWithinPartitions("root").mapInArrow(read, "key long, times long, log10 double"), "ctw-scores")


def _log_gamma_column(x: Column) -> Column:
    """:func:`_log_gamma` of a column."""
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    y = x + 8
    return (y - 0.5) * F.log(y) - y + F.lit(float(0.5 * np.log(2 * np.pi))) + 1 / (12 * y) - 1 / (360 * y * y * y) - F.log(product)


@dataclass
class Model:
    """A whole tree in memory, by which tests check the tables.

    States are reached by reading a context backwards. The first states have a row of next states by byte, the others are ends, with a row of log10
    probabilities of the text's next byte.
    """

    depth: int
    child: np.ndarray
    log10: np.ndarray

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 probability of each text."""
        symbols, at = _symbols(data, offsets, self.depth)
        child, log10, inner = self.child.ravel(), self.log10.ravel(), len(self.child)
        state = np.zeros(len(at), np.int32)
        live = np.arange(len(at)) if inner else np.zeros(0, np.int64)
        for d in range(1, self.depth + 1):
            now = child[(state[live].astype(np.int64) << 8) | symbols[at[live] - d]]
            state[live] = now
            live = live[now < inner]
        value = log10[((state.astype(np.int64) - inner) << 8) | symbols[at]]
        return np.add.reduceat(value, offsets[:-1] + np.arange(len(offsets) - 1), dtype=np.float64) if len(offsets) > 1 else np.zeros(0)


def weigh(contexts: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """Context-tree weighting over the kept contexts of each depth."""
    depth = len(contexts) - 1
    parents = [np.searchsorted(contexts[d - 1][0], contexts[d][0] & ((1 << (8 * (d - 1))) - 1)) for d in range(1, depth + 1)]
    inner = [np.bincount(p, minlength=len(contexts[d][0])) > 0 for d, p in enumerate(parents)] + [np.zeros(len(contexts[depth][0]), bool)]
    rest, own, weight = [], [], []
    whole = None
    for d in range(depth, -1, -1):
        table = contexts[d][1]
        left = table.copy()
        below = np.zeros((len(table), 255))
        if d < depth:
            np.subtract.at(left, parents[d], contexts[d + 1][1])
            np.add.at(below, parents[d], whole)
        zeros, ones = _bits(table)
        block = _block(zeros, ones)
        zeros_left, ones_left = _bits(left)
        mixed = np.logaddexp(block, below + _block(zeros_left, ones_left)) + np.log(0.5)
        whole = np.where(inner[d][:, None], mixed, block)
        weight.insert(0, np.where(inner[d][:, None], np.exp(block + np.log(0.5) - whole), 1.0))
        own.insert(0, (ones + 0.5) / (zeros + ones + 1))
        rest.insert(0, (ones_left + 0.5) / (zeros_left + ones_left + 1))
    # Down the tree: what the nodes so far contribute, and what is left for the deeper ones. Inner nodes are
    # numbered first; then their remaining leaves in the same order; then the nodes without children.
    n_inner, n_leaf = sum(int(x.sum()) for x in inner), sum(int((~x).sum()) for x in inner)
    child = np.repeat(np.arange(n_inner, 2 * n_inner, dtype=np.int32)[:, None], 256, 1)
    one = np.zeros((n_inner + n_leaf, 255))
    said, left, number, used, ended = np.zeros((1, 255)), np.ones((1, 255)), None, 0, 2 * n_inner
    for d in range(depth + 1):
        said = said + left * weight[d] * own[d]
        left = left * (1 - weight[d])
        above, number = number, np.zeros(len(inner[d]), np.int32)
        number[inner[d]] = used + np.arange(inner[d].sum())
        number[~inner[d]] = ended + np.arange((~inner[d]).sum())
        used, ended = used + int(inner[d].sum()), ended + int((~inner[d]).sum())
        one[number[inner[d]]] = (said + left * rest[d])[inner[d]]
        one[number[~inner[d]] - n_inner] = said[~inner[d]]
        if d:
            child[above[parents[d - 1]], contexts[d][0] >> (8 * (d - 1))] = number
        if d < depth:
            said, left = said[parents[d]], left[parents[d]]
    log10 = np.zeros((len(one), 256), np.float32)
    symbol = np.arange(256)
    for bit in range(8):
        at = (1 << bit) - 1 + (symbol >> (8 - bit))
        up = (symbol >> (7 - bit)) & 1
        log10 += np.log10(np.where(up, one[:, at], 1 - one[:, at]))
    return Model(depth, child, log10)


def train(texts: DataFrame, depth: int = DEPTH) -> tuple[int, DataFrame]:
    """The depth, and the counts of a ``text`` column from which texts are scored (kind, key, n)."""
    small_batches(texts.sparkSession)
    return depth, _count(texts, depth)


def score(docs: DataFrame, depth: int, counts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row."""
    spark = docs.sparkSession
    words = counts.filter("kind = 0").select(F.col("key").alias("word"), "n")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    bottom = n + 0.5 * (v + 1)
    often = words.filter(F.col("n") >= max(1.0, WORD_SHARE * n)).toPandas().sort_values("word")  # 1 / WORD_SHARE at most
    zero = F.lit(0).cast("long")
    asked = _count(docs.select(F.col(text).alias("text")), depth, with_words=False).select("key", zero.alias("n"), F.col("n").alias("times"))
    seen = counts.filter("kind = 1").select("key", "n", zero.alias("times")).unionByName(asked)
    grams = _gram_scores(seen.groupBy("key").agg(F.sum("n").alias("n"), F.sum("times").alias("times")), depth).filter("times > 0")
    total = grams.agg(F.sum("times")).first()[0] or 0
    common = grams.filter(F.col("times") >= max(1.0, GRAM_SHARE * total)).select("key", "log10").toPandas().sort_values("key")  # 1 / GRAM_SHARE at most
    hashes = often["word"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast((depth, common["key"].to_numpy(np.int64), common["log10"].to_numpy(np.float32), hashes, np.log10((often["n"].to_numpy(np.float64) + 0.5) / bottom)))
    parts = written(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(_scorer(shared), _PARTS), "ctw-parts")

    rest = parts.filter("gram IS NOT NULL").select("row", F.col("gram").alias("key"), F.col("n_tokens").alias("many")).join(grams.select("key", "log10"), "key")
    rest = rest.groupBy("row").agg(F.sum(F.col("many") * F.col("log10")).alias("rest"))
    known = parts.filter("word IS NOT NULL").select("row", "word", F.col("n_tokens").alias("times")).join(words, "word", "left")
    c = F.coalesce("n", F.lit(0))
    rare = known.groupBy("row").agg(F.sum(F.col("times") * F.log10((c + 0.5) / F.lit(bottom))).alias("rare"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    score = F.col("score") + F.coalesce("rest", F.lit(0.0))
    whole = parts.filter("word IS NULL AND gram IS NULL").join(rare, "row", "left").join(rest, "row", "left")
    return whole.select(
        F.col("id").alias(key),
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
        (-score / F.lit(float(np.log10(2))) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


_PARTS = "row long, id long, word long, gram long, n_tokens long, n_known long, n_bytes long, base double, score double"


def _scorer(shared: Broadcast):
    """Rows of texts, and rows (row, word or gram, times in n_tokens) of the words and grams that are left to the joins."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        depth, grams, chances, often, log10 = shared.value
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            size = batch.num_rows
            data, offsets = text_bytes(batch.column("text"))
            words, first = word_hashes(data, offsets)
            text = np.concatenate([np.repeat(np.arange(size), np.diff(first)), np.arange(size)])
            words = np.concatenate([words, np.full(size, _END_WORD)]).view(np.int64)
            at = np.minimum(np.searchsorted(often, words), max(0, len(often) - 1))
            here = often[at] == words if len(often) else np.zeros(len(words), bool)
            base = np.bincount(text[here], log10[at[here]] if len(often) else None, minlength=size)
            known = np.bincount(text[here], minlength=size)
            rows = row + np.arange(size)
            asked = _grams(data, offsets, depth).view(np.int64)
            of = np.repeat(np.arange(size), np.diff(offsets) + 1)
            place = np.minimum(np.searchsorted(grams, asked), max(0, len(grams) - 1))
            found = grams[place] == asked if len(grams) else np.zeros(len(asked), bool)
            score = np.bincount(of[found], chances[place[found]] if len(grams) else None, minlength=size).astype(np.float64)
            none = pa.nulls(size, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), batch.column("id").cast(pa.int64()), none, none, pa.array(np.diff(first) + 1), pa.array(known.astype(np.int64)), pa.array(np.diff(offsets)), pa.array(base.astype(np.float64)), pa.array(score)],
                _PART_NAMES,
            )
            # The others, each distinct word and gram of a text once.
            for column, texts, values in ((2, text[~here], words[~here]), (3, of[~found], asked[~found])):
                order = np.lexsort((values, texts))
                texts, values = texts[order], values[order]
                new = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (texts[1:] != texts[:-1])])) if len(values) else np.zeros(0, np.int64)
                none, blank = pa.nulls(len(new), pa.int64()), pa.nulls(len(new), pa.float64())
                out = [pa.array(rows[texts[new]]), none, none, none, pa.array(np.diff(np.append(new, len(values))).astype(np.int64)), none, none, blank, blank]
                out[column] = pa.array(values[new])
                yield pa.RecordBatch.from_arrays(out, _PART_NAMES)
            row += size

    return scored


_PART_NAMES = ["row", "id", "word", "gram", "n_tokens", "n_known", "n_bytes", "base", "score"]
