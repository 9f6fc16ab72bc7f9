"""Near duplicates by fast similarity sketches, banding and exact verification.

A sketch (Dahlgaard, Knudsen and Thorup, "Fast Similarity Sketching", 2017) has ``COORDINATES`` coordinates. In
round i every shingle of a set is thrown into one bin by a hash of that round and carries the value i plus a
fraction; a bin keeps its least value, so a bin that an earlier round filled stays. From round ``COORDINATES`` on,
round ``COORDINATES + b`` throws all shingles into bin b alone: after twice as many rounds as there are coordinates
none is empty, and sets with more shingles need a round or two. A coordinate of two sets agrees with the
probability of their Jaccard similarity, and the number of those that agree concentrates as in independent samples.

``ROWS`` neighbouring coordinates make a band, whose hash is a key. At a similarity of 0.8 a pair has no key in common
with probability (1 - 0.8^5)^52 < 2e-9, and above it with less. Documents with a common key are chained, verified and
joined to components by :mod:`tessera.llm.ngram_join`: bitmaps bound the difference of two sets from below, what they
let pass is compared on full sets, and no list of all pairs of a bucket arises.

Shingles are 64-bit hashes. Null texts count as empty; documents without words have size 0 and no links. Equal
sets fall into one and get the same result; rows that share an id but not the text go by their own sets, linked by
any. A null id gets its size, a null component, and is kept. Extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_worker, mix, small_batches, tidied, written
from tessera.llm.ngram_join import Threshold, bitmap, digest, oracle, placed, sets_of

#: Coordinates of a band, bands, and coordinates in all.
ROWS, BANDS = 5, 52
COORDINATES = ROWS * BANDS
#: Hashes that one step of a sketch computes, about: small sets take many rounds at once.
_STEP = 4096
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ROUND, _EMPTY = np.uint64(52), np.uint64(0xFFFFFFFFFFFFFFFF)


def sketch(own: np.ndarray) -> np.ndarray:
    """The coordinates of a set of distinct hashes, not empty: the round in the high bits, the fraction below."""
    out = np.full(COORDINATES, _EMPTY, np.uint64)
    at = 0
    while at < 2 * COORDINATES:
        rounds = np.arange(at, min(2 * COORDINATES, at + max(1, _STEP // len(own))), dtype=np.uint64)
        hashes = mix(own[None, :] ^ mix((rounds + np.uint64(1)) * _ODD)[:, None])
        value = (rounds << _ROUND)[:, None] | (hashes >> np.uint64(12))
        # The low 12 bits aren't part of the value; 32 more bits of another mix choose the bin.
        thrown = (mix(hashes + _ODD) >> np.uint64(32)) * np.uint64(COORDINATES) >> np.uint64(32)
        late = rounds >= COORDINATES
        thrown[late] = (rounds[late] - np.uint64(COORDINATES))[:, None]
        np.minimum.at(out, thrown.ravel().astype(np.int64), value.ravel())
        at += len(rounds)
        if out.max() != _EMPTY:
            return out
    return out


_PLACES = mix(np.arange(1, ROWS + 1, dtype=np.uint64) * _ODD) | np.uint64(1)
_BAND = mix(np.arange(7001, 7001 + BANDS, dtype=np.uint64) * _ODD)


def band_keys(own: np.ndarray) -> np.ndarray:
    """A hash of every band of a set's sketch."""
    return mix((sketch(own).reshape(BANDS, ROWS) * _PLACES).sum(1) + _BAND)


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(``key``, n_shingles, component_id, kept) of every row of ``docs``; ``key`` is whole numbers.

    Kept is the least id of each component.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for batch in batches:
            n, digests, bits = [], [], []
            for own in sets_of(batch, k):
                n.append(len(own))
                bits.append(bitmap(own).view(np.int64))
                digests.append(digest(own))
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            width = np.concatenate([[0], np.cumsum([len(b) for b in bits])]).astype(np.int32)
            maps = pa.ListArray.from_arrays(pa.array(width), pa.array(np.concatenate([*bits, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), maps], ["id", "n", "hi", "lo", "bits"])

    with tidied() as keep:
        stats = written(source.mapInArrow(measured, "id long, n long, hi long, lo long, bits array<long>"), "sketched-sets")
        found = placed(source, stats, k, band_keys, Threshold(percent), key)
        return keep(found.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True))))


ORACLE = f"SELECT *, doc_id = component_id AS kept FROM ({oracle(2, 80)})"
