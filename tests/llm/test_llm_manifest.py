"""Merkle manifests, fast similarity sketches and bounded clustering against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import centroids, merkle, near_dedup, ngram_join
from tests.llm.test_llm_corpus import frame, linked, near_copies

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
DOCUMENTS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root long, `tree` string"


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def plain_manifest(rows):
    """Expected rows by recursion over lists: (doc_id, leaf, subroot, root, proof, folded root, verified)."""
    low = str.maketrans(merkle._UPPERS, merkle._LOWERS)

    def leaf(row, text):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))

    def grown(hashes):
        """The root, and each member's path."""
        paths, at = [[] for _ in hashes], [[i] for i in range(len(hashes))]
        while len(hashes) > 1:
            runs = [list(range(i, min(i + 8, len(hashes)))) for i in range(0, len(hashes), 8)]
            for run in runs:
                for i in run:
                    for member in at[i]:
                        paths[member].append(("".join(hashes[j] for j in run if j < i), "".join(hashes[j] for j in run if j > i)))
            at = [sum((at[i] for i in run), []) for run in runs]
            hashes = [h(*(hashes[i] for i in run)) for run in runs]
        return hashes[0], paths

    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row, row[4]), row))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: grown([m[2] for m in sorted(groups[g], key=lambda m: m[:3])]) for g in order}
    root, above = grown([trees[g][0] for g in order])
    out = []
    for g, tail in zip(order, above, strict=True):
        for (_, _, own, row), path in zip(sorted(groups[g], key=lambda m: m[:3]), trees[g][1], strict=True):
            path = path + tail
            changed = row[4]
            if changed is not None and zlib.crc32(("" if row[0] is None else str(row[0])).encode()) % 3 == 0:
                changed = changed.translate(low)
            folded = leaf(row, changed)
            for before, after in path:
                folded = h(before, folded, after)
            out.append((row[0], own, trees[g][0], root, h(*(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=str)


def by_spark(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1, None) for r in rows], DOCUMENTS)
    found = merkle.manifest(docs, "doc_id", "lang", FIELDS, {"text": merkle.changed_case(F.col("doc_id"), F.col("text"))})
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_manifest_of_groups_of_all_sizes(spark):
    """Trees of 1 to 600 leaves, an upper tree of two levels, null groups, keys and texts, repeated rows, a long text."""
    rng = random.Random(4)
    rows = []
    for g, n in [(None, 3), ("", 2), ("é", 9), ("z", 1), ("aa", 600), *((f"g{i}", rng.choice([1, 7, 8, 9, 64, 65])) for i in range(20))]:
        rows += [(rng.randrange(10**6), rng.choice(["web", None, ""]), g, rng.choice([None, 3]), rng.choice(["Text Ä", "", None, "lower", "X" * 50])) for _ in range(n)]
    rows += [(5, "web", "aa", 1, "Long " * 200_000), (7, "a", "z", 1, "Two"), (7, "a", "z", 1, "Two"), (7, "a", "z", 2, "Three"), (None, None, None, None, None), (None, "web", "é", 1, "A null key")]
    rng.shuffle(rows)
    got = by_spark(spark, rows)
    assert got == plain_manifest(rows)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("rows", [[], [(1, "a", "en", 2, "One")], [(i, "a", "en", 2, "One") for i in range(9)], [(1, "a", None, 2, "One"), (2, "a", "", 2, "One")]])
def test_manifest_of_few_rows(spark, rows):
    assert by_spark(spark, rows) == (plain_manifest(rows) if rows else [])


def test_a_changed_row_changes_the_root(spark):
    rows = [(i, "a", "en" if i % 3 else "fr", i, f"text {i}") for i in range(100)]
    roots = {by_spark(spark, [(*r[:4], "other") if r[0] == i else r for r in rows])[0][3] for i in (None, 0, 50, 99)}
    assert len(roots) == 4


def test_parents_wait_for_as_many_children_as_they_have():
    for n in (1, 7, 8, 9, 63, 64, 65, 512, 513):
        due = {}
        for place in range(n):
            key, _, _, count = merkle.parent((0, 0, place), n, 1)
            due.setdefault(key, []).append(count)
        assert all(len(v) == v[0] for v in due.values())


def test_sketches_fill_and_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(3)
    draw = lambda n: np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
    for n in (1, 2, 5, 40, 300, 5000):
        agree = []
        for _ in range(20):
            both, a, b = draw(n), draw(max(1, n // 8)), draw(max(1, n // 8))
            x, y = np.union1d(both, a), np.union1d(both, b)
            agree.append((near_dedup.sketch(x) == near_dedup.sketch(y)).mean() - len(np.intersect1d(x, y)) / len(np.union1d(x, y)))
            assert near_dedup.sketch(x).max() != near_dedup._EMPTY
        assert abs(np.mean(agree)) < 0.03
    own = draw(30)
    assert (near_dedup.band_keys(own) == near_dedup.band_keys(own.copy())).all() and len(set(near_dedup.band_keys(own).tolist())) == near_dedup.BANDS


@pytest.mark.parametrize(("k", "percent", "others"), [(2, 80, 4096), (5, 80, 4096), (2, 80, 0)])
def test_sketches_lose_no_link(spark, monkeypatch, k, percent, others):
    monkeypatch.setattr(ngram_join, "OTHERS", others)
    monkeypatch.setattr(ngram_join, "TRIALS", 1)
    rng = random.Random(11)
    texts = near_copies(rng, 160) + ["one", "one two", "One\x0btwo", "\x00 \x85", "a " * 30_000, "a " * 30_001, " ".join(f"v{i}" for i in range(20_000))]
    want = linked(texts, k, percent)
    rows = near_dedup.link(frame(spark, texts), k=k, percent=percent).collect()
    got = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None}
    assert [got[i] for i in range(len(texts))] == want
    assert len(rows) == len(texts) + 4 and got[900] == 900 and got[901] == 901
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in rows)
    assert near_dedup.link(frame(spark, texts).limit(0)).collect() == []


def plain_clusters(vectors, k, rounds, steps=64):
    """(cluster, distance) by id, and the final centroids, with all distances in whole numbers."""
    kept = {i: [math.floor(steps * x) for x in v] for i, v in vectors.items()}
    order = sorted(kept, key=lambda i: (hashlib.sha256(f"1:{i}".encode()).hexdigest(), kept[i]))
    centres = [kept[i] for i in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        members = {}
        for v in kept.values():
            members.setdefault(near(v)[1], []).append(v)
        centres = [[sum(x) // len(members[j]) for x in zip(*members[j], strict=True)] if j in members else c for j, c in enumerate(centres)]
    return {i: near(v)[::-1] for i, v in kept.items()}, centres


@pytest.mark.parametrize(("k", "rounds", "spread"), [(16, 3, 3.0), (16, 8, 0.3), (5, 3, 0.01), (1, 2, 1.0), (40, 4, 1.0)])
def test_clusters_by_all_distances(spark, k, rounds, spread):
    """Clouds, ties (coarse components), equal vectors; rows that are left out; clashing columns."""
    rng = random.Random(k)
    clouds = [[rng.uniform(-2, 2) for _ in range(8)] for _ in range(7)]
    vectors = {i: [c + rng.gauss(0, spread) for c in rng.choice(clouds)] for i in range(300)}
    vectors |= {i: [float(rng.randrange(2)) for _ in range(8)] for i in range(300, 400)} | {i: [0.5] * 8 for i in range(400, 420)}
    odd = [(900, None), (901, []), (902, [1.0] * 7), (903, [1.0] * 7 + [None]), (904, [math.nan] * 8), (905, [math.inf] + [0.0] * 7), (906, [1e30] * 8)]
    rows = [(i, v, "x", 9, "y") for i, v in [*vectors.items(), *odd]]
    frame_ = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string, distance long, vec string").repartition(3)
    got = {r["vec_id"]: r for r in centroids.cluster(frame_, k=k, dimension=8, rounds=rounds).collect()}
    want, centres = plain_clusters(vectors, k, rounds)
    assert {i: (r["cluster"], r["distance"]) for i, r in got.items()} == want
    for r in got.values():
        assert r["cluster_inertia"] == sum(d for c, d in want.values() if c == r["cluster"]) and r["inertia"] == sum(d for _, d in want.values())
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centres[r["cluster"]])).encode()).hexdigest()


def test_clusters_of_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [3.0, -2.01]), (None, [0.0, 0.0])]
    got = centroids.cluster(spark.createDataFrame(rows, schema), dimension=2).collect()
    assert len(got) == 4 and len({r["cluster"] for r in got}) == 3 and {r["distance"] for r in got} == {0}
    assert centroids.cluster(spark.createDataFrame([], schema)).collect() == []
    assert centroids.cluster(spark.createDataFrame([(1, None), (2, [math.nan] * 64)], schema)).collect() == []


def test_bounds_spare_distances():
    """Over rounds of small moves the bounds give the same clusters with a fraction of the distances."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-400, 400, (16, 64))
    vectors = centres[rng.integers(0, 16, 2000)] + rng.integers(-40, 40, (2000, 64))
    centres = centres + rng.integers(-60, 60, centres.shape)
    first = centroids.Bounded(centres, None, 4)
    cluster, distance, near, bounds = first.scanned(vectors)
    assert first.computed == 2000 * 16
    for kept in (4, 3, 2, 2):
        moves = rng.integers(-3, 3, centres.shape)
        centres = centres + moves
        moved = np.sqrt((moves**2).sum(1)) * (1 + 1e-9)
        by = centroids.Bounded(centres, moved, kept)
        cluster, distance, near, bounds, place = by.moved_on(vectors, cluster, near, bounds)
        far = centroids.squared(vectors, centres)
        assert (cluster == far.argmin(1)).all() and (distance == far.min(1)).all()
        assert near.shape == (2000, kept) and bounds.shape == (2000, kept + 1) and by.computed < 0.3 * far.size and place.min() == 0
        assert (bounds[:, :kept] <= np.sqrt(np.take_along_axis(far, near.astype(np.int64), 1))).all()
