"""Windows over hot scopes by ranges, and models of several universes from one grouping, against plain versions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import overlay, report


def snapshots(seed):
    rng = random.Random(seed)
    rows = [("hot", i, rng.choice("AAB")) for i in range(600)] + [(f"s{rng.randrange(20)}", i, rng.choice("AB")) for i in range(1000, 1200)]
    rows += [(None, i, rng.choice(["A", None])) for i in range(2000, 2040)] + [("gap", 3000, None), ("gap", 3001, None), ("gap", 3002, "A"), ("none", 4000, None)]
    rng.shuffle(rows)
    return rows


def plain_versions(rows):
    out, last = {}, {}
    for scope, order, content in sorted(rows, key=lambda r: r[1]):
        digest = None if content is None else hashlib.sha256(content.encode()).hexdigest()
        before, version = last.get(scope, (None, 0))
        version += digest != before
        out[scope, order] = (version, digest == before)
        last[scope] = (digest, version)
    return out


@pytest.mark.parametrize("in_task", [10**6, 10])
def test_versions(spark, in_task):
    rows = snapshots(3)
    df = spark.createDataFrame(rows, "scope string, place int, content string").repartition(7)
    got = report.versions(df, "scope", "place", "content", in_task)
    assert set(got.columns) == {"scope", "place", "content", "content_hash", "version", "reused"}
    assert {(r["scope"], r["place"]): (r["version"], r["reused"]) for r in got.collect()} == plain_versions(rows)
    assert report.versions(df.limit(0), "scope", "place", "content", in_task).collect() == []


def test_versions_of_one_place(spark):
    """Snapshots of the same place are taken by their hashes, in ranges as in one task."""
    rows = [("s", i // 50, "AB"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "scope string, place int, content string")
    counts = [sorted((r["place"], r["content"], r["version"], r["reused"]) for r in report.versions(df, "scope", "place", "content", n).collect()) for n in (10**6, 10)]
    assert counts[0] == counts[1] and max(r[2] for r in counts[0]) == 16


@pytest.mark.parametrize("in_task", [10**6, 10])
def test_spans_of_two_keys(spark, in_task):
    rng = random.Random(5)
    rows = [("hot", None, i) for i in range(500)] + [(rng.choice("ab"), rng.randrange(3), i) for i in range(100)]
    rng.shuffle(rows)
    want = {}
    for key in {r[:2] for r in rows}:
        numbers = sorted(r[2] for r in rows if r[:2] == key)
        want |= {(*key, n): after for n, after in zip(numbers, [*numbers[1:], None], strict=True)}
    got = overlay.spans(spark.createDataFrame(rows, "k string, j int, revision int"), ["k", "j"], in_task=in_task)
    assert got.columns == ["k", "j", "revision", "valid_from", "valid_to"]
    assert {(r["k"], r["j"], r["valid_from"]): r["valid_to"] for r in got.collect()} == want


def test_no_task_gets_a_hot_scope(spark):
    """Half of all rows are of one scope, and no range has more than twice the rows of the median one."""
    from tessera.operators import ranges

    rows = spark.range(20_000).selectExpr("IF(id % 2 = 0, -1, id) AS scope", "id AS place")
    sizes = sorted(r["count"] for r in ranges.ranged(rows, ["scope"], ["place"], ranges.needed(rows, ["scope"], 2_000)).groupBy("_part").count().collect())
    assert ranges.needed(rows, ["scope"], 10_000) == 1
    assert len(sizes) > 2 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_models(spark):
    notes = spark.createDataFrame([("p", "q", 5, 1), ("p", None, 7, 2), (None, "q", None, 4)], "declared string, audited string, amount long, related long")
    entries = spark.createDataFrame([("q", "Pagamento", 3), ("r", "Custo", 9), (None, "Pagamento", 11)], "project string, kind string, cents long")
    paid = F.when(F.col("kind") == "Pagamento", F.col("cents"))
    got = report.models("project", (notes, {"invoiced": (F.col("declared"), F.col("amount")), "related": (F.col("audited"), F.col("related"))}), (entries, {"paid": (F.col("project"), paid), "lost": (F.col("project"), F.when(F.col("kind") == "none", F.col("cents")))}))
    assert {(r["model"], r["project"]): tuple(r)[2:] for r in got.collect()} == {
        ("project", "p"): (12, 2, None, 0, None, 0, None, 0), ("project", "q"): (None, 0, 5, 2, 3, 1, None, 0), ("global", None): (12, 2, 7, 3, 14, 2, None, 0),
    }
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2
    assert [tuple(r)[:4] for r in report.models("project", (notes.limit(0), {"n": (F.col("declared"), F.col("amount"))})).collect()] == [("global", None, None, 0)]
