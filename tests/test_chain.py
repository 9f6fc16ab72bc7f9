"""Revisions as chained deltas: replays from any base, spans, running metrics, tampering."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import chain

FIELDS = ["category", "target"]
SIDES = ["from_category", "from_target", "to_category", "to_target"]


def history(seed=3, lines=60, revisions=25):
    draw = random.Random(seed)
    rows = [(0, i, draw.choice("abc"), draw.choice([None, *range(8)])) for i in range(lines)]
    for r in range(1, revisions):
        rows += [(r, i, draw.choice("abc"), draw.choice([None, *range(8)])) for i in draw.sample(range(lines), 4)]
    return rows


@pytest.fixture(scope="module")
def versions(spark):
    return spark.createDataFrame(history(), "revision int, line long, category string, target long").repartition(5).cache()


def states():
    """Lines after each revision."""
    now, out = {}, {}
    for r, i, c, t in history():
        now[i] = (c, t)
        out[r] = dict(now)
    return out


def test_deltas_lead_from_any_state_to_the_next(versions):
    plain, changes = states(), {}
    for r in chain.line_deltas(versions, FIELDS).collect():
        assert plain[r["revision"] - 1][r["line"]] == (r["from_category"], r["from_target"])
        changes.setdefault(r["revision"], {})[r["line"]] = (r["to_category"], r["to_target"])
    for base in (0, 7, 20):
        now = dict(plain[base])
        for r in range(base + 1, max(plain) + 1):
            now |= changes.get(r, {})
            assert now == plain[r]


def test_spans_and_metrics_at_every_revision(spark, versions):
    plain, deltas, base = states(), chain.line_deltas(versions, FIELDS), versions.filter("revision = 0")
    records = spark.createDataFrame([(i,) for i in range(12)], "record long")
    spans = [tuple(s) for s in chain.absence_spans(chain.bucket_deltas(deltas, base), records).collect()]
    totals = chain.totals_at(chain.metric_deltas(deltas), base.groupBy(F.col("category").alias("metric")).agg(F.count("*").alias("n"))).collect()
    for r, lines in plain.items():
        absent = {i for i in range(12)} - {t for _, t in lines.values()}
        assert {i for i, a, b in spans if a <= r and (b is None or r < b)} == absent
        for c in "abc":
            last = max((t for t in totals if t["metric"] == c and t["revision"] <= r), key=lambda t: t["revision"])
            assert last["n"] == sum(x == c for x, _ in lines.values())
    assert len({s[:2] for s in spans}) == len(spans)


@pytest.mark.parametrize(("lines", "revisions"), [(4096, 1024), (16, 4)])
def test_a_changed_revision_breaks_the_chain_from_there_on(monkeypatch, versions, lines, revisions):
    monkeypatch.setattr(chain, "LINES", lines)
    monkeypatch.setattr(chain, "REVISIONS", revisions)
    deltas = chain.line_deltas(versions, FIELDS).cache()
    stored = chain.chained(chain.revision_hashes(deltas, SIDES), "seed").cache()
    assert all(r["holds"] for r in chain.verified(stored, deltas.repartition(7), SIDES, "seed").collect())
    assert not any(r["holds"] for r in chain.verified(stored, deltas, SIDES, "other").collect())
    first = deltas.filter("revision = 9").agg(F.min("line")).first()[0]
    hit = (F.col("revision") == 9) & (F.col("line") == first)
    for changed in (deltas.withColumn("to_target", F.when(hit, 99).otherwise(F.col("to_target"))), deltas.filter(~hit)):
        assert {r["revision"]: r["holds"] for r in chain.verified(stored, changed, SIDES, "seed").collect()} == {r["revision"]: r["revision"] < 9 for r in stored.collect()}


def test_values_run_into_each_other_in_no_hash(spark):
    rows = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "-"), ("-", None), ("", None)], "a string, b string")
    assert rows.select(chain.row_hash(["a", "b"]).alias("h")).distinct().count() == 5


def test_no_revisions(spark, versions):
    base = versions.filter("revision = 0")
    deltas = chain.line_deltas(base, FIELDS)
    assert deltas.count() == 0 and chain.chained(chain.revision_hashes(deltas, SIDES), "seed").count() == 0
    empty = spark.createDataFrame([], base.schema)
    assert chain.absence_spans(chain.bucket_deltas(chain.line_deltas(empty, FIELDS), empty), spark.createDataFrame([(1,)], "record long")).collect() == [(1, 0, None)]
