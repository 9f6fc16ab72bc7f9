"""The second derivation agrees with the first, and names every planted fault by its kind."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from tessera.operators import rederive
from tessera.plans import reconciling
from tessera.storage import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def both(spark):
    evidence, submitted = reconciling.submitted(spark, SF)
    derived = rederive.derive(*evidence, ["customer", "day"], "batch")
    return {k: written(v, k) for k, v in derived.items()}, [written(s, "submitted") for s in submitted]


def kinds(derived, submitted):
    return {(r["kind"], r["key"]) for r in rederive.differences(derived, *submitted).collect()}


def test_both_derivations_agree(both):
    derived, submitted = both
    assert kinds(derived, submitted) == set()
    assert {r["category"] for r in derived["classified"].collect()} == {"unchanged", "updated", "created", "rejected", "kept", "conflict"}
    assert derived["diffs"].count() and derived["absent"].count()


@pytest.mark.parametrize("kind", ["ids", "candidates", "category", "diffs", "absences", "summary"])
def test_planted_faults(both, kind):
    derived, (whole, diffs, absent, summary) = both
    line = whole.agg(F.max("line")).first()[0]
    hit = F.col("line") == line
    if kind in ("ids", "candidates", "category"):
        column, value = {"ids": ("observation", F.lit("x")), "candidates": ("n_candidates", F.lit(77).cast("long")), "category": ("category", F.lit("x"))}[kind]
        whole, want = whole.withColumn(column, F.when(hit, value).otherwise(F.col(column))), {(kind, str(line))}
    elif kind == "diffs":
        one = diffs.orderBy("line", "field").first()
        diffs, want = diffs.filter(~((F.col("line") == one["line"]) & (F.col("field") == one["field"]))), {("diffs", f"{one['line']}/{one['field']}")}
    elif kind == "absences":
        absent, want = absent.unionByName(absent.sparkSession.createDataFrame([(-1,)], "record long").select(F.col("record").cast(absent.schema["record"].dataType))), {("absences", "-1")}
    else:
        summary, want = summary.withColumn("n_updated", F.col("n_updated") + 1), {("summary", "n_updated")}
    assert kinds(derived, (whole, diffs, absent, summary)) == want


def test_a_submitted_batch_is_computed_once(spark):
    (lines, records, _), (whole, diffs, absent, summary) = reconciling.submitted(spark, SF)
    for frame in (lines, records, whole, diffs, absent, summary):
        assert not [f for f in frame.inputFiles() if "orders.parquet" in f]


def test_no_table_of_the_batch_is_broadcast(spark, monkeypatch):
    """All tables grow with the batch, and as compressed files they look smaller than they are; these here are small enough for a broadcast wherever a plan leaves the choice."""
    plans = []

    def seen(df):
        with redirect_stdout(io.StringIO()) as out:
            df.explain()
        plans.append(out.getvalue())
        return df

    for module in (rederive, reconciling):
        monkeypatch.setattr(module, "written", lambda df, name: written(seen(df), name))
    evidence, given = reconciling.submitted(spark, SF)
    seen(rederive.differences(rederive.derive(*evidence, ["customer", "day"], "batch"), *given))
    assert sum(p.count("SortMergeJoin") for p in plans) > 10
    assert [p for p in plans if "BroadcastHashJoin" in p] == []


def test_contents_and_targets_by_hand(spark):
    maps = "map<string,string>"
    lines = [
        (1, {"a": "1", "b": None, "curso": "x"}, None, "p"),  # reserved keys don't count
        (2, {"a": "2", "c": None}, None, "q"),
        (3, {"a": "1"}, {}, "r"),  # no map isn't an empty one
        (4, None, None, "s"),
        (5, {"a": "1"}, None, " "),  # blank: no candidate
        (6, {"a": "1"}, None, "t"),  # two records
        (7, {"a": "1"}, None, None),
        (8, {"a": "1"}, None, "u"),
        (9, {"a": "1"}, None, "u"),  # the same record as 8
    ]
    records = [(11, {"a": "1", "b": None}, None, "p"), (12, {"a": "1", "b": None}, None, "q"), (13, {"a": "1"}, None, "r"), (14, {"a": None}, None, "s"), (15, {"a": "1"}, None, "t"), (16, {"a": "1"}, None, "t"), (17, {"a": "1"}, None, " "), (18, {"a": "1"}, None, "u")]
    decisions = spark.createDataFrame([(1, 7, "link", 99, 1), (2, 7, "reject", None, 0), (3, 77, "keep", 17, 0)], "decision_id long, line long, outcome string, record long, revision int")
    records = spark.createDataFrame([(*r, 1, "active") for r in records], f"record long, payload {maps}, provenance {maps}, x string, layer int, state string")
    out = rederive.derive(spark.createDataFrame(lines, f"line long, payload {maps}, provenance {maps}, x string"), records, decisions, ["x"], "b")
    got = {r["line"]: (r["category"], r["conflict"], r["target"], r["n_candidates"]) for r in out["classified"].collect()}
    assert got == {
        1: ("unchanged", None, 11, 1), 2: ("updated", None, 12, 1), 3: ("updated", None, 13, 1), 4: ("updated", None, 14, 1), 5: ("conflict", "NO_CANDIDATE", None, 0),
        6: ("conflict", "MULTIPLE", None, 2), 7: ("conflict", "NO_CANDIDATE", 99, 0), 8: ("conflict", "DUPLICATE_TARGET", 18, 1), 9: ("conflict", "DUPLICATE_TARGET", 18, 1),
    }
    assert {tuple(r) for r in out["diffs"].collect()} == {(2, "a", "1", "2", "changed"), (2, "b", None, None, "removed"), (2, "c", None, None, "added"), (4, "a", None, None, "removed")}
    assert {r["record"] for r in out["absent"].collect()} == {15, 16, 17}
    assert out["summary"].first().asDict() == {"n_unchanged": 1, "n_updated": 3, "n_created": 0, "n_rejected": 0, "n_kept": 0, "n_conflict": 5, "n_lines": 9, "n_absent": 3}
