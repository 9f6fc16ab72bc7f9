"""Batches applied as versions: one of two writers wins, replays get the frozen answer."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tessera.operators import reconcile
from tessera.sources import commits


def batch(spark, first, n, category="updated"):
    lines = spark.range(first, first + n).select(F.col("id").alias("line"), F.col("id").alias("target"), F.lit(category).alias("category"), F.lit(None).cast("string").alias("outcome"))
    return lines, reconcile.events(lines, "b")


def test_versions_follow_each_other(spark, tmp_path):
    root = f"file://{tmp_path}/ledger"
    one, two = batch(spark, 0, 10), batch(spark, 5, 10)
    assert commits.version(spark, root) == 0 and commits.read_events(spark, root) is None
    a = commits.apply(root, "r1", 0, *one)
    assert (a.version, a.n_events, a.reused) == (1, 10, False)
    with pytest.raises(commits.Refused) as e:
        commits.apply(root, "r2", 0, *two)
    assert e.value.gates == ["base_version"]
    b = commits.apply(root, "r2", 1, *two)
    assert (b.version, b.n_lines, b.n_events) == (2, 10, 5)
    # A request sent again gets what it was told, though the ledger has moved on; under its name nothing else is applied.
    again = commits.apply(root, "r1", 7, *one)
    assert again.reused and again.version == 1 and again.content == a.content and commits.version(spark, root) == 2
    with pytest.raises(commits.Refused) as e:
        commits.apply(root, "r1", 2, *two)
    assert e.value.gates == ["request"]
    assert commits.read_events(spark, root).groupBy("version").count().orderBy("version").collect() == [(1, 10), (2, 5)]
    assert commits.read_events(spark, root, 1).count() == 10
    assert sorted(r["line"] for r in commits.frozen(spark, root, again).collect()) == list(range(10))
    assert commits.unnamed(spark, root) == []


def test_gates(spark, tmp_path):
    root = f"file://{tmp_path}/ledger"
    waiting, events = batch(spark, 0, 3, "conflict")
    twice = waiting.withColumns({"target": F.lit(1).cast("long"), "category": F.lit("updated")})
    for lines, gate in ((waiting, "nothing_waits"), (twice, "unique_targets")):
        with pytest.raises(commits.Refused) as e:
            commits.apply(root, "r", 0, lines, events)
        assert e.value.gates == [gate]
    assert commits.version(spark, root) == 0 and commits.unnamed(spark, root) == []
    assert commits.apply(root, "empty", 0, waiting.limit(0), events.limit(0)).n_events == 0


@pytest.mark.parametrize("requests", [("r1", "r2"), ("r1", "r1")])
def test_two_writers_on_one_base(spark, tmp_path, monkeypatch, requests):
    """Both pass the gates before either writes its entry."""
    import threading

    root, both = f"file://{tmp_path}/ledger", threading.Barrier(2)
    put = commits.put_if_absent

    def together(*args):
        both.wait(60)
        return put(*args)

    monkeypatch.setattr(commits, "put_if_absent", together)

    def write(i):
        lines, events = batch(spark, 0 if requests[0] == requests[1] else 10 * i, 10)
        try:
            return commits.apply(root, requests[i], 0, lines, events)
        except commits.Refused as e:
            return e.gates

    with ThreadPoolExecutor(2) as pool:
        found = list(pool.map(write, range(2)))
    won = [f for f in found if isinstance(f, commits.Applied)]
    if requests[0] == requests[1]:
        assert len(won) == 2 and sorted(w.reused for w in won) == [False, True] and won[0].data == won[1].data
    else:
        assert len(won) == 1 and ["base_version"] in found
    assert commits.version(spark, root) == 1 and commits.read_events(spark, root).count() == 10 and commits.unnamed(spark, root) == []


def test_a_rename_that_overwrites_nothing(spark, tmp_path):
    """By a file system other than the local one."""
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.commits.link./in", f"file://{tmp_path}")
    path = "viewfs://commits/in/log/1.json"
    assert commits.put_if_absent(spark, path, '{"a": 1}') and not commits.put_if_absent(spark, path, '{"a": 2}')
    assert (tmp_path / "log/1.json").read_text() == '{"a": 1}'
    assert [f.name for f in (tmp_path / "log").iterdir() if not f.name.endswith(".crc")] == ["1.json"]


def test_a_batch_is_computed_for_its_fingerprint_and_once_to_freeze_it(spark, tmp_path):
    computed = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            computed.add(len(batch))
            yield batch

    lines = spark.range(10).selectExpr("id AS line", "id AS target", "'updated' AS category")
    counted = lines.mapInPandas(seen, lines.schema)
    events = lines.selectExpr("cast(line AS string) AS event_id", "line")
    assert commits.apply(f"file://{tmp_path}/counted", "r", 0, counted, events).n_lines == 10
    assert computed.value == 20
    with pytest.raises(commits.Refused):
        commits.apply(f"file://{tmp_path}/counted", "late", 0, lines.filter("line < 5"), events)
    assert commits.unnamed(spark, f"file://{tmp_path}/counted") == []
