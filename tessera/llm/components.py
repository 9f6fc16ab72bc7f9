"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_written, written

#: Edges that a task gets, about, and nodes that it holds before it passes their trees on.
EDGES, HELD = 200_000, 2_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the trees that a task's own edges make; a root is the least node of its tree and has a row."""
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def trees() -> pa.RecordBatch:
        nodes = list(parent)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(i) for i in nodes], pa.int64())], ["node", "root"])

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        if len(parent) >= HELD:
            yield trees()
            parent.clear()
    yield trees()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of ``edges`` (a, b: long) is connected with; written.

    Each task first joins its own edges to trees, so a node leaves a task once, however many edges it
    has. Where trees of several tasks share a node, their roots are linked; these fewer links are
    solved the same way until no task shares any, and the labels are carried back. The grouping by node sees a
    node at most once for each task; the joins by root have tables on both sides, so adaptive execution
    can split a large component. Every step is written to the shared folder, so a lost
    executor costs one step at most. Loops, repeated edges and edges with a null end count for nothing;
    a node without other neighbours has no row.
    """
    return _contracted(written(edges.select("a", "b").filter("a != b"), "edges"))


def _contracted(edges: DataFrame) -> DataFrame:
    # The fewer links are left, the fewer tasks share them, so that the last ones meet in one.
    tasks = -(-edges.count() // EDGES)
    forest = edges.coalesce(max(1, tasks)).mapInArrow(_forest, "node long, root long")
    if tasks <= 1:
        out = written(forest.withColumnRenamed("root", "component"), "components")
        drop_written(edges)
        return out
    met = written(forest.groupBy("node").agg(F.min("root").alias("low"), F.collect_set("root").alias("roots")), "trees")
    drop_written(edges)
    between = written(met.filter(F.size("roots") > 1).select(F.explode("roots").alias("a"), F.col("low").alias("b")).filter("a != b"), "edges")
    if between.isEmpty():
        return met.select("node", F.col("low").alias("component"))
    above = _contracted(between).withColumnRenamed("node", "low")
    out = written(met.select("node", "low").join(above, "low", "left").select("node", F.coalesce("component", "low").alias("component")), "components")
    drop_written(met)
    drop_written(above)
    return out
