"""Windows over scopes of any size: parallel ranges of (scope, order), and what one range hands to the next.

A window by scope sorts all of a scope's rows in one task. Where a scope has more than ``IN_TASK`` rows, the rows are
dealt in ranges instead; a window then runs inside each range, and only the first and the last scope of a range can go
on in the range beside, so the rows that carry values over are at most two a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import written

#: Rows of one scope that a task may sort.
IN_TASK = 1_000_000


def needed(rows: DataFrame, scope: list[str], in_task: int) -> int:
    """How many ranges the rows are to be dealt in: one where no scope has more than ``in_task`` rows, at most the shuffle's partitions otherwise.

    The counts are combined before the shuffle.
    """
    sizes = rows.groupBy(*scope).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("n")).first()
    if (sizes["most"] or 0) <= in_task:
        return 1
    return max(2, min(-(-sizes["n"] // in_task), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def ranged(rows: DataFrame, scope: list[str], order: list[str], count: int) -> DataFrame:
    """``rows`` with ``_part``, the number of their range by scope and order; written, as the ranges are drawn from a sample."""
    return written(rows.repartitionByRange(count, *scope, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def edges(groups: DataFrame, scope: list[str]) -> DataFrame:
    """Of groups by (``_part``, scope) those that may go on in the range beside: the first and the last of each range."""
    own = F.struct(*scope)
    ends = groups.groupBy("_part").agg(F.min(own).alias("_low"), F.max(own).alias("_high"))
    return groups.join(F.broadcast(ends), "_part").filter(own.eqNullSafe(F.col("_low")) | own.eqNullSafe(F.col("_high"))).drop("_low", "_high")


def handed(rows: DataFrame, carried: DataFrame, scope: list[str]) -> DataFrame:
    """``rows`` with the other columns of ``carried`` (at most two rows a range, so broadcast), null where none is carried."""
    names = {c: f"_carried_{i}" for i, c in enumerate(["_part", *scope])}
    small = F.broadcast(carried.withColumnsRenamed(names))
    same = [F.col(c).eqNullSafe(F.col(name)) for c, name in names.items()]
    return rows.join(small, same, "left").drop(*names.values())
