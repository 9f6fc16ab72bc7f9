"""Layers over source rows: latest revisions, effective values, tombstones and temporal spans.

Nothing is updated in place. Ledgers are append-only; the value in force is computed from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import ranges


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order`` (descending, nulls last).

    A grouped maximum of a struct: it is combined before the shuffle, so a key with many revisions
    sends one row from each task, where a window would send and sort them all.
    """
    rest = [c for c in rows.columns if c not in keys]
    value = F.struct(*(F.col(c) for c in rest))
    best = F.max_by(value, F.struct(*(F.col(c) for c in order)))
    return rows.groupBy(*keys).agg(best.alias("_best")).select(*keys, *(F.col(f"_best.{c}").alias(c) for c in rest))


def effective(source: DataFrame, revisions: DataFrame, keys: list[str], fields: list[str], number: str = "revision") -> DataFrame:
    """Source rows under their latest revision: a revision replaces every field, also by null.

    Adds ``source_<field>``, ``adjusted`` and the revision's number (0 without one).
    """
    last = latest(revisions.select(*keys, number, *fields), keys, [number])
    renamed = last.select(*keys, F.col(number).alias("_number"), *(F.col(f).alias(f"_new_{f}") for f in fields))
    joined = source.join(renamed, keys, "left")
    there = F.col("_number").isNotNull()
    kept = [c for c in source.columns if c not in fields]
    return joined.select(
        *kept,
        *(F.when(there, F.col(f"_new_{f}")).otherwise(F.col(f)).alias(f) for f in fields),
        *(F.col(f).alias(f"source_{f}") for f in fields),
        there.alias("adjusted"),
        F.coalesce("_number", F.lit(0)).alias(number),
    )


def coalesced(source: DataFrame, revisions: DataFrame, keys: list[str], fields: list[str], number: str = "revision") -> DataFrame:
    """Like :func:`effective`, but a null in the revision leaves the source's value."""
    last = latest(revisions.select(*keys, number, *fields), keys, [number])
    renamed = last.select(*keys, *(F.col(f).alias(f"_new_{f}") for f in fields))
    return source.join(renamed, keys, "left").select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in source.columns))


def without_tombstones(rows: DataFrame, tombstones: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(tombstones.select(*keys).distinct(), keys, "left_anti")


def spans(revisions: DataFrame, keys: list[str], number: str = "revision", in_task: int = ranges.IN_TASK) -> DataFrame:
    """Each revision with the numbers it is in force from and to (exclusive; null: still).

    Where a key has more than ``in_task`` revisions, ranges of its numbers are sorted apart, and the last row of a range
    ends with the first number of the next.
    """
    out = revisions.withColumn("valid_from", F.col(number))
    count = ranges.needed(revisions, keys, in_task)
    if count == 1:
        return out.withColumn("valid_to", F.lead(number).over(Window.partitionBy(*keys).orderBy(number)))
    parts = ranges.ranged(out, keys, [number], count)
    by_part = Window.partitionBy("_part", *keys).orderBy(number)
    inside = parts.withColumn("_to", F.lead(number).over(by_part)).withColumn("_last", F.lead(F.lit(True)).over(by_part).isNull())
    firsts = parts.groupBy("_part", *keys).agg(F.min(F.struct(number)).alias("_first"))
    following = F.lead("_first").over(Window.partitionBy(*keys).orderBy("_part"))  # at most two rows a range
    carried = ranges.edges(firsts, keys).select("_part", *keys, following[number].alias("_next"))
    ends = F.when(F.col("_last"), F.col("_next")).otherwise(F.col("_to"))
    return ranges.handed(inside, carried, keys).withColumn("valid_to", ends).drop("_part", "_to", "_last", "_next")


def as_of(spanned: DataFrame, at: Column) -> DataFrame:
    return spanned.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def overlaps(spanned: DataFrame, keys: list[str]) -> DataFrame:
    """Guard: spans that begin before the one before them has ended."""
    by_key = Window.partitionBy(*keys).orderBy("valid_from")
    before = F.lag(F.coalesce("valid_to", F.lit(2**62))).over(by_key)
    return spanned.withColumn("_before", before).filter(F.col("_before") > F.col("valid_from")).drop("_before")


def reduce_projection(events: DataFrame, record: str = "record", order: tuple[str, ...] = ("instant", "precedence", "event_id")) -> DataFrame:
    """The state that each record's events add up to.

    Events come in the order of instant, layer and id. A lower layer never overrides a higher one, so the
    payload is that of the last event of the highest layer present. The adjustment pointer is the last
    adjustment before the first decision, the source pointer the last source event at all: a late
    source event refreshes its lineage and leaves the value alone. One grouped pass, combined before the shuffle.

    Events have record, instant, precedence (1 source, 2 adjustment, 3 decision), event_id, payload, state, version.
    """
    key = F.struct(*(F.col(c) for c in order))
    value = F.struct("payload", "state", "version", "precedence", "event_id")
    first_decision = events.filter("precedence = 3").groupBy(record).agg(F.min(key).alias("_decided"))
    last = events.groupBy(record).agg(
        F.max_by(value, F.struct(F.col("precedence"), key)).alias("_top"),
        F.max_by("event_id", F.when(F.col("precedence") == 1, key)).alias("source_event"),
        F.max_by("event_id", F.when(F.col("precedence") == 3, key)).alias("decision_event"),
        F.count("*").alias("n_events"),
    )
    adjusted = events.filter("precedence = 2").join(first_decision, record, "left").filter(F.col("_decided").isNull() | (key < F.col("_decided")))
    pointer = adjusted.groupBy(record).agg(F.max_by("event_id", key).alias("adjustment_event"))
    return last.join(pointer, record, "left").select(record, "_top.payload", "_top.state", "_top.version", F.col("_top.precedence").alias("layer"), "source_event", "adjustment_event", "decision_event", "n_events")


def compacted(events: DataFrame, record: str = "record", order: tuple[str, ...] = ("instant", "precedence", "event_id")) -> DataFrame:
    """The events that :func:`reduce_projection` can ever need again, whatever events come later, each with the number ``n`` of events it stands for.

    Kept are the last source event, the first and the last decision, and adjustments before the first decision: a later
    event can move the first decision only towards the begin. ``events`` may be compacted before (they have ``n`` then), and
    compacting a union gives what compacting all its events would.
    """
    given = events if "n" in events.columns else events.withColumn("n", F.lit(1).cast("long"))
    key = F.struct(*(F.col(c) for c in order))
    layer = lambda p: F.when(F.col("precedence") == p, key)
    ends = given.groupBy(record).agg(F.sum("n").alias("_n"), F.max(layer(1)).alias("_source"), F.min(layer(3)).alias("_decided"), F.max(layer(3)).alias("_last"), F.max(F.struct("precedence", key.alias("at"))).alias("_top"))
    held = (key == F.col("_source")) | (key == F.col("_decided")) | (key == F.col("_last")) | (F.col("precedence") == 2) & (F.col("_decided").isNull() | (key < F.col("_decided")))
    kept = given.join(ends, record).filter(held)
    return kept.withColumn("n", F.when(F.struct("precedence", key.alias("at")) == F.col("_top"), F.col("_n")).otherwise(0)).select(given.columns)


def resolve(pointers: DataFrame, events: DataFrame, record: str = "record") -> DataFrame:
    """The payload in force by pointers: decision before adjustment before source; ``broken`` where a pointer leads nowhere."""
    known = events.select(F.col("event_id").alias("_event"), F.col("payload").alias("_payload"))
    out = pointers
    for layer in ("decision", "adjustment", "source"):
        out = out.join(known.withColumnsRenamed({"_event": f"_{layer}", "_payload": f"_{layer}_payload"}), F.col(f"{layer}_event") == F.col(f"_{layer}"), "left")
    broken = [F.col(f"{layer}_event").isNotNull() & F.col(f"_{layer}").isNull() for layer in ("decision", "adjustment", "source")]
    chosen = F.when(F.col("decision_event").isNotNull(), F.col("_decision_payload")).when(F.col("adjustment_event").isNotNull(), F.col("_adjustment_payload")).otherwise(F.col("_source_payload"))
    return out.select(record, chosen.alias("effective_payload"), (broken[0] | broken[1] | broken[2]).alias("broken"))
