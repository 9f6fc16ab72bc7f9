"""Finding the record that an incoming row means: by identity attributes, by names, by titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import drop_written, written

#: Candidates that are listed; all are counted.
LISTED = 50


def identity_match(lines: DataFrame, records: DataFrame, line: str, record: str, fields: list[str], listed: int = LISTED) -> DataFrame:
    """Each line with ``match`` (unique, none, multiple), the number of candidates, the first ids, and the record if unique.

    A blank attribute on either side makes no candidate, and no fields make none at all. Records are
    grouped by identity before the join, so many candidates of one identity meet no line one by one.
    """
    if not fields:
        return lines.select(line, F.lit("none").alias("match"), F.lit(0).cast("long").alias("n_candidates"), F.array().cast("array<long>").alias("candidates"), F.lit(None).cast("long").alias("record"))
    filled = [F.trim(F.col(f).cast("string")) != "" for f in fields]
    whole = filled[0]
    for f in filled[1:]:
        whole = whole & f
    # The listed ids are the first of a rank; each task drops the others before the shuffle, so no group is gathered whole.
    known = records.filter(whole).select(*fields, record).distinct()
    counts = known.groupBy(*fields).agg(F.count("*").alias("n"))
    first = known.withColumn("_rank", F.row_number().over(Window.partitionBy(*fields).orderBy(record))).filter(F.col("_rank") <= listed)
    groups = counts.join(first.groupBy(*fields).agg(F.array_sort(F.collect_list(record)).alias("ids")), fields)
    joined = lines.join(groups, fields, "left")
    n = F.coalesce("n", F.lit(0))
    return joined.select(
        line,
        F.when(n == 0, "none").when(n == 1, "unique").otherwise("multiple").alias("match"),
        n.cast("long").alias("n_candidates"),
        F.coalesce("ids", F.array().cast(joined.schema["ids"].dataType)).alias("candidates"),
        F.when(n == 1, F.try_element_at("ids", F.lit(1))).alias("record"),
    )


def resolve_names(names: DataFrame, titles: DataFrame, aliases: DataFrame, name: str, owner: str) -> DataFrame:
    """The owner of each name: by current title, else by former title; null where the better tier names several."""
    tiers = titles.select(name, owner, F.lit(0).alias("tier")).unionByName(aliases.select(name, owner, F.lit(1).alias("tier")))
    # The lowest tier of a name decides; within it the owner must be one.
    by_tier = tiers.groupBy(name, "tier").agg(F.min(owner).alias("low"), F.max(owner).alias("high"))
    best = by_tier.groupBy(name).agg(F.min_by(F.struct("low", "high", "tier"), "tier").alias("best"))
    return names.join(best, name, "left").select(*names.columns, F.when(F.col("best.low") == F.col("best.high"), F.col("best.low")).alias(owner), F.col("best.tier").alias("tier"))


def duplicated(rows: DataFrame, keys: list[str], key: str) -> DataFrame:
    """Keys that several rows have, with their number and least and greatest id."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(key).alias("first_id"), F.max(key).alias("last_id")).filter("n > 1")


def lineage(parents: DataFrame, child: str, parent: str, rounds: int = 64) -> DataFrame:
    """(node, root, depth) for chains of parents, by doubling: a chain of n needs about log2(n) joins, and no recursion limit holds.

    A row without a parent is a root. Rows in a cycle reach no root; after ``rounds`` their root is a row of the cycle.
    """
    now = written(parents.select(F.col(child).alias("node"), F.col(parent).alias("up"), F.when(F.col(parent).isNull(), 0).otherwise(1).alias("depth")), "lineage")
    for _ in range(rounds):
        above = now.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        # A node whose parent is a root keeps it; others go to their grandparent.
        step = now.join(above, "up", "left").select("node", F.coalesce("_up", "up").alias("up"), (F.col("depth") + F.when(F.col("_up").isNotNull(), F.col("_depth")).otherwise(0)).alias("depth"), F.col("_up").isNotNull().alias("_moved"))
        before, now = now, written(step, "lineage")
        drop_written(before)
        moved = not now.filter("_moved").isEmpty()
        now = now.drop("_moved")
        if not moved:
            break
    return now.select("node", F.coalesce("up", "node").alias("root"), "depth")
