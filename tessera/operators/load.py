"""Loads of a base of rows: validation, comparison, decisions, merging, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import money, times
from tessera.storage import written


def validate(rows: DataFrame, key: str, order: str, required: tuple[str, ...], dates: tuple[str, ...] = (), amounts: tuple[str, ...] = (), lengths: dict[str, int] | None = None) -> DataFrame:
    """``rows`` (all text) with ``errors``: required, formula, repeated_id, date, decimal, too_long, in this order.

    Of rows that share an id the first by ``order`` is right, later ones are errors. Values stay as they came.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    filled = lambda c: ~blank(F.col(c))
    formula = F.lit(False)
    for c in dict.fromkeys((key, *required, *dates, *amounts)):
        formula = formula | F.startswith(F.trim(F.col(c)), F.lit("="))
    # The first row of an id comes from a grouped minimum; only ids that repeat join it.
    first = rows.filter(filled(key)).groupBy(key).agg(F.min(order).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").select(F.col(key).alias("_id"), "_first")
    out = rows.join(first, F.col(key) == F.col("_id"), "left")
    some = lambda cond, code: F.when(F.coalesce(cond, F.lit(False)), F.lit(code))
    checks = [some(blank(F.col(c)), f"required:{c}") for c in required]
    checks += [some(formula, "formula"), some(F.col("_first").isNotNull() & (F.col(order) > F.col("_first")), "repeated_id")]
    checks += [some(filled(c) & times.mixed_date(F.col(c)).isNull(), f"date:{c}") for c in dates]
    checks += [some(filled(c) & money.spreadsheet_decimal(F.col(c)).isNull(), f"decimal:{c}") for c in amounts]
    checks += [some(F.length(c) > n, f"too_long:{c}") for c, n in (lengths or {}).items()]
    return out.withColumn("errors", F.array_compact(F.array(*checks))).drop("_id", "_first")


def _differs(fields: list[str], a: str, b: str) -> Column:
    out = F.lit(False)
    for f in fields:
        out = out | (F.coalesce(F.col(f"{a}.{f}"), F.lit("")) != F.coalesce(F.col(f"{b}.{f}"), F.lit("")))
    return out


def compare(current: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change): added, changed, unchanged or absent; missing texts equal empty ones."""
    pack = lambda df, name: df.select(key, F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias(name))
    both = pack(current, "old").join(pack(incoming, "new"), key, "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "absent").when(_differs(fields, "old", "new"), "changed").otherwise("unchanged")
    return both.select(key, change.alias("change"))


def compare_counts(compared: DataFrame) -> DataFrame:
    return compared.agg(*(F.count_if(F.col("change") == c).alias(f"n_{c}") for c in ("added", "changed", "unchanged", "absent")))


def undecided(compared: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Guard: differences without a decision, and decisions without a difference."""
    open_ = compared.filter(F.col("change").isin("changed", "absent")).select(key)
    missing = open_.join(decisions.filter(F.col("decision").isin("keep", "incoming")), key, "left_anti").withColumn("issue", F.lit("missing"))
    extra = decisions.select(key).join(open_, key, "left_anti").withColumn("issue", F.lit("extra"))
    return missing.unionByName(extra)


def merge(current: DataFrame, incoming: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Incoming rows, but current ones where the decision keeps them, also those that are absent from the load."""
    kept = current.join(decisions.filter("decision = 'keep'").select(key), key, "left_semi")
    return incoming.join(kept.select(key), key, "left_anti").unionByName(kept.select(incoming.columns))


def complement(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows and the current ones that the load doesn't name."""
    return incoming.unionByName(current.join(incoming.select(key), key, "left_anti").select(incoming.columns))


def merge_scope(current: DataFrame, incoming: DataFrame, key: str, scope: str, owned: list[str]) -> DataFrame:
    """One scope's rows are replaced, all others stay; ``issue`` marks foreign rows and ids that others own."""
    others = current.filter(~F.col(scope).isin(*owned))
    clash = others.select(F.col(key).alias("_k")).distinct()
    checked = incoming.join(clash, F.col(key) == F.col("_k"), "left").withColumn("issue", F.when(~F.col(scope).isin(*owned), "foreign").when(F.col("_k").isNotNull(), "collision")).drop("_k")
    return others.withColumn("issue", F.lit(None).cast("string")).unionByName(checked)


def lifecycle_plan(known: DataFrame, before: DataFrame, now: DataFrame, title: str, overwrite: bool) -> DataFrame:
    """(title, action): create, restore (archived and named again) or archive (only when overwriting, named before and no more)."""
    named = now.select(title).distinct().withColumn("_now", F.lit(True))
    former = before.select(title).distinct().withColumn("_before", F.lit(True))
    all_ = known.select(title, "archived").join(named, title, "full").join(former, title, "left")
    gone = F.col("_now").isNull() & F.col("_before").isNotNull() & ~F.col("archived")
    action = F.when(F.col("archived").isNull(), "create").when(F.col("archived") & F.col("_now").isNotNull(), "restore").when(F.lit(overwrite) & gone, "archive")
    return all_.select(title, action.alias("action")).filter("action IS NOT NULL")


def activity_plan(current: DataFrame, incoming: DataFrame, adjusted: DataFrame, key: str, owner: str, amount: str, fields: list[str]) -> DataFrame:
    """(key, action): added, unchanged, updated, adjusted (changed under an adjustment), moved (refused) or legacy (not in the load).

    Amounts that are equal as numbers are equal, however they are written.
    """
    pack = lambda df, name: df.select(key, F.struct(owner, F.col(amount).try_cast("decimal(30,16)").alias(amount), *(F.col(f).cast("string").alias(f) for f in fields)).alias(name))
    both = pack(current, "old").join(pack(incoming, "new"), key, "full").join(adjusted.select(key).distinct().withColumn("_adjusted", F.lit(True)), key, "left")
    changed = _differs(fields, "old", "new") | ~F.col(f"old.{amount}").eqNullSafe(F.col(f"new.{amount}"))
    action = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "legacy")
        .when(~F.col(f"old.{owner}").eqNullSafe(F.col(f"new.{owner}")), "moved")
        .when(~changed, "unchanged")
        .when(F.col("_adjusted").isNotNull(), "adjusted")
        .otherwise("updated")
    )
    return both.select(key, action.alias("action"))


def compare_notes(known: DataFrame, incoming: DataFrame, fields: list[str]) -> DataFrame:
    """(note_id, status) of incoming notes: existing (equal to the source or the effective version), conflict, or new.

    A note also conflicts if another id has its year and number key. Both sides have note_id, year, number_key and
    ``fields``; ``known`` has each id once or twice (source and effective).
    """
    versions = known.select("note_id", F.struct(*(F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields)).alias("_v"))
    equal = versions.groupBy("note_id").agg(F.collect_set("_v").alias("_versions"))
    numbers = known.filter("year IS NOT NULL AND number_key IS NOT NULL").groupBy("year", "number_key").agg(F.min("note_id").alias("_low"), F.max("note_id").alias("_high"))
    own = F.struct(*(F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields))
    out = incoming.join(equal, "note_id", "left").join(numbers, ["year", "number_key"], "left")
    other = F.coalesce((F.col("_low") != F.col("note_id")) | (F.col("_high") != F.col("note_id")), F.lit(False))
    status = F.when(F.col("_versions").isNotNull() & F.array_contains("_versions", own), "existing").when(F.col("_versions").isNotNull() | other, "conflict").otherwise("new")
    return out.select("note_id", status.alias("status"))


def first_spellings(names: DataFrame, name: str, order: str) -> DataFrame:
    """Distinct names without regard to case; of each the first spelling. Blank names and ``-`` are none."""
    tidy = F.regexp_replace(F.trim(F.col(name)), r"\s+", " ")
    kept = names.select(tidy.alias(name), order).filter((F.col(name) != "") & (F.col(name) != "-"))
    return kept.groupBy(F.lower(name).alias("name_key")).agg(F.min_by(name, order).alias(name))


def numbered(rows: DataFrame, order: list[str | Column], number: str) -> DataFrame:
    """``rows`` with their places from 1 by a total order.

    Ranks within ranges of the first key, plus the sizes of the ranges before: no task sorts all rows. The ranges are
    drawn from a sample, so they are written once and not drawn again.
    """
    ranged = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    within = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = within.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a range
    return within.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(number, F.col("_n") + F.col("_before")).drop("_part", "_n", "_before")


def ordered_ids(rows: DataFrame, order: list[str], prefix: str, code: str = "code") -> DataFrame:
    """Public codes ``PRE-001`` by a total order."""
    number = F.col("_number")
    shown = F.concat(F.lit(f"{prefix}-"), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string")))
    return numbered(rows, order, "_number").withColumn(code, shown).drop("_number")
