"""Revisions of a materialisation as deltas, with spans of absence, changes of metrics and a chain of hashes.

Versions: (revision, line, fields): every line at revision 0, then each line that a later revision changes. Any of
them can be replayed (``reconcile.replayed``). All steps group by line, record or revision; a record's or a
chain's sequence is over revisions, never over lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a range whose row hashes one partial hash covers, and revisions of a range of the chain.
LINES, REVISIONS = 4096, 1024


def line_deltas(versions: DataFrame, fields: list[str]) -> DataFrame:
    """(revision, line, from_<field>, to_<field>) of every version after the first that changes a field."""
    by_line = Window.partitionBy("line").orderBy("revision")  # as many rows as the line has versions
    pairs = versions.select("revision", "line", *(F.col(c).alias(f"to_{c}") for c in fields), *(F.lag(c).over(by_line).alias(f"from_{c}") for c in fields), F.lag("revision").over(by_line).alias("_before"))
    same = F.struct(*(f"from_{c}" for c in fields)).eqNullSafe(F.struct(*(f"to_{c}" for c in fields)))
    return pairs.filter(F.col("_before").isNotNull() & ~same).drop("_before")


def bucket_deltas(deltas: DataFrame, base: DataFrame, target: str = "target") -> DataFrame:
    """(revision, record, delta, n): by how much the lines on a record change in a revision, and their number then.

    ``deltas``: with from_ and to_ of the target; ``base``: the lines at revision 0.
    """
    moves = deltas.select("revision", F.explode(F.array(F.struct(F.col(f"from_{target}").alias("record"), F.lit(-1).alias("d")), F.struct(F.col(f"to_{target}").alias("record"), F.lit(1).alias("d")))).alias("_m")).select("revision", "_m.record", "_m.d")
    first = base.select(F.lit(0).alias("revision"), F.col(target).alias("record"), F.lit(1).alias("d"))
    sums = first.unionByName(moves).filter("record IS NOT NULL").groupBy("record", "revision").agg(F.sum("d").alias("delta")).filter("delta != 0 OR revision = 0")
    return sums.select("revision", "record", "delta", F.sum("delta").over(Window.partitionBy("record").orderBy("revision")).alias("n"))


def absence_spans(buckets: DataFrame, records: DataFrame) -> DataFrame:
    """(record, valid_from, valid_to) of the times that no line is on a record of ``records`` (record); an open span has no end.

    A record that no line was ever on is absent from revision 0.
    """
    by_record = Window.partitionBy("record").orderBy("revision")
    before = F.lag("n").over(by_record)
    seen = buckets.select("record", "revision", "n", F.lead("revision").over(by_record).alias("_next"), before.alias("_was"), F.lag("revision").over(by_record).alias("_prior"))
    empty = seen.filter("n = 0").select("record", F.col("revision").alias("valid_from"), F.col("_next").alias("valid_to"))
    # Before its first line a record is absent, unless that was there from the beginning.
    early = seen.filter("_prior IS NULL AND revision > 0").select("record", F.lit(0).alias("valid_from"), F.col("revision").alias("valid_to"))
    never = records.select("record").join(buckets.select("record").distinct(), "record", "left_anti").select("record", F.lit(0).alias("valid_from"), F.lit(None).cast("int").alias("valid_to"))
    spans = empty.unionByName(early).join(records.select("record"), "record", "left_semi")
    return spans.unionByName(never)


def metric_deltas(deltas: DataFrame, amount: str | None = None, category: str = "category") -> DataFrame:
    """(revision, metric, delta): changes of the number of lines in each category, and of their amounts (a column of ``deltas`` that the lines keep)."""
    ends = F.explode(F.array(F.struct(F.col(f"from_{category}").alias("metric"), F.lit(-1).alias("d")), F.struct(F.col(f"to_{category}").alias("metric"), F.lit(1).alias("d")))).alias("_e")
    value = F.col(amount) if amount else F.lit(None).cast("decimal(38,2)")
    rows = deltas.filter(~F.col(f"from_{category}").eqNullSafe(F.col(f"to_{category}"))).select("revision", value.alias("_v"), ends).select("revision", "_v", "_e.metric", "_e.d")
    sums = rows.groupBy("revision", "metric").agg(F.sum("d").alias("n_delta"), F.sum(F.col("_v") * F.col("d")).alias("amount_delta"))
    return sums.filter("n_delta != 0 OR coalesce(amount_delta, 0) != 0")


def totals_at(deltas: DataFrame, base: DataFrame, metric: str = "metric") -> DataFrame:
    """(revision, metric, n): running numbers after each revision that changes them; ``base`` (metric, n) is revision 0."""
    every = base.select(F.lit(0).alias("revision"), metric, F.col("n").alias("n_delta")).unionByName(deltas.select("revision", metric, "n_delta"))
    return every.select("revision", metric, F.sum("n_delta").over(Window.partitionBy(metric).orderBy("revision")).alias("n"))


def row_hash(columns: list[str | Column]) -> Column:
    """SHA-256 of values as texts, each with its length, nulls apart."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def revision_hashes(deltas: DataFrame, columns: list[str]) -> DataFrame:
    """(revision, n, hash): a hash over a revision's rows in the order of their lines, from partial hashes of ranges of lines.

    ``line`` is a whole number; a range has up to ``LINES`` of them, so no row's list grows with the revision but that of its ranges.
    """
    rows = deltas.select("revision", "line", row_hash(["line", *columns]).alias("_h"))
    ordered = lambda place: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, "_h"))), lambda x: x["_h"]), "")
    ranges = rows.groupBy("revision", F.floor(F.col("line") / LINES).alias("_range")).agg(F.count("*").alias("_n"), F.sha2(ordered("line"), 256).alias("_h"))
    return ranges.groupBy("revision").agg(F.sum("_n").alias("n"), F.sha2(ordered("_range"), 256).alias("hash"))


def chained(hashes: DataFrame, seed: str) -> DataFrame:
    """``hashes`` (revision, hash) with ``chain``: SHA-256 over the chain before the revision's range, and the hashes of its range up to it.

    The chain of the last revision of a range stands for all before the next range; the first range is chained to ``seed``. Only the ends of the ranges are
    followed one after the other: one step for ``REVISIONS`` revisions.
    """
    placed = hashes.withColumn("_range", F.floor(F.col("revision") / REVISIONS))
    inside = Window.partitionBy("_range").orderBy("revision")
    run = placed.withColumn("_run", F.array_join(F.collect_list("hash").over(inside), ""))
    whole = run.groupBy("_range").agg(F.max_by("_run", "revision").alias("_run"))
    # One row: a range's place and digest of what it adds.
    digests = whole.select("_range", F.sha2("_run", 256).alias("_d")).agg(F.array_sort(F.collect_list(F.struct("_range", "_d"))).alias("_all"))
    none = F.array().cast("array<struct<_range:bigint,before:string,chain:string>>")

    def step(done: Column, x: Column) -> Column:
        last = F.coalesce(F.try_element_at(done, F.lit(-1))["chain"], F.lit(seed))
        return F.array_append(done, F.struct(x["_range"].cast("bigint").alias("_range"), last.alias("before"), F.sha2(F.concat(last, x["_d"]), 256).alias("chain")))

    starts = digests.select(F.inline(F.aggregate("_all", none, step))).select("_range", "before")
    return run.join(F.broadcast(starts), "_range").withColumn("chain", F.sha2(F.concat("before", F.sha2("_run", 256)), 256)).drop("_range", "_run", "before")


def verified(stored: DataFrame, deltas: DataFrame, columns: list[str], seed: str) -> DataFrame:
    """(revision, holds): whether the stored chain (revision, chain) is that of the deltas; from a changed revision on it isn't. Revisions of one side alone don't hold."""
    again = chained(revision_hashes(deltas, columns), seed).select("revision", F.col("chain").alias("_again"))
    return stored.select("revision", "chain").join(again, "revision", "full").select("revision", F.coalesce(F.col("chain") == F.col("_again"), F.lit(False)).alias("holds"))
