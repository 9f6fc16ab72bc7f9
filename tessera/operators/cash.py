"""Cash positions that keep "unknown" and zero apart.

Entries: scope, entry_id, kind (cost, payment, refund), cents, status, on_date, cost_id (payments). A status
is confirmed, reverted or unknown for costs and payments; received, pending or unknown for refunds; null is
unknown. Reviews: scope, costs, payments, refunds (complete, none or unknown), basis, cutoff.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.money import percent


def _sum(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("cents"))), F.lit(0))


def closing(entries: DataFrame, reviews: DataFrame, basis: DataFrame) -> DataFrame:
    """One row a scope: incurred, paid, received, pending, outstanding and result (cents), coverage.

    A category is complete if the review is current, nothing in it is unknown, and the review's word fits: none
    without confirmed entries, or complete with some. Totals without any entry are zero only if complete, else
    null. The result needs payments and refunds complete and all dates known and not past the cutoff. What
    is outstanding also needs costs complete, and each payment linked with a confirmed cost that it doesn't exceed.
    ``basis``: scope, basis (the state of the entries that a current review must have seen).
    """
    kind, status = F.col("kind"), F.coalesce("status", F.lit("unknown"))
    cost, pay, refund = kind == "cost", kind == "payment", kind == "refund"
    incurred, paid, received, pending = cost & (status == "confirmed"), pay & (status == "confirmed"), refund & (status == "received"), refund & (status == "pending")
    counted = incurred | paid | received
    # Payments by the cost that they are linked with; both sides have one row a cost.
    costs = entries.filter(incurred).select("scope", F.col("entry_id").alias("cost_id"), F.col("cents").alias("_cost"))
    linked = entries.filter(paid).groupBy("scope", "cost_id").agg(F.sum("cents").alias("_paid"))
    links = linked.join(costs, ["scope", "cost_id"], "left").groupBy("scope").agg(F.bool_or(F.col("_cost").isNull()).alias("unlinked"), F.bool_or(F.col("_paid") > F.col("_cost")).alias("exceeded"))
    totals = entries.groupBy("scope").agg(
        *(_sum(c).alias(n) for c, n in ((incurred, "t_incurred"), (paid, "t_paid"), (received, "t_received"), (pending, "t_pending"))),
        *(F.count_if(c).alias(n) for c, n in ((incurred, "n_incurred"), (paid, "n_paid"), (received, "n_received"), (pending, "n_pending"))),
        *(F.bool_or(c & (status == "unknown")).alias(n) for c, n in ((cost, "u_costs"), (pay, "u_payments"), (refund, "u_refunds"))),
        F.bool_or(counted & F.col("on_date").isNull()).alias("undated"),
        F.max(F.when(counted, F.col("on_date"))).alias("last_date"),
    )
    # The review comes in two steps of each category: what it says, and whether that fits what is there.
    out = basis.withColumnRenamed("basis", "_now").join(totals, "scope", "left").join(links, "scope", "left").join(reviews, "scope", "left")
    current = F.coalesce(F.col("basis") == F.col("_now"), F.lit(False))
    n = lambda c: F.coalesce(c, F.lit(0))
    no = lambda c: F.coalesce(c, F.lit(False))

    def complete(said: str, count: str, unknown: str) -> Column:
        fits = ((F.col(said) == "none") & (n(count) == 0)) | ((F.col(said) == "complete") & (n(count) > 0))
        return current & ~no(unknown) & F.coalesce(fits, F.lit(False))

    out = out.withColumns({"c_costs": complete("costs", "n_incurred", "u_costs"), "c_payments": complete("payments", "n_paid", "u_payments"), "c_refunds": complete("refunds", "n_received", "u_refunds")})
    late = F.col("cutoff").isNotNull() & (no("undated") | no(F.col("last_date") > F.col("cutoff")))
    out = out.withColumns({"late": late, "closed": F.col("c_payments") & F.col("c_refunds") & ~late})
    known = lambda total, count, done: F.when((n(count) > 0) | F.col(done), n(total))
    open_ = F.col("c_costs") & F.col("c_payments") & ~F.col("late") & ~no("unlinked") & ~no("exceeded")
    return out.select(
        "scope",
        known("t_incurred", "n_incurred", "c_costs").alias("incurred"),
        known("t_paid", "n_paid", "c_payments").alias("paid"),
        known("t_received", "n_received", "c_refunds").alias("received"),
        known("t_pending", "n_pending", "c_refunds").alias("pending"),
        F.when(open_, n("t_incurred") - n("t_paid")).alias("outstanding"),
        F.when(F.col("closed"), n("t_received") - n("t_paid")).alias("result"),
        F.when(F.col("closed") & (n("t_paid") > 0), percent(n("t_received"), n("t_paid"))).alias("coverage"),
        "closed",
        "cutoff",
    )


def portfolio(closed: DataFrame) -> DataFrame:
    """One row: sums of what is known, and a result only if every scope is closed at the same cutoff.

    What is outstanding is told only if it is known of every scope, at the same cutoff; coverage (received of paid) only beside a result.
    """
    same = (F.count_distinct("cutoff") == 1) & (F.count("cutoff") == F.count("*"))
    ready = F.bool_and("closed") & same
    coverage = F.when(ready & (F.sum("paid") > 0) & F.sum("received").isNotNull(), percent(F.sum("received"), F.sum("paid")))
    return closed.agg(
        *(F.sum(c).alias(c) for c in ("incurred", "paid", "received", "pending")),
        F.when(same & (F.count("outstanding") == F.count("*")), F.sum("outstanding")).alias("outstanding"),
        F.when(ready, F.sum("result")).alias("result"),
        coverage.alias("coverage"),
        F.count("*").alias("n_scopes"),
        F.count_if("closed").alias("n_closed"),
    )


def contract_balance(contracts: DataFrame, key: str, total: str, receipts: DataFrame) -> DataFrame:
    """``contracts`` with ``balance``: the total less the receipts (key, cents, voided) that aren't voided.

    Receipts are summed before the join, so a contract with very many sends one row a task. A receipt
    whose ``voided`` or ``cents`` is null counts nothing; a contract without receipts keeps its total.
    """
    paid = receipts.filter(~F.col("voided")).groupBy(F.col(key).alias("_contract")).agg(F.sum("cents").alias("_paid"))
    joined = contracts.join(paid, contracts[key] == paid["_contract"], "left")
    return joined.withColumn("balance", F.col(total) - F.coalesce("_paid", F.lit(0))).drop("_contract", "_paid")


def note_payments(notes: DataFrame, payments: DataFrame) -> DataFrame:
    """Confirmed notes (note_id, scope, cents, confirmed, separate) as payments, but for those that a payment of the same scope and amount already stands for, unless declared separate."""
    same = payments.select("scope", "cents").distinct()
    twins = notes.join(same.withColumn("_twin", F.lit(True)), ["scope", "cents"], "left")
    issue = F.when(~F.col("confirmed"), "unconfirmed").when(F.col("_twin").isNotNull() & ~F.col("separate"), "double")
    return twins.select("note_id", "scope", "cents", issue.alias("issue"), issue.isNull().alias("counts"))


def confirm_batch(notes: DataFrame, payments: DataFrame) -> DataFrame:
    """One row: how many notes a batch confirms, and how many it skips as deleted, declared or of a payment's amount."""
    same = payments.select("scope", "cents").distinct().withColumn("_twin", F.lit(True))
    skip = F.col("deleted") | F.col("declared") | F.col("_twin").isNotNull()
    return notes.join(same, ["scope", "cents"], "left").agg(F.count_if(~skip).alias("n_confirmed"), F.count_if(skip).alias("n_skipped"))


def unallocated(notes: DataFrame, scopes: DataFrame, name: str = "unallocated") -> DataFrame:
    """Sums by scope; notes of scopes that aren't in view fall into one bucket."""
    held = notes.join(scopes.select("scope", F.lit(True).alias("_in")), "scope", "left").withColumn("bucket", F.when(F.col("_in"), F.col("scope").cast("string")).otherwise(name))
    return held.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
