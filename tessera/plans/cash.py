"""Cash positions, payments and balances; events and orders stand for entries."""

from pyspark.sql import functions as F

from tessera.operators import cash, report
from tessera.plans.registry import query, table


def entries(spark, sf_dir):
    """Events read as entries: kinds by type, scopes by user."""
    events = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    e, u = F.col("event_id"), F.col("user_id")
    kind = F.when(F.col("event_type").isin("click", "view"), "cost").when(F.col("event_type") == "purchase", "payment").otherwise("refund")
    unknown = (u % 5 == 0) & (e % 50 == 0)
    done = F.when(kind == "refund", F.when(e % 9 == 0, "pending").otherwise("received")).otherwise(F.when(e % 13 == 0, "reverted").otherwise("confirmed"))
    rows = events.select(
        u.alias("scope"), e.alias("entry_id"), kind.alias("kind"), F.abs(F.col("value").cast("decimal(18,2)") * 100).cast("long").alias("cents"),
        F.when(unknown, None).otherwise(done).alias("status"), F.when((u % 7 == 0) & (e % 40 == 0), None).otherwise(F.col("ts").cast("date")).alias("on_date"),
    )
    # Each payment stands for the scope's dearest cost, if the scope has any.
    dearest = rows.filter("kind = 'cost' AND status = 'confirmed'").groupBy("scope").agg(F.max_by("entry_id", F.struct("cents", "entry_id")).alias("_dearest"))
    return rows.join(dearest, "scope", "left").select("*", F.when(F.col("kind") == "payment", F.col("_dearest")).alias("cost_id")).drop("_dearest")


def reviews(spark, sf_dir):
    """A review of each customer, and the state that a current one must have seen."""
    customer = table(spark, sf_dir, "customer", "c_custkey")
    k = F.col("c_custkey")
    said = lambda n, word: F.when(k % n == 0, word).otherwise("complete")
    cutoff = F.when(k % 4 == 0, None).when(k % 4 == 1, F.lit("2024-01-20")).otherwise(F.lit("2024-01-31")).cast("date")
    made = customer.filter(k % 11 != 0).select(k.alias("scope"), said(6, "none").alias("costs"), said(8, "unknown").alias("payments"), said(10, "none").alias("refunds"), F.when(k % 12 == 0, k + 1).otherwise(k).alias("basis"), cutoff.alias("cutoff"))
    return made, customer.select(k.alias("scope"), k.alias("basis"))


CLOSING = """
WITH e0 AS (
  SELECT user_id AS scope, event_id AS entry_id, CASE WHEN event_type IN ('click', 'view') THEN 'cost' WHEN event_type = 'purchase' THEN 'payment' ELSE 'refund' END AS kind,
    CAST(abs(CAST(value AS DECIMAL(18,2)) * 100) AS BIGINT) AS cents, event_id AS e, user_id AS u, CAST(ts AS DATE) AS day FROM events
), e AS (
  SELECT scope, entry_id, kind, cents, CASE WHEN u % 5 = 0 AND e % 50 = 0 THEN 'unknown' WHEN kind = 'refund' THEN CASE WHEN e % 9 = 0 THEN 'pending' ELSE 'received' END WHEN e % 13 = 0 THEN 'reverted' ELSE 'confirmed' END AS status,
    CASE WHEN u % 7 = 0 AND e % 40 = 0 THEN NULL ELSE day END AS on_date FROM e0
), dear AS (SELECT scope, arg_max(entry_id, cents * 10000000 + entry_id) AS cost_id, max(cents) AS cost FROM e WHERE kind = 'cost' AND status = 'confirmed' GROUP BY 1),
t AS (
  SELECT e.scope, sum(cents) FILTER (kind = 'cost' AND status = 'confirmed') AS inc, count(*) FILTER (kind = 'cost' AND status = 'confirmed') AS ninc,
    sum(cents) FILTER (kind = 'payment' AND status = 'confirmed') AS paid, count(*) FILTER (kind = 'payment' AND status = 'confirmed') AS npaid,
    sum(cents) FILTER (kind = 'refund' AND status = 'received') AS rec, count(*) FILTER (kind = 'refund' AND status = 'received') AS nrec,
    sum(cents) FILTER (kind = 'refund' AND status = 'pending') AS pen, count(*) FILTER (kind = 'refund' AND status = 'pending') AS npen,
    bool_or(kind = 'cost' AND status = 'unknown') AS uc, bool_or(kind = 'payment' AND status = 'unknown') AS up, bool_or(kind = 'refund' AND status = 'unknown') AS ur,
    bool_or(status IN ('confirmed', 'received') AND on_date IS NULL) AS undated, max(on_date) FILTER (status IN ('confirmed', 'received')) AS last
  FROM e GROUP BY 1
), r AS (
  SELECT c_custkey AS scope, c_custkey % 11 <> 0 AND c_custkey % 12 <> 0 AS cur, CASE WHEN c_custkey % 6 = 0 THEN 'none' ELSE 'complete' END AS costs, CASE WHEN c_custkey % 8 = 0 THEN 'unknown' ELSE 'complete' END AS payments,
    CASE WHEN c_custkey % 10 = 0 THEN 'none' ELSE 'complete' END AS refunds, CASE WHEN c_custkey % 11 = 0 OR c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN DATE '2024-01-20' ELSE DATE '2024-01-31' END AS cutoff FROM customer
), f AS (
  SELECT r.scope, cutoff, coalesce(inc, 0) AS inc, coalesce(ninc, 0) AS ninc, coalesce(paid, 0) AS paid, coalesce(npaid, 0) AS npaid, coalesce(rec, 0) AS rec, coalesce(nrec, 0) AS nrec, coalesce(pen, 0) AS pen, coalesce(npen, 0) AS npen,
    cur AND NOT coalesce(uc, false) AND CASE costs WHEN 'none' THEN coalesce(ninc, 0) = 0 ELSE coalesce(ninc, 0) > 0 END AS cc,
    cur AND NOT coalesce(up, false) AND payments = 'complete' AND coalesce(npaid, 0) > 0 AS cp,
    cur AND NOT coalesce(ur, false) AND CASE refunds WHEN 'none' THEN coalesce(nrec, 0) = 0 ELSE coalesce(nrec, 0) > 0 END AS cr,
    cutoff IS NOT NULL AND (coalesce(undated, false) OR coalesce(last > cutoff, false)) AS late,
    coalesce(npaid, 0) > 0 AND (cost IS NULL OR coalesce(paid, 0) > cost) AS bad
  FROM r LEFT JOIN t USING (scope) LEFT JOIN dear USING (scope)
), c AS (
  SELECT scope, CAST(CASE WHEN ninc > 0 OR cc THEN inc END AS BIGINT) AS incurred, CAST(CASE WHEN npaid > 0 OR cp THEN paid END AS BIGINT) AS paid, CAST(CASE WHEN nrec > 0 OR cr THEN rec END AS BIGINT) AS received,
    CAST(CASE WHEN npen > 0 OR cr THEN pen END AS BIGINT) AS pending, CAST(CASE WHEN cc AND cp AND NOT late AND NOT bad THEN inc - paid END AS BIGINT) AS outstanding, CAST(CASE WHEN cp AND cr AND NOT late THEN rec - paid END AS BIGINT) AS result,
    CASE WHEN cp AND cr AND NOT late AND paid > 0 THEN ((rec * 10000 + paid // 2) // paid) // 100 || ',' || lpad(CAST(((rec * 10000 + paid // 2) // paid) % 100 AS VARCHAR), 2, '0') || '%' END AS coverage,
    cp AND cr AND NOT late AS closed, CAST(cutoff AS VARCHAR) AS cutoff FROM f
)
"""


def closed(spark, sf_dir):
    made, basis = reviews(spark, sf_dir)
    return cash.closing(entries(spark, sf_dir), made, basis)


@query(CLOSING + "SELECT * FROM c")
def cash_closing(spark, sf_dir):
    return closed(spark, sf_dir).withColumn("cutoff", F.col("cutoff").cast("string"))


@query(CLOSING + """SELECT scope % 3 = 0 AS third, CAST(sum(incurred) AS BIGINT) AS incurred, CAST(sum(paid) AS BIGINT) AS paid, CAST(sum(received) AS BIGINT) AS received, CAST(sum(pending) AS BIGINT) AS pending,
CAST(CASE WHEN count(DISTINCT cutoff) = 1 AND count(cutoff) = count(*) AND count(outstanding) = count(*) THEN sum(outstanding) END AS BIGINT) AS outstanding,
CAST(CASE WHEN bool_and(closed) AND count(DISTINCT cutoff) = 1 AND count(cutoff) = count(*) THEN sum(result) END AS BIGINT) AS result, CASE WHEN bool_and(closed) AND count(DISTINCT cutoff) = 1 AND count(cutoff) = count(*) AND sum(paid) > 0 THEN ((sum(received) * 10000 + sum(paid) // 2) // sum(paid)) // 100 || ',' || lpad(CAST(((sum(received) * 10000 + sum(paid) // 2) // sum(paid)) % 100 AS VARCHAR), 2, '0') || '%' END AS coverage, count(*) AS n_scopes, count(*) FILTER (closed) AS n_closed FROM c GROUP BY 1""")
def cash_portfolio(spark, sf_dir):
    """Two portfolios of scopes; neither has a result while one of its scopes is open."""
    scopes = closed(spark, sf_dir)
    third = F.col("scope") % 3 == 0
    return cash.portfolio(scopes.filter(third)).withColumn("third", F.lit(True)).unionByName(cash.portfolio(scopes.filter(~third)).withColumn("third", F.lit(False)))


@query(CLOSING + """SELECT CAST(sum(result) AS BIGINT) AS result, CAST(sum(incurred) AS BIGINT) AS incurred, CAST(CASE WHEN count(outstanding) = count(*) THEN sum(outstanding) END AS BIGINT) AS outstanding,
CASE WHEN sum(paid) > 0 THEN ((sum(received) * 10000 + sum(paid) // 2) // sum(paid)) // 100 || ',' || lpad(CAST(((sum(received) * 10000 + sum(paid) // 2) // sum(paid)) % 100 AS VARCHAR), 2, '0') || '%' END AS coverage, count(*) AS n
FROM c WHERE closed AND cutoff = '2024-01-31'""")
def cash_portfolio_closed(spark, sf_dir):
    """A portfolio of closed scopes of one cutoff has a result and a coverage."""
    whole = closed(spark, sf_dir).filter("closed AND cutoff = date'2024-01-31'")
    return cash.portfolio(whole).select("result", "incurred", "outstanding", "coverage", F.col("n_scopes").alias("n"))


@query(CLOSING + """SELECT CAST(sum(outstanding) AS BIGINT) AS outstanding, count(*) AS n FROM c WHERE outstanding IS NOT NULL AND cutoff = '2024-01-31'""")
def cash_portfolio_outstanding(spark, sf_dir):
    """A portfolio whose scopes all know what is outstanding, at one cutoff, knows it too."""
    known = closed(spark, sf_dir).filter("outstanding IS NOT NULL AND cutoff = date'2024-01-31'")
    return cash.portfolio(known).select("outstanding", F.col("n_scopes").alias("n"))


def notes(spark, sf_dir):
    """Orders read as notes and as payments; amounts in whole tens, so that some agree."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    k, cents = F.col("o_orderkey"), F.round(F.col("o_totalprice").cast("decimal(18,2)"), -4).cast("long") * 100
    made = orders.filter(k % 2 == 0).select(k.alias("note_id"), F.col("o_custkey").alias("scope"), cents.alias("cents"), (k % 10 != 0).alias("confirmed"), (k % 12 == 0).alias("separate"), (k % 14 == 0).alias("deleted"), (k % 6 == 0).alias("declared"))
    return made, orders.filter(k % 2 == 1).select(F.col("o_custkey").alias("scope"), cents.alias("cents"))


NOTES = """
WITH o AS (SELECT o_orderkey AS k, o_custkey AS scope, CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) / 10000) AS BIGINT) * 1000000 AS cents FROM orders),
p AS (SELECT DISTINCT scope, cents, true AS twin FROM o WHERE k % 2 = 1),
n AS (SELECT k AS note_id, scope, cents, k % 10 <> 0 AS confirmed, k % 12 = 0 AS separate, k % 14 = 0 AS deleted, k % 6 = 0 AS declared, twin FROM o LEFT JOIN p USING (scope, cents) WHERE k % 2 = 0)
"""


@query(NOTES + """, i AS (SELECT note_id, scope, cents, CASE WHEN NOT confirmed THEN 'unconfirmed' WHEN twin AND NOT separate THEN 'double' END AS issue FROM n)
SELECT note_id, scope, cents, issue, issue IS NULL AS counts FROM i""")
def payment_double_count(spark, sf_dir):
    return cash.note_payments(*notes(spark, sf_dir))


@query(NOTES + "SELECT count(*) FILTER (NOT (deleted OR declared OR coalesce(twin, false))) AS n_confirmed, count(*) FILTER (deleted OR declared OR coalesce(twin, false)) AS n_skipped FROM n")
def payment_batch(spark, sf_dir):
    return cash.confirm_batch(*notes(spark, sf_dir))


@query(NOTES + "SELECT CASE WHEN scope % 3 = 0 THEN CAST(scope AS VARCHAR) ELSE 'unallocated' END AS bucket, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM n WHERE confirmed GROUP BY 1")
def unallocated_bucket(spark, sf_dir):
    made, _ = notes(spark, sf_dir)
    scopes = table(spark, sf_dir, "customer", "c_custkey").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("scope"))
    return cash.unallocated(made.filter("confirmed"), scopes)


@query("""
WITH r AS (SELECT l_orderkey, sum(CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) END) AS paid FROM lineitem GROUP BY 1)
SELECT o_orderkey, CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) - coalesce(paid, 0) AS BIGINT) AS balance FROM orders LEFT JOIN r ON l_orderkey = o_orderkey
""")
def contract_balance(spark, sf_dir):
    """Orders as contracts, their lines as receipts, every third of them voided."""
    cents = lambda c: (F.col(c).cast("decimal(18,2)") * 100).cast("long")
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    receipts = lines.select(F.col("l_orderkey").alias("o_orderkey"), cents("l_extendedprice").alias("cents"), (F.col("l_linenumber") % 3 == 0).alias("voided"))
    contracts = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").select("o_orderkey", cents("o_totalprice").alias("total"))
    return cash.contract_balance(contracts, "o_orderkey", "total", receipts).select("o_orderkey", "balance")


@query("""
WITH b AS (SELECT o_custkey AS c, sum(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT)) AS base FROM orders GROUP BY 1),
p AS (SELECT user_id AS c, sum(CAST(abs(CAST(value AS DECIMAL(18,2)) * 100) AS BIGINT)) AS paid FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT c_custkey, CAST(coalesce(base, 0) - coalesce(paid, 0) AS BIGINT) AS receivable, CAST(coalesce(paid, 0) AS BIGINT) AS received, CAST(0 AS BIGINT) AS result FROM customer LEFT JOIN b ON b.c = c_custkey LEFT JOIN p ON p.c = c_custkey
""")
def dashboard_formula(spark, sf_dir):
    """The home page's own formula, kept apart from the closing: what is paid counts as received, and the result is zero."""
    cents = lambda c: F.abs(F.col(c).cast("decimal(18,2)") * 100).cast("long")
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_totalprice").withColumnRenamed("o_custkey", "c_custkey")
    paid = table(spark, sf_dir, "events", "user_id", "event_type", "value").filter("event_type = 'purchase'").withColumnRenamed("user_id", "c_custkey")
    sums = report.by_owner(table(spark, sf_dir, "customer", "c_custkey"), "c_custkey", base=(orders, cents("o_totalprice")), paid=(paid, cents("value")))
    zero = F.lit(0).cast("long")
    return sums.select("c_custkey", (F.coalesce("base", zero) - F.coalesce("paid", zero)).alias("receivable"), F.coalesce("paid", zero).alias("received"), zero.alias("result"))
