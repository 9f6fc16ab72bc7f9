"""Reports: universes kept apart, histograms, pages, searches, publications and audits."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import texts
from tessera.operators import load, overlay, report
from tessera.plans.registry import query, table


def cents(name):
    return (F.col(name).cast("decimal(18,2)") * 100).cast("long")


def cents_sql(name):
    return f"CAST(CAST({name} AS DECIMAL(18,2)) * 100 AS BIGINT)"


@query(f"""
SELECT (SELECT CAST(sum({cents_sql("o_totalprice")}) AS BIGINT) FROM orders) AS orders, (SELECT CAST(sum({cents_sql("l_extendedprice")}) AS BIGINT) FROM lineitem) AS lines,
 (SELECT CAST(sum({cents_sql("value")}) AS BIGINT) FROM events) AS events, (SELECT CAST(sum({cents_sql("value")}) AS BIGINT) FROM events WHERE event_type = 'none') AS nothing
""")
def universe_totals(spark, sf_dir):
    """Sums of universes that are never added across; one without rows is unknown, not zero."""
    events = table(spark, sf_dir, "events", "event_type", "value")
    return report.universes(
        orders=(table(spark, sf_dir, "orders", "o_totalprice"), cents("o_totalprice")), lines=(table(spark, sf_dir, "lineitem", "l_extendedprice"), cents("l_extendedprice")),
        events=(events, cents("value")), nothing=(events.filter("event_type = 'none'"), cents("value")),
    )


@query(f"""
WITH o AS (SELECT o_custkey AS k, CAST(sum({cents_sql("o_totalprice")}) AS BIGINT) AS s, count(*) AS n FROM orders GROUP BY 1), e AS (SELECT user_id AS k, CAST(sum({cents_sql("value")}) AS BIGINT) AS s, count(*) AS n FROM events GROUP BY 1)
SELECT c_custkey, o.s AS ordered, coalesce(o.n, 0) AS n_ordered, e.s AS spent, coalesce(e.n, 0) AS n_spent FROM customer LEFT JOIN o ON o.k = c_custkey LEFT JOIN e ON e.k = c_custkey
""")
def portfolio_scalars(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_totalprice").withColumnRenamed("o_custkey", "c_custkey")
    events = table(spark, sf_dir, "events", "user_id", "value").withColumnRenamed("user_id", "c_custkey")
    return report.by_owner(table(spark, sf_dir, "customer", "c_custkey"), "c_custkey", ordered=(orders, cents("o_totalprice")), spent=(events, cents("value")))


@query(f"""
WITH r AS (SELECT o_custkey AS owner, {cents_sql("o_totalprice")} AS ordered, NULL AS audited, NULL AS spent, NULL AS refunded FROM orders
 UNION ALL SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 END, NULL, CASE WHEN o_orderstatus = 'F' THEN {cents_sql("o_totalprice")} END, NULL, NULL FROM orders
 UNION ALL SELECT user_id, NULL, NULL, CASE WHEN event_type = 'purchase' THEN {cents_sql("value")} END, CASE WHEN event_type = 'error' THEN {cents_sql("value")} END FROM events),
k AS (SELECT * FROM r WHERE coalesce(ordered, audited, spent, refunded) IS NOT NULL)
SELECT CASE WHEN grouping(owner) = 1 THEN 'global' ELSE 'project' END AS model, owner, CAST(sum(ordered) AS BIGINT) AS ordered, count(ordered) AS n_ordered, CAST(sum(audited) AS BIGINT) AS audited, count(audited) AS n_audited,
 CAST(sum(spent) AS BIGINT) AS spent, count(spent) AS n_spent, CAST(sum(refunded) AS BIGINT) AS refunded, count(refunded) AS n_refunded
FROM k GROUP BY GROUPING SETS ((owner), ()) HAVING grouping(owner) = 1 OR owner IS NOT NULL
""")
def report_models(spark, sf_dir):
    """Every owner's model and the global one: declared and audited orders, purchases and errors, each its own universe."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    events = table(spark, sf_dir, "events", "user_id", "event_type", "value")
    of = lambda kind: F.when(F.col("event_type") == kind, cents("value"))
    audited = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") + 1)
    return report.models(
        "owner",
        (orders, {"ordered": (F.col("o_custkey"), cents("o_totalprice")), "audited": (audited, F.when(F.col("o_orderstatus") == "F", cents("o_totalprice")))}),
        (events, {"spent": (F.col("user_id"), of("purchase")), "refunded": (F.col("user_id"), of("error"))}),
    )


@query("""
WITH v AS (SELECT user_id, bool_or(event_type = 'purchase') AS published, max(event_id) FILTER (event_type = 'purchase') AS bought, max(event_id) AS last, bool_or(event_type = 'signup') AS ready FROM events GROUP BY 1),
s AS (SELECT CASE WHEN published AND bought = last THEN 'published' WHEN published THEN 'stale' WHEN ready THEN 'ready' ELSE 'working' END AS status FROM customer LEFT JOIN v ON user_id = c_custkey)
SELECT status, count(*) AS n FROM s GROUP BY 1
""")
def status_histogram(spark, sf_dir):
    """Customers by status: published and nothing since, stale, ready, or working."""
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    seen = table(spark, sf_dir, "events", "user_id", "event_id", "event_type").groupBy("user_id").agg(F.max(bought).alias("at"), F.max("event_id").alias("last"), F.bool_or(F.col("event_type") == "signup").alias("ready"))
    status = F.when(F.col("at") == F.col("last"), "published").when(F.col("at").isNotNull(), "stale").when(F.col("ready"), "ready").otherwise("working")
    joined = table(spark, sf_dir, "customer", "c_custkey").join(seen, F.col("user_id") == F.col("c_custkey"), "left")
    return joined.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(f"""
SELECT o_custkey, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first_day, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last_day, count(DISTINCT o_orderpriority) AS n_priorities, count(*) AS n, CAST(sum({cents_sql("o_totalprice")}) // 3600 AS BIGINT) AS hours FROM orders GROUP BY 1
""")
def rollup_update(spark, sf_dir):
    """What a dimension row keeps of its facts."""
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    day = F.col("o_orderdate").cast("date")
    return orders.groupBy("o_custkey").agg(F.min(day).cast("string").alias("first_day"), F.max(day).cast("string").alias("last_day"), F.count_distinct("o_orderpriority").alias("n_priorities"), F.count("*").alias("n"), F.call_function("div", F.sum(cents("o_totalprice")), F.lit(3600)).alias("hours"))


@query("SELECT n_name, count(DISTINCT c_custkey) AS n_customers, count(DISTINCT o_orderkey) AS n_orders, CAST(max(o_orderdate) AS VARCHAR)[1:10] AS last_day FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def distinct_under_fanout(spark, sf_dir):
    """Counts that a chain of joins doesn't multiply: orders are counted by customer before they join."""
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderdate").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last"))
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    by_nation = customers.groupBy("c_nationkey").agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.max("last").alias("last"))
    nations = table(spark, sf_dir, "nation", "n_nationkey", "n_name").join(by_nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    zero = F.lit(0).cast("long")
    return nations.select("n_name", F.coalesce("c", zero).alias("n_customers"), F.coalesce("n", zero).alias("n_orders"), F.date_format("last", "yyyy-MM-dd").alias("last_day"))


@query(f"""
SELECT l_linestatus, count(*) FILTER (l_returnflag = 'A') AS n_a, count(*) FILTER (l_returnflag = 'N') AS n_n, count(*) FILTER (l_returnflag = 'R') AS n_r, CAST(sum({cents_sql("l_extendedprice")}) FILTER (l_returnflag = 'R') AS BIGINT) AS returned, bool_and(l_quantity > 0) AS all_positive FROM lineitem GROUP BY 1
""")
def filtered_pivot(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", "l_linestatus", "l_returnflag", "l_extendedprice", "l_quantity")
    flag = F.col("l_returnflag")
    return lines.groupBy("l_linestatus").agg(*(F.count_if(flag == f).alias(f"n_{f.lower()}") for f in "ANR"), F.sum(F.when(flag == "R", cents("l_extendedprice"))).alias("returned"), F.bool_and(F.col("l_quantity") > 0).alias("all_positive"))


@query(f"""
WITH l AS (SELECT l_orderkey AS k, count(*) AS n, CAST(sum({cents_sql("l_extendedprice")}) AS BIGINT) AS c FROM lineitem WHERE l_orderkey % 37 <> 0 GROUP BY 1),
r AS (SELECT l_orderkey AS k, count(*) AS n, CAST(sum({cents_sql("l_extendedprice")} + CASE WHEN l_orderkey % 41 = 0 AND l_linenumber = 1 THEN 1 ELSE 0 END) AS BIGINT) AS c FROM lineitem WHERE l_orderkey % 43 <> 0 GROUP BY 1)
SELECT coalesce(l.k, r.k) AS l_orderkey, CASE WHEN l.k IS NULL THEN 'only_right' WHEN r.k IS NULL THEN 'only_left' ELSE 'differs' END AS issue FROM l FULL JOIN r ON l.k = r.k WHERE l.k IS NULL OR r.k IS NULL OR l.n <> r.n OR l.c <> r.c
""")
def full_outer_audit(spark, sf_dir):
    """A table derived twice: keys that only one side has, and keys on which they differ."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    off = F.when((F.col("l_orderkey") % 41 == 0) & (F.col("l_linenumber") == 1), 1).otherwise(0)
    left = lines.filter("l_orderkey % 37 != 0").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(cents("l_extendedprice")).alias("c"))
    right = lines.filter("l_orderkey % 43 != 0").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(cents("l_extendedprice") + off).alias("c"))
    return report.audit(left, right, "l_orderkey", ["n", "c"])


@query("SELECT c_custkey, c_name, true AS has_more FROM customer WHERE c_custkey > 17 ORDER BY c_custkey LIMIT 25")
def keyset_page(spark, sf_dir):
    return report.keyset_page(table(spark, sf_dir, "customer", "c_custkey", "c_name"), "c_custkey", F.lit(17), 25)


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn, count(*) OVER () AS n FROM orders) WHERE rn > (n - 1) // 100 * 100")
def offset_page(spark, sf_dir):
    """A page number past the end is clamped to the last page."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    return report.offset_page(orders, [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey")], page=10**9)


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name || ' ' || p_type), 'st') AND p_size % 5 <> 0")
def text_search(spark, sf_dir):
    """A literal search over several columns; archived rows only on demand."""
    part = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_size").withColumn("archived", F.col("p_size") % 5 == 0)
    return report.text_search(part, ["p_name", "p_type"], "ST", "archived").select("p_partkey", "p_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 13 <> 0 AND (contains(CAST(c_custkey AS VARCHAR), '2') OR contains('segment', '2') OR contains(lower(c_mktsegment), '2') OR contains(lower(c_name), '2'))")
def stable_search(spark, sf_dir):
    """Records by id, attributes or allowed payload fields; the payload's other fields are never searched."""
    customer = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    records = customer.select(F.col("c_custkey").alias("record"), F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("attributes"), F.create_map(F.lit("name"), F.col("c_name"), F.lit("balance"), F.col("c_acctbal").cast("string")).alias("payload"), F.when(F.col("c_custkey") % 13 == 0, "disregarded").otherwise("active").alias("state"))
    return report.record_search(records, "2", ["name"]).select(F.col("record").alias("c_custkey"))


@query("""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS v FROM orders)
SELECT o_orderkey, row_number() OVER (ORDER BY v DESC NULLS LAST, o_orderkey) AS place FROM o
""")
def official_order(spark, sf_dir):
    """Every order's place in the official order, absent values last when it descends."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    value = F.when(F.col("o_orderkey") % 50 != 0, F.col("o_totalprice").cast("decimal(18,2)"))
    order = [report.official_order(F.col("v"), descending=True), F.col("o_orderkey")]
    return load.numbered(orders.select("o_orderkey", value.alias("v")), order, "place").select("o_orderkey", F.col("place").cast("long").alias("place"))


@query("""
SELECT 'activity' AS section, CAST(o_orderkey AS VARCHAR) AS code, o_orderpriority AS label, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS value FROM orders
UNION ALL SELECT 'financial', CAST(c_custkey AS VARCHAR), c_mktsegment, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) FROM customer
UNION ALL SELECT 'evidence', CAST(p_partkey AS VARCHAR), p_brand, CAST(p_size AS VARCHAR) FROM part
""")
def publication_long(spark, sf_dir):
    money = lambda c: F.col(c).cast("decimal(18,2)")
    return report.publication({
        "activity": (table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_totalprice"), F.col("o_orderkey"), F.col("o_orderpriority"), money("o_totalprice")),
        "financial": (table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_acctbal"), F.col("c_custkey"), F.col("c_mktsegment"), money("c_acctbal")),
        "evidence": (table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size"), F.col("p_partkey"), F.col("p_brand"), F.col("p_size")),
    })


@query(f"""
WITH s AS (
 SELECT 0 AS section_no, 1 AS place, 'publication' AS section, 'PUB-7' AS record_code, NULL AS group_code, 'Orders' AS title, 'Versão 4' AS effective_value, NULL AS source_value, NULL AS revision, NULL AS status
 UNION ALL SELECT 1, row_number() OVER (ORDER BY o_orderkey), 'activity', 'O' || o_orderkey, 'project_measurement', o_orderpriority, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), NULL, '0', o_orderstatus FROM orders
 UNION ALL SELECT 2, row_number() OVER (ORDER BY c_custkey), 'financial', 'C' || c_custkey, c_mktsegment, CASE WHEN c_custkey % 10 = 0 THEN 'contato {texts.OMITTED}' ELSE c_name END, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR), CAST(CAST(c_acctbal AS DECIMAL(18,2)) + 1 AS VARCHAR), NULL, NULL FROM customer
 UNION ALL SELECT 3, row_number() OVER (ORDER BY p_size DESC, p_partkey), 'evidence_metadata', 'EVD-' || CASE WHEN row_number() OVER (ORDER BY p_size DESC, p_partkey) < 1000 THEN lpad(CAST(row_number() OVER (ORDER BY p_size DESC, p_partkey) AS VARCHAR), 3, '0') ELSE CAST(row_number() OVER (ORDER BY p_size DESC, p_partkey) AS VARCHAR) END, NULL, p_brand, CAST(p_size AS VARCHAR), NULL, NULL, 'metadata' FROM part)
SELECT CAST(section_no AS INTEGER) AS section_no, CAST(place AS BIGINT) AS place, 'PUB-7' AS publication_code, section, record_code, group_code, title, effective_value, source_value, revision, CAST(NULL AS VARCHAR) AS actor, CAST(NULL AS VARCHAR) AS reason, status FROM s
""")
def publication_sections(spark, sf_dir):
    """A publication of the fourth form: its head, activities, entries and evidence, numbered by section and redacted."""
    money = lambda c: F.col(c).cast("decimal(18,2)")
    named = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    head = spark.range(1).withColumn("v", F.lit("Versão 4"))
    name = F.when(F.col("c_custkey") % 10 == 0, "contato someone@example.org").otherwise(F.col("c_name"))
    return report.published("PUB-7", "v4", [
        report.Section("publication", head, ["id"], F.lit("PUB-7"), {"title": F.lit("Orders"), "effective_value": F.col("v")}),
        report.Section("activity", table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus"), ["o_orderkey"], named("O", "o_orderkey"), {"group_code": F.lit("project_measurement"), "title": F.col("o_orderpriority"), "effective_value": money("o_totalprice"), "revision": F.lit(0), "status": F.col("o_orderstatus")}),
        report.Section("financial", table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_name", "c_acctbal"), ["c_custkey"], named("C", "c_custkey"), {"group_code": F.col("c_mktsegment"), "title": name, "effective_value": money("c_acctbal"), "source_value": money("c_acctbal") + 1}),
        report.Section("evidence_metadata", table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size").withColumn("down", -F.col("p_size")), ["down", "p_partkey"], "EVD", {"title": F.col("p_brand"), "effective_value": F.col("p_size"), "status": F.lit("metadata")}),
    ], lambda c: texts.redact_places(texts.redact_personal(c)), plain=("group_code", "effective_value", "source_value", "revision"))


VERSIONS = """
WITH h AS (SELECT user_id, event_id, sha256(event_type) AS content_hash FROM events), c AS (SELECT *, lag(content_hash) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM content_hash AS fresh FROM h),
v AS (SELECT user_id, event_id, content_hash, NOT fresh AS reused, CAST(sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS version FROM c)
"""


def published(spark, sf_dir):
    return report.versions(table(spark, sf_dir, "events", "user_id", "event_id", "event_type"), "user_id", "event_id", "event_type").drop("event_type")


@query(VERSIONS + "SELECT * FROM v")
def publication_versions(spark, sf_dir):
    return published(spark, sf_dir)


@query("""
WITH h AS (SELECT CASE WHEN event_id % 2 = 0 THEN -1 ELSE user_id END AS scope, event_id, sha256(event_type) AS content_hash FROM events), c AS (SELECT *, lag(content_hash) OVER (PARTITION BY scope ORDER BY event_id) IS DISTINCT FROM content_hash AS fresh FROM h)
SELECT scope, event_id, content_hash, NOT fresh AS reused, CAST(sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY scope ORDER BY event_id) AS BIGINT) AS version FROM c
""")
def hot_versions(spark, sf_dir):
    """Versions where one scope holds half of all snapshots: ranges of its order are sorted apart."""
    events = table(spark, sf_dir, "events", "user_id", "event_id", "event_type")
    hot = events.select(F.when(F.col("event_id") % 2 == 0, F.lit(-1)).otherwise(F.col("user_id")).alias("scope"), "event_id", "event_type")
    return report.versions(hot, "scope", "event_id", "event_type", in_task=100).drop("event_type")


@query("""
WITH h AS (SELECT CASE WHEN event_id % 2 = 0 THEN -1 ELSE user_id END AS scope, event_id FROM events)
SELECT scope, event_id AS valid_from, lead(event_id) OVER (PARTITION BY scope ORDER BY event_id) AS valid_to FROM h
""")
def hot_spans(spark, sf_dir):
    """Spans where one key holds half of all revisions."""
    events = table(spark, sf_dir, "events", "user_id", "event_id")
    hot = events.select(F.when(F.col("event_id") % 2 == 0, F.lit(-1)).otherwise(F.col("user_id")).alias("scope"), "event_id")
    return overlay.spans(hot, ["scope"], "event_id", in_task=100).select("scope", "valid_from", "valid_to")


@query(VERSIONS + "SELECT user_id, min(version) AS first_purged FROM v WHERE event_id % 97 = 0 OR content_hash = sha256('error') GROUP BY 1")
def purge_boundary(spark, sf_dir):
    found = published(spark, sf_dir)
    return report.purge_boundary(found.filter("event_id % 97 = 0"), found.filter(F.col("content_hash") == F.sha2(F.lit("error"), 256)), "user_id", "version")


@query("""
WITH u AS (SELECT o_custkey AS k, count(*) AS used FROM orders GROUP BY 1), d AS (SELECT c_custkey AS k, c_custkey % 20 AS declared FROM customer)
SELECT k AS c_custkey, coalesce(used, 0) AS used, declared, coalesce(used, 0) <= declared AS holds FROM d LEFT JOIN u USING (k)
""")
def quota_audit(spark, sf_dir):
    used = table(spark, sf_dir, "orders", "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("used"))
    quota = table(spark, sf_dir, "customer", "c_custkey").withColumn("declared", F.col("c_custkey") % 20)
    joined = quota.join(used, F.col("o_custkey") == F.col("c_custkey"), "left").withColumn("used", F.coalesce("used", F.lit(0).cast("long")))
    return joined.select("c_custkey", "used", "declared", (F.col("used") <= F.col("declared")).alias("holds"))


@query("""
WITH c AS (SELECT 'orphan_lines' AS "check", (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS value, CAST(0 AS BIGINT) AS expected
UNION ALL SELECT 'orphan_orders', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)), 0
UNION ALL SELECT 'nations', (SELECT count(*) FROM nation), 25 UNION ALL SELECT 'repeated_orders', (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)), 0
UNION ALL SELECT 'unpriced', (SELECT count(*) FROM part WHERE p_retailprice IS NULL OR p_retailprice <= 0), 0)
SELECT *, value = expected AS holds FROM c
""")
def invariant_checks(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem", "l_orderkey")
    return report.checks(
        orphan_lines=(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"), 0),
        orphan_orders=(orders.join(table(spark, sf_dir, "customer", "c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_anti"), 0),
        nations=(table(spark, sf_dir, "nation"), 25),
        repeated_orders=(orders.groupBy("o_orderkey").count().filter("count > 1"), 0),
        unpriced=(table(spark, sf_dir, "part", "p_retailprice").filter("p_retailprice IS NULL OR p_retailprice <= 0"), 0),
    )


@query("""
SELECT l_orderkey, CAST(pos AS INTEGER) AS pos, l_partkey, quantity FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR)) - 1 AS pos, l_partkey, CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) AS quantity FROM lineitem)
""")
def json_rows_explode(spark, sf_dir):
    """Rows kept as JSON arrays of bounded stretches, read back with their places in the whole."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("decimal(18,2)").cast("string").alias("quantity"))
    # No row holds a whole order: 64 line numbers make one stretch, and a stretch begins behind those before it.
    stretch = F.call_function("div", F.col("l_linenumber"), F.lit(64))
    packed = lines.groupBy("l_orderkey", stretch.alias("stretch")).agg(F.to_json(F.array_sort(F.collect_list(item))).alias("rows"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("l_orderkey").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    schema = "array<struct<l_linenumber:int,l_partkey:bigint,l_suppkey:bigint,quantity:string>>"
    begun = packed.select("l_orderkey", "rows", F.coalesce(before, F.lit(0)).cast("int").alias("begin"))
    return begun.select("l_orderkey", "begin", F.posexplode(F.from_json("rows", schema)).alias("at", "r")).select("l_orderkey", (F.col("begin") + F.col("at")).alias("pos"), "r.l_partkey", "r.quantity")


@query("SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE user_id % 7 = 0 OR CAST(json_extract(props, '$.k') AS INTEGER) % 10 = 3")
def json_state_filter(spark, sf_dir):
    """A predicate over a column or the same value in a JSON before-image."""
    events = table(spark, sf_dir, "events", "event_id", "user_id", "props").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return events.filter((F.col("user_id") % 7 == 0) | (F.col("k") % 10 == 3)).select("event_id", "user_id", "k")


@query("""
SELECT 'order' AS source, o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus AS what FROM orders
UNION ALL SELECT 'event', event_id, strftime(ts, '%Y-%m-%d'), event_type FROM events
""")
def merged_history(spark, sf_dir):
    """Two histories as one table; whoever shows it sorts it by day."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_orderstatus").select(F.lit("order").alias("source"), F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderstatus").alias("what"))
    events = table(spark, sf_dir, "events", "event_id", "ts", "event_type").select(F.lit("event").alias("source"), F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("what"))
    return orders.unionByName(events)


@query("""
WITH v AS (SELECT user_id, event_id, event_id = max(event_id) FILTER (event_type <> 'error') OVER (PARTITION BY user_id) AS last FROM events)
SELECT user_id, event_id, coalesce(last, false) AS last FROM v WHERE last OR event_id % 101 = 0
""")
def latest_or_pinned(spark, sf_dir):
    """The latest active version of each document, and the versions that proofs pin."""
    events = table(spark, sf_dir, "events", "user_id", "event_id", "event_type")
    last = overlay.latest(events.filter("event_type != 'error'"), ["user_id"], ["event_id"]).select("event_id", F.lit(True).alias("_last"))
    pinned = events.filter("event_id % 101 = 0").select("event_id").withColumn("_pin", F.lit(True))
    joined = events.join(last, "event_id", "left").join(pinned, "event_id", "left").filter("_last OR _pin")
    return joined.select("user_id", "event_id", F.coalesce("_last", F.lit(False)).alias("last"))


@query("""
WITH s AS (SELECT s_suppkey AS id, s_nationkey AS n FROM supplier), c AS (SELECT c_custkey AS id, c_nationkey AS n FROM customer)
SELECT n, list_sort(list(DISTINCT role))[1] AS first_role, count(DISTINCT role) AS n_roles, count(DISTINCT id) AS n_ids FROM (SELECT n, id, 'supplier' AS role FROM s UNION SELECT n, id, 'customer' FROM c) GROUP BY 1
""")
def role_union(spark, sf_dir):
    """A distinct union of roles, and what each group of it holds."""
    side = lambda name, key, nation, role: table(spark, sf_dir, name, key, nation).select(F.col(nation).alias("n"), F.col(key).alias("id"), F.lit(role).alias("role"))
    roles = side("supplier", "s_suppkey", "s_nationkey", "supplier").union(side("customer", "c_custkey", "c_nationkey", "customer")).distinct()
    return roles.groupBy("n").agg(F.min("role").alias("first_role"), F.count_distinct("role").alias("n_roles"), F.count_distinct("id").alias("n_ids"))


@query("""
WITH a AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey FROM orders WHERE o_orderkey % 7 <> 0)
SELECT DISTINCT o_custkey FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a))
""")
def affected_owners(spark, sf_dir):
    """Owners of rows that a load adds, takes away or moves."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    before = orders.filter("o_orderkey % 5 != 0")
    after = orders.filter("o_orderkey % 7 != 0").withColumn("o_custkey", F.when(F.col("o_orderkey") % 9 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    # One shuffle: each row carries its side, and rows of both sides are no difference.
    sides = before.withColumn("_side", F.lit(1)).unionByName(after.withColumn("_side", F.lit(2)))
    return sides.groupBy("o_orderkey", "o_custkey").agg(F.min("_side").alias("a"), F.max("_side").alias("b")).filter("a = b").select("o_custkey").distinct()


@query(f"""
WITH t AS (SELECT l_returnflag AS field, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber % 2 = 0 THEN CAST(CAST({cents_sql("l_extendedprice")} // 100 AS BIGINT) AS VARCHAR) ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS v, l_linenumber FROM lineitem)
SELECT field, CAST(sum(CAST(v AS DECIMAL(18,2))) * 100 AS BIGINT) AS cents, count(*) AS n_sources, count(v) AS n_values, count(v) FILTER (l_linenumber % 2 = 0) AS n_whole FROM t GROUP BY 1
""")
def running_metrics(spark, sf_dir):
    """Two batches merged into one accumulator give what all rows at once give."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    text = F.when(F.col("l_linenumber") == 7, None).when(F.col("l_linenumber") % 2 == 0, F.call_function("div", cents("l_extendedprice"), F.lit(100)).cast("string")).otherwise(price.cast("string"))
    rows = lines.select("l_orderkey", F.col("l_returnflag").alias("field"), text.alias("v"))
    first = report.accumulate(None, rows.filter("l_orderkey % 2 = 0"), "field", "v")
    both = report.accumulated(report.accumulate(first, rows.filter("l_orderkey % 2 = 1"), "field", "v"))
    return both.select("field", (F.col("total") * 100).cast("long").alias("cents"), "n_sources", "n_values", F.coalesce(F.try_element_at("scales", F.lit(0)), F.lit(0).cast("long")).alias("n_whole"))


@query(f"""
WITH n AS (SELECT o_custkey AS d, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 END AS a, {cents_sql("o_totalprice")} AS v, CASE WHEN o_orderkey % 2 = 0 THEN {cents_sql("o_totalprice")} // 2 END AS r FROM orders)
SELECT d AS owner, 'declared' AS basis, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, CAST(NULL AS BIGINT) AS related FROM n GROUP BY 1 UNION ALL SELECT a, 'audited', count(*), CAST(sum(v) AS BIGINT), CAST(sum(r) AS BIGINT) FROM n WHERE a IS NOT NULL GROUP BY 1
""")
def financial_references(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    k = F.col("o_orderkey")
    notes = orders.select(F.col("o_custkey").alias("d"), F.when(k % 3 == 0, F.col("o_custkey") + 1).alias("a"), cents("o_totalprice").alias("v"), F.when(k % 2 == 0, F.call_function("div", cents("o_totalprice"), F.lit(2))).alias("r"))
    return report.references(notes, "d", "a", "v", "r")


@query("""
SELECT DISTINCT k AS owner FROM (SELECT o_custkey AS k FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT user_id FROM events WHERE event_type = 'error' AND event_id % 3 = 0 UNION ALL SELECT CASE WHEN c_custkey % 7 = 0 THEN c_custkey END FROM customer) WHERE k IS NOT NULL
""")
def affected_roles(spark, sf_dir):
    """Owners that a note's tombstone touches in any of its roles."""
    return report.affected(
        "owner",
        declared=(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").filter("o_orderkey % 50 = 0"), "o_custkey"),
        candidate=(table(spark, sf_dir, "events", "user_id", "event_id", "event_type").filter("event_type = 'error' AND event_id % 3 = 0"), "user_id"),
        linked=(table(spark, sf_dir, "customer", "c_custkey").select(F.when(F.col("c_custkey") % 7 == 0, F.col("c_custkey")).alias("k")), "k"),
    )


@query("""
WITH l AS (SELECT l_orderkey AS k FROM lineitem WHERE l_linenumber = 1), r AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 61 <> 0)
SELECT (SELECT count(*) FROM l) AS n_left, (SELECT count(*) FROM r) AS n_right, (SELECT count(*) FROM (SELECT k FROM l EXCEPT SELECT k FROM r)) AS only_left, (SELECT count(*) FROM (SELECT k FROM r EXCEPT SELECT k FROM l)) AS only_right,
 (SELECT count(DISTINCT k) FROM (SELECT k FROM l GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT k FROM r GROUP BY 1 HAVING count(*) > 1)) AS repeated, false AS same
""")
def locator_sets(spark, sf_dir):
    left = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("k"))
    right = table(spark, sf_dir, "orders", "o_orderkey").filter("o_orderkey % 61 != 0").select(F.col("o_orderkey").alias("k"))
    return report.same_sets(left, right, "k")


@query("""
WITH u AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'sheet' ELSE 'pdf' END AS kind, event_type AS part FROM events), e(kind, part, expected) AS (VALUES ('sheet', 'view', 2), ('sheet', 'click', 1), ('pdf', 'view', 1)),
w AS (SELECT DISTINCT user_id, u.kind, e.part, expected FROM u JOIN e ON e.kind = u.kind), f AS (SELECT user_id, kind, part, count(*) AS n FROM u GROUP BY ALL)
SELECT coalesce(w.user_id, f.user_id) AS user_id, coalesce(w.kind, f.kind) AS kind, coalesce(w.part, f.part) AS part, coalesce(n, 0) AS n, CAST(coalesce(expected, 0) AS BIGINT) AS expected FROM w FULL JOIN f ON w.user_id = f.user_id AND w.part = f.part WHERE coalesce(n, 0) <> coalesce(expected, 0)
""")
def upload_shape(spark, sf_dir):
    """Uploads whose parts aren't there in the number that their kind asks for."""
    events = table(spark, sf_dir, "events", "user_id", "event_type")
    uploads = events.select("user_id", F.when(F.col("user_id") % 2 == 0, "sheet").otherwise("pdf").alias("kind"), F.col("event_type").alias("part"))
    return report.shape(uploads, "kind", "user_id", {"sheet": {"view": 2, "click": 1}, "pdf": {"view": 1}}, "part")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'hash' WHEN c_custkey % 5 = 0 THEN 'columns' END AS issue FROM customer
""")
def snapshot_integrity(spark, sf_dir):
    """Published rows against their snapshots: some hashes and some columns were tampered with."""
    customer = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    k = F.col("c_custkey")
    content = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")))
    held = customer.select("c_custkey", content.alias("content"), F.when(k % 5 == 0, "other").otherwise(F.col("c_mktsegment")).alias("segment"))
    stored = held.select("*", F.when(k % 3 == 0, None).otherwise(F.sha2("content", 256)).alias("canonical"), F.when(k % 9 == 0, F.lit("0")).otherwise(F.sha2("content", 256)).alias("legacy"))
    # A row of either hash is whole; those divisible by 9 have neither.
    return report.verify_snapshots(stored, "content", ("canonical", "legacy"), {"segment": "$.segment"}).select("c_custkey", "issue")


@query("""
SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities, CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS n_status, bool_or(o_orderstatus = 'F') AS any_f, bool_and(o_orderstatus = 'O') AS all_o FROM orders GROUP BY 1
""")
def ordered_lists(spark, sf_dir):
    """Distinct values of a group in order (they are few, whatever the number of rows), and its flags."""
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderpriority", "o_orderstatus")
    return orders.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), "|").alias("priorities"), F.count_distinct("o_orderstatus").alias("n_status"), F.bool_or(F.col("o_orderstatus") == "F").alias("any_f"), F.bool_and(F.col("o_orderstatus") == "O").alias("all_o"))
