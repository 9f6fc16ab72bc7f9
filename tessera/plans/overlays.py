"""Overlays, names, lineage and temporal spans."""

from pyspark.sql import functions as F

from tessera.functions import texts
from tessera.operators import matching, overlay, report
from tessera.plans.registry import query, table


def order_revisions(spark, sf_dir):
    """Events read as revisions of orders: every seventh one nulls the amount."""
    events = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    amount = F.when(F.col("event_id") % 7 != 0, F.col("value").cast("decimal(18,2)"))
    return events.select(F.col("user_id").alias("o_orderkey"), F.col("event_id").alias("revision"), amount.alias("amount"), F.col("event_type").alias("status"))


def effective_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    source = orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), F.col("o_orderstatus").alias("status"))
    return overlay.effective(source, order_revisions(spark, sf_dir), ["o_orderkey"], ["amount", "status"])


EFFECTIVE = """
WITH rev AS (
  SELECT user_id, event_id, CASE WHEN event_id % 7 <> 0 THEN CAST(value AS DECIMAL(18,2)) END AS amount, event_type,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events
), eff AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day,
    CASE WHEN rev.event_id IS NOT NULL THEN rev.amount ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS amount,
    CASE WHEN rev.event_id IS NOT NULL THEN rev.event_type ELSE o_orderstatus END AS status,
    CAST(o_totalprice AS DECIMAL(18,2)) AS source_amount, rev.event_id IS NOT NULL AS adjusted, coalesce(rev.event_id, 0) AS revision
  FROM orders LEFT JOIN rev ON rev.user_id = o_orderkey AND rn = 1
)
"""


@query("""
SELECT user_id, event_id, event_type, value FROM
(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
""")
def latest_per_key(spark, sf_dir):
    events = table(spark, sf_dir, "events", "user_id", "ts", "event_id", "event_type", "value")
    return overlay.latest(events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query(EFFECTIVE + "SELECT o_orderkey, CAST(amount * 100 AS BIGINT) AS cents, status, CAST(source_amount * 100 AS BIGINT) AS source_cents, adjusted, revision FROM eff")
def effective_overlay(spark, sf_dir):
    eff = effective_orders(spark, sf_dir)
    return eff.select("o_orderkey", (F.col("amount") * 100).cast("long").alias("cents"), "status", (F.col("source_amount") * 100).cast("long").alias("source_cents"), "adjusted", "revision")


@query("""
WITH rev AS (SELECT user_id, event_type, CASE WHEN event_id % 3 <> 0 THEN event_type END AS status, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)
SELECT o_orderkey, coalesce(rev.status, o_orderstatus) AS o_orderstatus FROM orders LEFT JOIN rev ON rev.user_id = o_orderkey AND rn = 1 WHERE o_orderkey % 17 <> 0
""")
def coalesced_overlay(spark, sf_dir):
    """The overlay of notes: a revision's null leaves the source, and tombstoned rows are gone."""
    events = table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    revisions = events.select(F.col("user_id").alias("o_orderkey"), F.col("event_id").alias("revision"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("o_orderstatus"))
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    out = overlay.coalesced(orders, revisions, ["o_orderkey"], ["o_orderstatus"])
    return overlay.without_tombstones(out, orders.filter(F.col("o_orderkey") % 17 == 0), ["o_orderkey"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 17 <> 0")
def tombstone_filter(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    return overlay.without_tombstones(orders, orders.filter(F.col("o_orderkey") % 17 == 0), ["o_orderkey"])


@query("""
WITH s AS (SELECT user_id, event_id, event_type, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS valid_to FROM events)
SELECT user_id, event_id AS valid_from, valid_to, event_type FROM s WHERE event_id <= 5000 AND (valid_to IS NULL OR valid_to > 5000)
""")
def temporal_span_asof(spark, sf_dir):
    events = table(spark, sf_dir, "events", "user_id", "event_id", "event_type")
    return overlay.as_of(overlay.spans(events, ["user_id"], "event_id"), F.lit(5000)).select("user_id", "valid_from", "valid_to", "event_type")


def ledger(spark, sf_dir):
    """Events read as a ledger: three layers by type, records by user."""
    events = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    layer = F.when(F.col("event_id") % 5 == 0, 3).when(F.col("event_id") % 3 == 0, 2).otherwise(1)
    return events.select(F.col("user_id").alias("record"), F.date_trunc("day", "ts").alias("instant"), layer.alias("precedence"), "event_id", F.col("event_type").alias("payload"), F.when(F.col("event_id") % 11 == 0, "disregarded").otherwise("active").alias("state"), F.col("event_id").alias("version"))


LEDGER = """
WITH l AS (
  SELECT user_id AS record, date_trunc('day', ts) AS instant, CASE WHEN event_id % 5 = 0 THEN 3 WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS p, event_id, event_type AS payload,
    CASE WHEN event_id % 11 = 0 THEN 'disregarded' ELSE 'active' END AS state FROM events
), r AS (
  SELECT *, row_number() OVER (PARTITION BY record ORDER BY p DESC, instant DESC, event_id DESC) AS top,
    row_number() OVER (PARTITION BY record, p ORDER BY instant DESC, event_id DESC) AS last_of_layer,
    row_number() OVER (PARTITION BY record ORDER BY instant, p, event_id) AS pos FROM l
), d AS (SELECT record, min(pos) AS pos FROM r WHERE p = 3 GROUP BY record),
a AS (SELECT record, event_id, row_number() OVER (PARTITION BY record ORDER BY r.pos DESC) AS rn FROM r LEFT JOIN d USING (record) WHERE p = 2 AND (d.pos IS NULL OR r.pos < d.pos)),
f AS (
  SELECT t.record, t.payload, t.state, t.event_id AS version, t.p AS layer, s.event_id AS source_event, a.event_id AS adjustment_event, e.event_id AS decision_event, n.n AS n_events
  FROM r t LEFT JOIN r s ON s.record = t.record AND s.p = 1 AND s.last_of_layer = 1 LEFT JOIN r e ON e.record = t.record AND e.p = 3 AND e.last_of_layer = 1
  LEFT JOIN a ON a.record = t.record AND a.rn = 1 JOIN (SELECT record, count(*) AS n FROM l GROUP BY record) n ON n.record = t.record WHERE t.top = 1
)
"""


@query(LEDGER + "SELECT * FROM f")
def reduce_projection(spark, sf_dir):
    return overlay.reduce_projection(ledger(spark, sf_dir))


@query(LEDGER + "SELECT record, CASE WHEN decision_event IS NOT NULL THEN (SELECT payload FROM l WHERE l.event_id = decision_event) WHEN adjustment_event IS NOT NULL THEN (SELECT payload FROM l WHERE l.event_id = adjustment_event) ELSE (SELECT payload FROM l WHERE l.event_id = source_event) END AS effective_payload, false AS broken FROM f")
def resolve_effective(spark, sf_dir):
    events = ledger(spark, sf_dir)
    return overlay.resolve(overlay.reduce_projection(events), events)


@query("""
WITH RECURSIVE p AS (SELECT o_orderkey AS node, CASE WHEN o_orderkey % 40 <> 1 AND o_orderkey > 1 THEN o_orderkey - 1 END AS up FROM orders),
known AS (SELECT node, CASE WHEN up IN (SELECT node FROM p) THEN up END AS up FROM p),
t AS (SELECT node, node AS root, 0 AS depth FROM known WHERE up IS NULL UNION ALL SELECT k.node, t.root, t.depth + 1 FROM known k JOIN t ON k.up = t.node)
SELECT node, root, depth FROM t
""")
def recursive_lineage(spark, sf_dir):
    return order_lineage(table(spark, sf_dir, "orders", "o_orderkey"))


def order_lineage(orders):
    """Orders read as chains of up to forty."""
    parents = orders.select(F.col("o_orderkey").alias("node"), F.when((F.col("o_orderkey") % 40 != 1) & (F.col("o_orderkey") > 1), F.col("o_orderkey") - 1).alias("up"))
    known = parents.select(F.col("node").alias("up")).withColumn("_in", F.lit(True))
    return matching.lineage(parents.join(known, "up", "left").select("node", F.when(F.col("_in"), F.col("up")).alias("up")), "node", "up")


NAMES = """
WITH p AS (SELECT p_partkey AS owner, p_brand AS brand, p_type || '#' || (p_partkey // 5) AS kind FROM part),
titles AS (SELECT brand AS name, min(owner) AS owner FROM p WHERE owner % 2 = 0 GROUP BY 1 UNION ALL SELECT kind, owner FROM p WHERE owner % 3 = 0),
aliases AS (SELECT brand AS name, owner FROM p WHERE owner % 50 = 1 UNION ALL SELECT kind, owner FROM p WHERE owner % 4 = 1),
t AS (SELECT name, owner, 0 AS tier FROM titles UNION ALL SELECT name, owner, 1 FROM aliases),
b AS (SELECT name, tier, min(owner) AS lo, max(owner) AS hi FROM t GROUP BY name, tier),
m AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tier) AS rn FROM b),
n AS (SELECT DISTINCT brand AS name FROM p UNION SELECT DISTINCT kind FROM p)
SELECT n.name, CASE WHEN lo = hi THEN lo END AS owner, tier FROM n LEFT JOIN m ON m.name = n.name AND rn = 1
"""


@query(NAMES)
def alias_resolution(spark, sf_dir):
    """Names by title, then by alias; where a tier has a name several times, no owner is told."""
    kind = F.concat(F.col("p_type"), F.lit("#"), F.call_function("div", F.col("p_partkey"), F.lit(5)).cast("string"))
    part = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type").select(F.col("p_partkey").alias("owner"), F.col("p_brand").alias("brand"), kind.alias("kind"))
    pick = lambda rule, c: part.filter(rule).select(F.col(c).alias("name"), "owner")
    titles = pick("owner % 2 = 0", "brand").groupBy("name").agg(F.min("owner").alias("owner")).unionByName(pick("owner % 3 = 0", "kind"))
    aliases = pick("owner % 50 = 1", "brand").unionByName(pick("owner % 4 = 1", "kind"))
    names = part.select(F.col("brand").alias("name")).union(part.select("kind")).distinct()
    return matching.resolve_names(names, titles, aliases, "name", "owner")


@query("""
WITH a AS (SELECT p_partkey, trim(regexp_replace(lower(strip_accents(p_name)), '\\s+', ' ', 'g')) AS k FROM part),
b AS (SELECT p_partkey AS other, trim(regexp_replace(lower(strip_accents('  ' || upper(replace(replace(replace(p_name, 'a', 'á'), 'e', 'ê'), 's', 'š')) || ' ')), '\\s+', ' ', 'g')) AS k FROM part WHERE p_partkey % 3 = 0)
SELECT p_partkey, count(*) AS n_titles, min(other) AS first_other FROM a JOIN b ON a.k = b.k GROUP BY p_partkey
""")
def normalized_title_join(spark, sf_dir):
    part = table(spark, sf_dir, "part", "p_partkey", "p_name")
    marked = F.concat(F.lit("  "), F.upper(F.replace(F.replace(F.replace("p_name", F.lit("a"), F.lit("á")), F.lit("e"), F.lit("ê")), F.lit("s"), F.lit("š"))), F.lit(" "))
    # One row a title on the right: what the join would multiply is counted first.
    right = part.filter("p_partkey % 3 = 0").groupBy(texts.title_key(marked).alias("key")).agg(F.count("*").alias("n_titles"), F.min("p_partkey").alias("first_other"))
    return part.select("p_partkey", texts.title_key(F.col("p_name")).alias("key")).join(right, "key").select("p_partkey", "n_titles", "first_other")


@query(EFFECTIVE + """, m AS (SELECT date_trunc('month', day) AS month, sum(amount) AS t FROM eff WHERE month(day) NOT IN (3, 7) GROUP BY 1),
e AS (SELECT min(month) AS a, max(month) AS b FROM m WHERE t <> 0),
x AS (SELECT unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS month FROM e)
SELECT strftime(x.month, '%Y-%m') AS month, CAST(coalesce(t, 0) * 100 AS BIGINT) AS cents FROM x LEFT JOIN m ON m.month = x.month""")
def monthly_trend_gapfill(spark, sf_dir):
    eff = effective_orders(spark, sf_dir).filter(~F.month("day").isin(3, 7))
    return report.monthly_trend(eff, "day", "amount").select("month", (F.col("total") * 100).cast("long").alias("cents"))
