"""Matching and reconciliation over orders, customers and events."""

import uuid

from pyspark.sql import functions as F

from tessera.operators import chain, keytree, matching, reconcile, rederive, report
from tessera.plans.registry import query, table
from tessera.sources import commits
from tessera.storage import shared_dir, written

PAYLOAD = "map('status', o_orderstatus, 'priority', o_orderpriority, 'total', cast(cast(o_totalprice AS decimal(18,2)) AS string))"


def batch(spark, sf_dir, more=None):
    """Orders read as records, as an incoming batch of lines, and as their matches; ``more``: columns that records and lines have besides."""
    orders, more = table(spark, sf_dir, "orders"), [column.alias(name) for name, column in (more or {}).items()]
    k = F.col("o_orderkey")
    proof = F.when(k % 6 == 0, F.create_map(F.lit("total"), F.lit("sheet"))).when(k % 6 == 1, F.create_map().cast("map<string,string>"))
    records = orders.filter(k % 29 != 0).select(k.alias("record"), F.expr(PAYLOAD).alias("payload"), proof.alias("provenance"), F.when(k % 9 == 0, 3).when(k % 9 == 1, 2).otherwise(1).alias("layer"), F.when(k % 23 == 0, "disregarded").otherwise("active").alias("state"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), *more)
    changed = F.expr(PAYLOAD.replace("o_orderstatus", "if(o_orderkey % 11 = 0, 'X', o_orderstatus)"))
    lines = orders.filter(k % 5 != 0).select(k.alias("line"), changed.alias("payload"), F.when(k % 12 == 7, None).otherwise(proof).alias("provenance"), (F.col("o_totalprice").cast("decimal(18,2)") + F.when(k % 11 == 0, 1).otherwise(0).cast("decimal(18,2)")).cast("decimal(18,2)").alias("amount"), *more)
    target = F.when(k % 13 == 0, k + 1).otherwise(k)
    match = F.when(k % 29 == 0, "none").when(k % 31 == 0, "multiple").otherwise("unique")
    matches = orders.filter(k % 5 != 0).select(k.alias("line"), match.alias("match"), F.when(match == "unique", target).alias("record"))
    return records, lines, matches


def batch_decisions(spark, sf_dir):
    """Events read as decisions on lines, two revisions of some."""
    events = table(spark, sf_dir, "events", "event_id", "event_type")
    outcome = F.when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "signup", "keep").when(F.col("event_type") == "click", "create").otherwise("link")
    line = F.call_function("div", F.col("event_id"), F.lit(4)) * 3
    rows = events.select("event_id", F.when(line % 5 == 0, line + 1).otherwise(line).alias("line"), outcome.alias("outcome"))
    return rows.select(F.col("event_id").alias("decision_id"), "line", "outcome", F.when(F.col("outcome") == "link", F.col("line")).when(F.col("outcome") == "keep", F.col("line")).alias("record"), (F.col("event_id") % 4).alias("revision"))


DECIDED = """
de AS (SELECT event_id, (event_id // 4) * 3 AS l0, CASE event_type WHEN 'error' THEN 'reject' WHEN 'signup' THEN 'keep' WHEN 'click' THEN 'create' ELSE 'link' END AS outcome FROM events),
dr AS (SELECT event_id, CASE WHEN l0 % 5 = 0 THEN l0 + 1 ELSE l0 END AS line, outcome, event_id % 4 AS revision FROM de),
dec AS (SELECT line, outcome, CASE WHEN outcome IN ('link', 'keep') THEN line END AS record, revision FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY revision DESC, event_id DESC) AS rn FROM dr) WHERE rn = 1)
"""
NO_DECISIONS = "dec AS (SELECT 0 AS line, '' AS outcome, 0 AS record, 0 AS revision WHERE false)"


def classified_sql(decisions):
    return f"""
WITH {decisions},
r AS (SELECT o_orderkey AS record, o_orderstatus AS s, o_orderpriority AS p, CAST(o_totalprice AS DECIMAL(18,2)) AS t, CASE o_orderkey % 6 WHEN 0 THEN 'sheet' WHEN 1 THEN '' END AS proof,
  CASE o_orderkey % 9 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS layer, CASE WHEN o_orderkey % 23 = 0 THEN 'disregarded' ELSE 'active' END AS state FROM orders WHERE o_orderkey % 29 <> 0),
l AS (SELECT o_orderkey AS line, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS s, o_orderpriority AS p, CAST(o_totalprice AS DECIMAL(18,2)) AS t,
  CAST(o_totalprice AS DECIMAL(18,2)) + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS amount, CASE WHEN o_orderkey % 12 = 7 THEN NULL ELSE CASE o_orderkey % 6 WHEN 0 THEN 'sheet' WHEN 1 THEN '' END END AS proof,
  CASE WHEN o_orderkey % 29 = 0 THEN 'none' WHEN o_orderkey % 31 = 0 THEN 'multiple' ELSE 'unique' END AS match, CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS u FROM orders WHERE o_orderkey % 5 <> 0),
j AS (SELECT l.*, dec.outcome, CASE WHEN dec.outcome = 'create' THEN NULL ELSE coalesce(dec.record, CASE WHEN match = 'unique' THEN u END) END AS target FROM l LEFT JOIN dec USING (line)),
k AS (SELECT j.line, j.match, j.outcome, j.target, j.amount, r.state, r.layer, coalesce(j.s = r.s AND j.p = r.p AND j.t = r.t AND j.proof IS NOT DISTINCT FROM r.proof AND r.record IS NOT NULL, false) AS same FROM j LEFT JOIN r ON r.record = j.target),
c1 AS (SELECT *, CASE WHEN outcome IN ('reject', 'keep', 'create') THEN NULL WHEN target IS NULL AND match = 'multiple' THEN 'MULTIPLE' WHEN target IS NULL OR state IS NULL THEN 'NO_CANDIDATE'
  WHEN state = 'disregarded' THEN 'DISREGARDED' WHEN layer > 1 AND NOT same AND outcome IS NULL THEN 'PROTECTED_LAYER' END AS conflict FROM k),
c2 AS (SELECT *, CASE outcome WHEN 'reject' THEN 'rejected' WHEN 'keep' THEN 'kept' WHEN 'create' THEN 'created' ELSE CASE WHEN conflict IS NOT NULL THEN 'conflict' WHEN same THEN 'unchanged' ELSE 'updated' END END AS category FROM c1),
d AS (SELECT target FROM c2 WHERE category IN ('unchanged', 'updated', 'kept') AND target IS NOT NULL GROUP BY target HAVING count(*) > 1),
c AS (SELECT line, match, outcome, target, amount, CASE WHEN category IN ('unchanged', 'updated', 'kept') AND target IN (SELECT target FROM d) THEN 'DUPLICATE_TARGET' ELSE conflict END AS conflict,
  CASE WHEN category IN ('unchanged', 'updated', 'kept') AND target IN (SELECT target FROM d) THEN 'conflict' ELSE category END AS category FROM c2)
"""


def classified(spark, sf_dir, decided):
    records, lines, matches = batch(spark, sf_dir)
    decisions = reconcile.resolve_decisions(batch_decisions(spark, sf_dir)) if decided else None
    return records, reconcile.classify(lines, matches, records, decisions)


@query(classified_sql(NO_DECISIONS) + "SELECT line, match, target, conflict, category FROM c")
def reconcile_classify(spark, sf_dir):
    return classified(spark, sf_dir, False)[1].select("line", "match", "target", "conflict", "category")


@query(classified_sql(DECIDED) + "SELECT line, outcome, target, conflict, category FROM c")
def reconcile_decided(spark, sf_dir):
    return classified(spark, sf_dir, True)[1].select("line", "outcome", "target", "conflict", "category")


@query(classified_sql(DECIDED) + """SELECT count(*) FILTER (category = 'unchanged') AS n_unchanged, count(*) FILTER (category = 'updated') AS n_updated, count(*) FILTER (category = 'created') AS n_created, count(*) FILTER (category = 'rejected') AS n_rejected,
count(*) FILTER (category = 'kept') AS n_kept, count(*) FILTER (category = 'conflict') AS n_conflict, count(*) AS n_lines, (SELECT count(*) FROM r WHERE state = 'active' AND record NOT IN (SELECT target FROM c WHERE target IS NOT NULL)) AS n_absent FROM c""")
def reconcile_summary(spark, sf_dir):
    records, lines = classified(spark, sf_dir, True)
    return reconcile.summary(lines, reconcile.absences(records, lines))


@query(classified_sql(NO_DECISIONS) + "SELECT line, target FROM c WHERE conflict = 'DUPLICATE_TARGET'")
def duplicate_target(spark, sf_dir):
    return classified(spark, sf_dir, False)[1].filter("conflict = 'DUPLICATE_TARGET'").select("line", "target")


@query(classified_sql(NO_DECISIONS) + "SELECT record FROM r WHERE state = 'active' AND record NOT IN (SELECT target FROM c WHERE target IS NOT NULL)")
def absences(spark, sf_dir):
    return reconcile.absences(*classified(spark, sf_dir, False))


@query(classified_sql(DECIDED) + """, f AS (SELECT target, amount FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY line) AS rn FROM c WHERE category IN ('unchanged', 'updated')) WHERE rn = 1),
v AS (SELECT coalesce(f.amount, r.t) AS v FROM r LEFT JOIN f ON f.target = r.record WHERE r.state = 'active' UNION ALL SELECT amount FROM c WHERE category = 'created')
SELECT count(*) AS n_sources, count(v) AS n_values, CAST(sum(v) * 100 AS BIGINT) AS cents FROM v""")
def reconcile_metrics(spark, sf_dir):
    records, lines = classified(spark, sf_dir, True)
    _, raw, _ = batch(spark, sf_dir)
    with_amount = lines.drop("amount").join(raw.select("line", "amount"), "line")
    totals = reconcile.metrics(records, with_amount, "amount", "amount")
    return totals.select("n_sources", "n_values", (F.col("total") * 100).cast("long").alias("cents"))


@query(classified_sql(DECIDED) + """SELECT md5('batch-1:' || line || ':source') AS event_id, line, target, 'source' AS type, 1 AS precedence FROM c WHERE category IN ('unchanged', 'updated', 'created', 'kept')
UNION ALL SELECT md5('batch-1:' || line || ':audit'), line, target, 'audit', 3 FROM c WHERE outcome IN ('link', 'keep')""")
def reconcile_events(spark, sf_dir):
    return reconcile.events(classified(spark, sf_dir, True)[1], "batch-1").select("event_id", "line", "target", "type", "precedence")


@query("WITH " + DECIDED + "SELECT line, outcome, record, revision FROM dec")
def decision_resolution(spark, sf_dir):
    return reconcile.resolve_decisions(batch_decisions(spark, sf_dir))


@query(classified_sql(NO_DECISIONS) + """, d0 AS (SELECT (event_id // 4) * 3 AS l0, event_type FROM events), d1 AS (SELECT CASE WHEN l0 % 5 = 0 THEN l0 + 1 ELSE l0 END AS line, CASE event_type WHEN 'error' THEN 'reject' WHEN 'signup' THEN 'keep' WHEN 'click' THEN 'create' ELSE 'link' END AS outcome FROM d0)
SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN c.conflict IS NULL THEN 'not_pending'
 WHEN (c.conflict = 'PROTECTED_LAYER' AND d1.outcome IN ('link', 'keep', 'reject')) OR (c.conflict = 'DISREGARDED' AND d1.outcome = 'reject') OR (c.conflict IN ('NO_CANDIDATE', 'MULTIPLE', 'DUPLICATE_TARGET') AND d1.outcome IN ('link', 'create', 'reject')) THEN 'applied' ELSE 'not_allowed' END AS verdict FROM d1 LEFT JOIN c USING (line)) GROUP BY verdict""")
def decision_verdicts(spark, sf_dir):
    return reconcile.check_decisions(batch_decisions(spark, sf_dir), classified(spark, sf_dir, False)[1]).groupBy("verdict").agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)
SELECT c_custkey, coalesce(event_type, c_mktsegment) AS c_mktsegment, coalesce(event_id, 0) AS revision FROM customer LEFT JOIN c ON user_id = c_custkey AND rn = 1
""")
def delta_materialize(spark, sf_dir):
    root = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    changes = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("c_mktsegment"), F.col("event_id").alias("revision"))
    return reconcile.materialize(root, changes, "c_custkey", ["c_mktsegment"])


@query("""
WITH p AS (SELECT p_partkey, p_brand, p_type, p_size, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN 'gone' ELSE p_brand END AS b2, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS s2 FROM part)
SELECT p_partkey, 'brand' AS field, p_brand AS before, CASE WHEN b2 = 'gone' THEN NULL ELSE b2 END AS after, CASE WHEN b2 = 'gone' THEN 'removed' ELSE 'changed' END AS kind FROM p WHERE b2 IS DISTINCT FROM p_brand
UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR), CAST(s2 AS VARCHAR), 'changed' FROM p WHERE s2 <> p_size
UNION ALL SELECT p_partkey, 'note', NULL, p_type, 'added' FROM p WHERE p_partkey % 5 = 0
""")
def field_diffs(spark, sf_dir):
    part = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_size")
    size = F.col("p_size").cast("string")
    k = F.col("p_partkey")
    before = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), size)
    grown = F.when(k % 7 == 0, (F.col("p_size") + 1).cast("string")).otherwise(size)
    brand = F.when(k % 4 == 0, F.create_map(F.lit("brand"), F.lit(None).cast("string"))).when(k % 4 == 1, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("brand"), F.col("p_brand")))
    note = F.when(k % 5 == 0, F.create_map(F.lit("note"), F.col("p_type"))).otherwise(F.create_map().cast("map<string,string>"))
    after = F.map_concat(brand, F.create_map(F.lit("size"), grown), note)
    return reconcile.field_diffs(part.select("p_partkey", before.alias("b"), after.alias("a")), "p_partkey", "b", "a")


@query("""
WITH g AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, min(c_custkey) AS lo FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1, 2),
l AS (SELECT c_custkey AS line, c_nationkey, CASE WHEN c_custkey % 19 = 0 THEN ' ' ELSE c_mktsegment END AS c_mktsegment FROM customer)
SELECT line, CASE WHEN coalesce(n, 0) = 0 THEN 'none' WHEN n = 1 THEN 'unique' ELSE 'multiple' END AS match, coalesce(n, 0) AS n_candidates, CASE WHEN n = 1 THEN lo END AS record FROM l LEFT JOIN g USING (c_nationkey, c_mktsegment)
""")
def identity_match(spark, sf_dir):
    customer = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    lines = customer.select(F.col("c_custkey").alias("line"), "c_nationkey", F.when(F.col("c_custkey") % 19 == 0, " ").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    found = matching.identity_match(lines, customer.filter("c_custkey % 3 = 0"), "line", "c_custkey", ["c_nationkey", "c_mktsegment"])
    return found.select("line", "match", "n_candidates", "record")


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n, min(c_custkey) AS first_id, max(c_custkey) AS last_id FROM customer GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return matching.duplicated(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey")


@query("""
WITH d AS (SELECT event_id, user_id AS observation, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'L' || event_id % 4 END AS locator, event_type AS outcome, event_id % 5 AS revision FROM events),
x AS (SELECT *, row_number() OVER (PARTITION BY observation, locator ORDER BY revision DESC, event_id DESC) AS rn, row_number() OVER (PARTITION BY observation ORDER BY revision DESC, event_id DESC) AS rw FROM d),
l AS (SELECT o_orderkey AS line, o_custkey AS observation, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'L' || o_orderkey % 6 END AS locator FROM orders)
SELECT line, coalesce(e.outcome, w.outcome) AS outcome, CASE WHEN e.event_id IS NOT NULL THEN e.event_id ELSE w.event_id END AS record, coalesce(e.revision, w.revision) AS revision, CASE WHEN e.event_id IS NOT NULL THEN 'locator' ELSE 'observation' END AS by
FROM l LEFT JOIN x e ON e.observation = l.observation AND e.locator = l.locator AND e.rn = 1 LEFT JOIN x w ON w.observation = l.observation AND w.rw = 1 WHERE w.event_id IS NOT NULL
""")
def decision_fallback(spark, sf_dir):
    """Decisions by observation and locator, else by observation."""
    events, orders = table(spark, sf_dir, "events", "event_id", "user_id", "event_type"), table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    e, k = F.col("event_id"), F.col("o_orderkey")
    locator = F.when(e % 3 != 0, F.concat(F.lit("L"), (e % 4).cast("string")))
    decisions = events.select(F.col("user_id").alias("observation"), locator.alias("locator"), F.col("event_type").alias("outcome"), e.alias("record"), (e % 5).alias("revision"), e.alias("decision_id"))
    lines = orders.select(k.alias("line"), F.col("o_custkey").alias("observation"), F.when(k % 5 != 0, F.concat(F.lit("L"), (k % 6).cast("string"))).alias("locator"))
    return reconcile.decisions_for(lines, decisions)


@query("""
WITH p AS (SELECT p_partkey AS k, p_brand AS b, CASE WHEN p_partkey % 3 = 0 THEN p_brand || '!' ELSE p_brand END AS b2, CAST(p_size AS VARCHAR) AS s FROM part),
d AS (
  SELECT k, 'brand' AS field, b AS before, b2 AS after, 'changed' AS kind, 'payload' AS source, 0 AS r FROM p WHERE b <> b2
  UNION ALL SELECT k, 'brand', s, s || '.0', 'changed', 'decimal-source', 1 FROM p WHERE k % 4 = 0
  UNION ALL SELECT k, 'size', s, NULL, 'removed', 'decimal-source', 1 FROM p WHERE k % 4 = 1
  UNION ALL SELECT k, '*', NULL, NULL, 'whole', 'duration-source', 2 FROM p WHERE k % 5 = 0
  UNION ALL SELECT k, 'time', NULL, s, 'added', 'duration-source', 2 FROM p WHERE k % 5 = 1
)
SELECT k, row_number() OVER (PARTITION BY k ORDER BY field, r) AS place, field, before, after, kind, source FROM d
""")
def typed_field_diffs(spark, sf_dir):
    """Differences of payloads and of both kinds of provenance, in their order."""
    k, b, size = F.col("p_partkey"), F.col("p_brand"), F.col("p_size").cast("string")
    none, one = F.create_map().cast("map<string,string>"), lambda name, v: F.create_map(F.lit(name), v)
    pairs = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size").select(
        k.alias("k"), one("brand", b).alias("p0"), one("brand", F.when(k % 3 == 0, F.concat(b, F.lit("!"))).otherwise(b)).alias("p1"),
        F.when(k % 4 == 0, one("brand", size)).when(k % 4 == 1, one("size", size)).otherwise(none).alias("d0"), F.when(k % 4 == 0, one("brand", F.concat(size, F.lit(".0")))).otherwise(none).alias("d1"),
        F.when(k % 5 != 0, none).alias("t0"), F.when(k % 5 == 1, one("time", size)).otherwise(none).alias("t1"),
    )
    return reconcile.typed_diffs(pairs, "k", {"payload": ("p0", "p1"), "decimal-source": ("d0", "d1"), "duration-source": ("t0", "t1")})


@query("""
WITH t AS (SELECT l_orderkey AS k, CASE l_linenumber % 4 WHEN 0 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) WHEN 1 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ':05' WHEN 2 THEN '1:00:' || lpad(CAST(CAST(l_quantity AS INTEGER) % 60 AS VARCHAR), 2, '0') ELSE 'x' END AS v,
  CASE WHEN l_linenumber % 3 = 0 THEN 'minutes' ELSE 'clock' END AS u, CAST(l_quantity AS INTEGER) AS q, l_linenumber % 4 AS n FROM lineitem),
s AS (SELECT k, CASE WHEN n = 0 THEN q * 60 WHEN u = 'minutes' THEN NULL WHEN n = 1 THEN q * 60 + 5 WHEN n = 2 THEN 3600 + q % 60 END AS seconds FROM t)
SELECT k, CAST(sum(seconds) AS BIGINT) AS seconds, count(seconds) AS n, count(*) FILTER (seconds IS NULL) AS n_invalid FROM s GROUP BY k
""")
def duration_sums(spark, sf_dir):
    """Exact sums of durations by unit."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    text = F.when(n % 4 == 0, q.cast("string")).when(n % 4 == 1, F.concat(q.cast("string"), F.lit(":05"))).when(n % 4 == 2, F.concat(F.lit("1:00:"), F.lpad((q % 60).cast("string"), 2, "0"))).otherwise("x")
    rows = lines.select(F.col("l_orderkey").alias("k"), text.alias("v"), F.when(n % 3 == 0, "minutes").otherwise("clock").alias("u"))
    return report.duration_sum(rows, "k", "v", "u")


REVISIONS = 1000


def revised(spark, sf_dir):
    """The batch's decisions spread over a thousand revisions."""
    return batch_decisions(spark, sf_dir).withColumn("revision", 1 + F.col("decision_id") % REVISIONS)


@query()
def decision_fold(spark, sf_dir):
    """Lines after a thousand revisions of decisions (each depends on those before: no SQL)."""
    records, lines, matches = batch(spark, sf_dir)
    return reconcile.fold_decisions(lines, revised(spark, sf_dir), records, matches, REVISIONS).select("line", "outcome", "target", "conflict", "category", "decided_at")


@query()
def decision_fold_hot(spark, sf_dir):
    """The same thousand revisions where every decision reaches for one of a hundred records: one part holds them all (no SQL)."""
    records, lines, matches = batch(spark, sf_dir)
    shared = F.when(F.col("outcome") == "link", 2 + 3 * (F.col("decision_id") % 100)).otherwise(F.col("record"))
    decisions = revised(spark, sf_dir).withColumn("record", shared)
    return reconcile.fold_decisions(lines, decisions, records, matches, REVISIONS).select("line", "outcome", "target", "conflict", "category", "decided_at")


@query("SELECT coalesce(a.line, b.line) AS line, a.category AS from_category, b.category AS to_category, a.target AS from_target, b.target AS to_target FROM (" + classified_sql(NO_DECISIONS) + "SELECT line, target, category FROM c) a FULL JOIN (" + classified_sql(DECIDED)
       + "SELECT line, target, category FROM c) b ON a.line = b.line WHERE a.category IS DISTINCT FROM b.category OR a.target IS DISTINCT FROM b.target")
def decision_deltas(spark, sf_dir):
    """What all decisions change in category and target."""
    return reconcile.decision_delta(classified(spark, sf_dir, False)[1], classified(spark, sf_dir, True)[1])


@query(classified_sql(DECIDED) + """SELECT 'nothing_waits' AS gate, count(*) FILTER (category = 'conflict') = 0 AS holds FROM c
UNION ALL SELECT 'unique_targets', count(*) = 0 FROM (SELECT target FROM c WHERE category IN ('unchanged', 'updated', 'kept') AND target IS NOT NULL GROUP BY target HAVING count(*) > 1) UNION ALL SELECT 'base_version', false""")
def gate_report(spark, sf_dir):
    """Which gates hold before the batch is applied on a base that has moved on."""
    return reconcile.apply_gates(classified(spark, sf_dir, True)[1], 4, 5)


@query(classified_sql(DECIDED) + """, e AS (SELECT md5('batch-1:' || line || ':source') AS event_id, line FROM c WHERE category IN ('unchanged', 'updated', 'created', 'kept') UNION ALL SELECT md5('batch-1:' || line || ':audit'), line FROM c WHERE outcome IN ('link', 'keep'))
SELECT event_id, line FROM e WHERE line % 3 <> 0""")
def ledger_append(spark, sf_dir):
    """Events that a replayed batch still has to append: a third is in the ledger, and the batch came twice."""
    made = reconcile.events(classified(spark, sf_dir, True)[1], "batch-1")
    return reconcile.append_events(made.filter("line % 3 = 0"), made.unionByName(made)).select("event_id", "line")


def user_versions(spark, sf_dir):
    """Users as lines: their last event of each day (a revision) gives category and target; all are idle at revision 0."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type").withColumn("revision", F.datediff(F.to_date("ts"), F.lit("2023-12-31").cast("date")))
    last = F.max_by(F.struct(F.col("event_type").alias("category"), (F.col("event_id") % 40).alias("target")), "event_id").alias("_l")
    days = e.filter("user_id IS NOT NULL AND revision > 0").groupBy("revision", F.col("user_id").alias("line")).agg(last).select("revision", "line", "_l.category", "_l.target")
    idle = e.filter("user_id IS NOT NULL").select(F.lit(0).alias("revision"), F.col("user_id").alias("line"), F.lit("idle").alias("category"), F.lit(None).cast("long").alias("target")).distinct()
    return idle.unionByName(days)


VERSIONS = """WITH RECURSIVE e AS (SELECT event_id, user_id AS line, event_type, CAST(date_diff('day', DATE '2023-12-31', CAST(ts AS DATE)) AS BIGINT) AS revision FROM events WHERE user_id IS NOT NULL),
v AS (SELECT DISTINCT CAST(0 AS BIGINT) AS revision, line, 'idle' AS category, CAST(NULL AS BIGINT) AS target FROM e UNION ALL SELECT revision, line, arg_max(event_type, event_id), arg_max(event_id % 40, event_id) FROM e WHERE revision > 0 GROUP BY revision, line),
w AS (SELECT *, lag(category) OVER o AS fc, lag(target) OVER o AS ft, lag(revision) OVER o AS fr FROM v WINDOW o AS (PARTITION BY line ORDER BY revision)),
d AS (SELECT revision, line, fc, ft, category AS tc, target AS tt FROM w WHERE fr IS NOT NULL AND (fc IS DISTINCT FROM category OR ft IS DISTINCT FROM target)),
b AS (SELECT record, revision, sum(x) AS delta FROM (SELECT 0 AS revision, target AS record, 1 AS x FROM v WHERE revision = 0 UNION ALL SELECT revision, ft, -1 FROM d UNION ALL SELECT revision, tt, 1 FROM d) WHERE record IS NOT NULL GROUP BY record, revision HAVING sum(x) <> 0 OR revision = 0),
n AS (SELECT *, sum(delta) OVER (PARTITION BY record ORDER BY revision) AS n FROM b)
"""


@query(VERSIONS + "SELECT revision, line, fc AS from_category, tc AS to_category, ft AS from_target, tt AS to_target FROM d")
def revision_deltas(spark, sf_dir):
    """Lines that each revision changes."""
    return chain.line_deltas(user_versions(spark, sf_dir), ["category", "target"])


@query(VERSIONS + """, s AS (SELECT record, revision, n, lead(revision) OVER o AS nx, lag(revision) OVER o AS pr FROM n WINDOW o AS (PARTITION BY record ORDER BY revision))
SELECT record, CAST(valid_from AS INTEGER) AS valid_from, CAST(valid_to AS INTEGER) AS valid_to FROM (SELECT record, revision AS valid_from, nx AS valid_to FROM s WHERE n = 0 UNION ALL SELECT record, 0, revision FROM s WHERE pr IS NULL AND revision > 0
UNION ALL SELECT s_suppkey, 0, NULL FROM supplier WHERE s_suppkey NOT IN (SELECT record FROM n)) WHERE record IN (SELECT s_suppkey FROM supplier)""")
def absence_spans(spark, sf_dir):
    """From which revision to which no line is on a supplier."""
    versions = user_versions(spark, sf_dir)
    buckets = chain.bucket_deltas(chain.line_deltas(versions, ["category", "target"]), versions.filter("revision = 0"))
    return chain.absence_spans(buckets, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("record")))


@query(VERSIONS + """, m AS (SELECT revision, metric, sum(x) AS x FROM (SELECT revision, fc AS metric, -1 AS x FROM d WHERE fc IS DISTINCT FROM tc UNION ALL SELECT revision, tc, 1 FROM d WHERE fc IS DISTINCT FROM tc) GROUP BY 1, 2 HAVING sum(x) <> 0),
t AS (SELECT * FROM m UNION ALL SELECT 0, category, count(*) FROM v WHERE revision = 0 GROUP BY category)
SELECT revision, metric, CAST(sum(x) OVER (PARTITION BY metric ORDER BY revision) AS BIGINT) AS n FROM t""")
def metric_history(spark, sf_dir):
    """Numbers of lines by category after each revision, from the changes alone."""
    versions = user_versions(spark, sf_dir)
    base = versions.filter("revision = 0").groupBy(F.col("category").alias("metric")).agg(F.count("*").alias("n"))
    return chain.totals_at(chain.metric_deltas(chain.line_deltas(versions, ["category", "target"])), base)


def part(column):
    return f"coalesce(length(CAST({column} AS VARCHAR)) || ':' || {column}, '-')"


@query(VERSIONS + f""", h AS (SELECT revision, line, sha256({' || '.join(part(c) for c in ('line', 'fc', 'ft', 'tc', 'tt'))}) AS h FROM d),
g AS (SELECT revision, line // 4096 AS r, count(*) AS n, sha256(string_agg(h, '' ORDER BY line)) AS h FROM h GROUP BY 1, 2),
k AS (SELECT revision, sum(n) AS n, sha256(string_agg(h, '' ORDER BY r)) AS hash, revision // 1024 AS r FROM g GROUP BY revision),
u AS (SELECT *, sha256(string_agg(hash, '') OVER (PARTITION BY r ORDER BY revision)) AS run FROM k),
o AS (SELECT r, arg_max(run, revision) AS run, row_number() OVER (ORDER BY r) AS i FROM u GROUP BY r),
c AS (SELECT i, r, 'root' AS before, sha256('root' || run) AS chain FROM o WHERE i = 1 UNION ALL SELECT o.i, o.r, c.chain, sha256(c.chain || o.run) FROM c JOIN o ON o.i = c.i + 1)
SELECT u.revision, CAST(u.n AS BIGINT) AS n, u.hash, sha256(c.before || u.run) AS chain FROM u JOIN c USING (r)""")
def revision_chain(spark, sf_dir):
    """Hashes of the revisions and their chain."""
    deltas = chain.line_deltas(user_versions(spark, sf_dir), ["category", "target"])
    return chain.chained(chain.revision_hashes(deltas, ["from_category", "from_target", "to_category", "to_target"]), "root")


@query(classified_sql(NO_DECISIONS) + """SELECT md5('batch:' || line || ':source') AS event_id, line, CASE WHEN line % 2 = 0 THEN 1 ELSE 2 END AS version FROM c WHERE category <> 'conflict' AND category <> 'rejected'""")
def applied_batches(spark, sf_dir):
    """Events of a ledger by the version that added them: two batches, the first sent again on a base that has moved on, the second with events of the first."""
    lines = written(classified(spark, sf_dir, False)[1].filter("category != 'conflict'"), "classified")
    made, root = reconcile.events(lines, "batch"), f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    even, odd = lines.filter("line % 2 = 0"), lines.filter("line % 2 = 1")
    first = commits.apply(root, "even", 0, even, made.filter("line % 2 = 0"))
    again = commits.apply(root, "even", 5, even, made.filter("line % 2 = 0"))
    commits.apply(root, "odd", first.version, odd, made)
    if not again.reused or again.content != first.content:
        raise AssertionError("a request that was sent again got another answer")
    return commits.read_events(spark, root).select("event_id", "line", "version")


def submitted(spark, sf_dir):
    """Orders as lines that match records by customer and date, classified; with what was submitted, some of it wrong by line."""
    records, lines, _ = batch(spark, sf_dir, {"customer": F.col("o_custkey"), "day": F.to_date("o_orderdate").cast("string")})
    # Each is read many times on the way to the differences, so each is computed once. All grow with the batch; by the sizes
    # of their files Spark would broadcast them long after they have outgrown the driver, so they are merged.
    once = lambda df, name: written(df, name).hint("merge")
    records, lines = once(records.drop("amount"), "records"), once(lines.drop("amount"), "lines")
    decisions = batch_decisions(spark, sf_dir)
    matches = once(matching.identity_match(lines, records, "line", "record", ["customer", "day"]).select("line", "match", "n_candidates", "record"), "matches")
    found = reconcile.classify(lines.select("line", "payload", "provenance"), matches.select("line", "match", "record"), records, reconcile.resolve_decisions(decisions).hint("merge"))
    found = once(found.select("line", "match", "target", "conflict", "category"), "classified")
    ids = F.md5(F.concat(F.lit("batch:"), F.col("line").cast("string")))
    whole = found.join(matches.select("line", "n_candidates"), "line").withColumn("observation", ids).select("line", "observation", "match", "n_candidates", "target", "conflict", "category")
    held = records.select(F.col("record").alias("target"), F.col("payload").alias("before"), F.lit(True).alias("_there"))
    pairs = found.filter("target IS NOT NULL").select("line", "target").join(lines.select("line", F.col("payload").alias("after")), "line").join(held, "target")
    diffs = reconcile.field_diffs(pairs, "line", "before", "after").filter("field != '*'")
    absent = written(reconcile.absences(records, found), "absences")
    return (lines, records, decisions), (whole, diffs, absent, reconcile.summary(found, absent))


@query("SELECT 'none' AS kind, '' AS key WHERE false UNION ALL SELECT 'ids', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 997 = 3")
def rederivation(spark, sf_dir):
    """What a second derivation of the whole batch finds: only the ids that were planted."""
    evidence, (whole, diffs, absent, summary) = submitted(spark, sf_dir)
    planted = F.when(F.col("line") % 997 == 3, F.lit("other")).otherwise(F.col("observation"))
    derived = rederive.derive(*evidence, ["customer", "day"], "batch")
    return rederive.differences(derived, whole.withColumn("observation", planted), diffs, absent, summary).select("kind", "key")


@query("""
WITH m AS (
 SELECT 0 AS revision, md5(CAST(o_orderkey AS VARCHAR)) AS key, o_orderstatus AS content FROM orders WHERE o_orderkey % 3 = 0
 UNION ALL SELECT 1, md5(CAST(o_orderkey AS VARCHAR)), o_orderstatus FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 30 <> 0 OR o_orderkey % 3 = 1 AND o_orderkey % 50 = 1
 UNION ALL SELECT 2, md5(CAST(o_orderkey AS VARCHAR)), CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END FROM orders
  WHERE o_orderkey % 3 = 0 AND (o_orderkey % 30 <> 0 OR o_orderkey % 9 = 0) OR o_orderkey % 3 = 1 AND o_orderkey % 50 = 1),
a AS (SELECT revision, min(key) AS after FROM m WHERE key >= '8' GROUP BY revision),
n AS (SELECT revision, count(*) AS n FROM m GROUP BY revision),
p AS (SELECT revision, key, content, row_number() OVER (PARTITION BY revision ORDER BY key) AS place, count(*) OVER (PARTITION BY revision) AS rest FROM m JOIN a USING (revision) WHERE key > after)
SELECT revision, n, CAST(place AS INTEGER) AS place, key, sha256('leaf:' || key || ':' || content) AS leaf, rest > 100 AS has_more FROM p JOIN n USING (revision) WHERE place <= 100
""")
def member_pages(spark, sf_dir):
    """A page of a hundred members under each of three revisions of a set of orders, read from its tree and held against the revision's root."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    batches = [
        orders.filter(k % 3 == 0).select(k, status.alias("content")),
        orders.filter((k % 30 == 0) | (k % 3 == 1) & (k % 50 == 1)).select(k, F.when(k % 30 != 0, status).alias("content")),
        orders.filter(k % 9 == 0).select(k, F.lit("X").alias("content")),
    ]
    nodes, out = None, []
    for revision, batch in enumerate(batches):
        changes = batch.select(F.md5(k.cast("string")).alias("key"), "content")
        added = keytree.revised(nodes, changes, "key", "content", revision)
        nodes = added if nodes is None else nodes.unionByName(added)
    # Of each node only the first such member goes to its latest revision.
    firsts = nodes.select("revision", "prefix", "hash", F.array_min(F.transform(F.filter("children", lambda c: (c["n"] == 1) & (c["prefix"] >= "8")), lambda c: c["prefix"])).alias("first"))
    for revision in range(len(batches)):
        top = keytree.root(nodes, revision).first()
        # The first member from the middle on: what a page after none would begin with there.
        middle = keytree.at_revision(firsts, revision).agg(F.min("first")).first()[0]
        found = keytree.page(nodes, top["hash"], middle, 100, revision)
        out += [(revision, top["n"], i + 1, key, leaf, found.more) for i, (key, leaf) in enumerate(found.members)]
    return spark.createDataFrame(out, "revision int, n long, place int, key string, leaf string, has_more boolean")  # a page a revision
