"""Loads of a base of rows: parts, orders and customers stand for the current base and the incoming one."""

from pyspark.sql import functions as F

from tessera.operators import load
from tessera.plans.registry import query, table


def bases(spark, sf_dir):
    """Parts as the current base (some missing) and as the incoming one (some changed, some missing)."""
    part = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_size")
    k = F.col("p_partkey")
    current = part.filter(k % 10 != 0).select(k.alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.when(k % 7 == 0, None).otherwise(F.col("p_size").cast("string")).alias("size"))
    size = F.when(k % 7 == 0, F.lit("")).when(k % 6 == 0, (F.col("p_size") + 1).cast("string")).otherwise(F.col("p_size").cast("string"))
    incoming = part.filter(k % 9 != 0).select(k.alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), size.alias("size"))
    return current, incoming


FIELDS = ["name", "brand", "size"]
BASES = """
WITH cur AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS size FROM part WHERE p_partkey % 10 <> 0),
inc AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 6 = 0 THEN CAST(p_size + 1 AS VARCHAR) ELSE CAST(p_size AS VARCHAR) END AS size FROM part WHERE p_partkey % 9 <> 0),
cmp AS (SELECT coalesce(c.id, i.id) AS id, CASE WHEN c.id IS NULL THEN 'added' WHEN i.id IS NULL THEN 'absent' WHEN coalesce(c.size, '') <> coalesce(i.size, '') THEN 'changed' ELSE 'unchanged' END AS change FROM cur c FULL JOIN inc i USING (id)),
dec AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'keep' ELSE 'incoming' END AS decision FROM cmp WHERE change IN ('changed', 'absent') AND id % 25 <> 0 UNION ALL SELECT 1, 'keep')
"""


def decisions(compared):
    made = compared.filter(F.col("change").isin("changed", "absent") & (F.col("id") % 25 != 0)).select("id", F.when(F.col("id") % 4 == 0, "keep").otherwise("incoming").alias("decision"))
    return made.unionByName(compared.sparkSession.range(1).select(F.lit(1).cast(made.schema["id"].dataType).alias("id"), F.lit("keep").alias("decision")))


@query(BASES + "SELECT id, change FROM cmp")
def load_compare(spark, sf_dir):
    return load.compare(*bases(spark, sf_dir), "id", FIELDS)


@query(BASES + "SELECT count(*) FILTER (change = 'added') AS n_added, count(*) FILTER (change = 'changed') AS n_changed, count(*) FILTER (change = 'unchanged') AS n_unchanged, count(*) FILTER (change = 'absent') AS n_absent FROM cmp")
def merge_counts(spark, sf_dir):
    return load.compare_counts(load.compare(*bases(spark, sf_dir), "id", FIELDS))


@query(BASES + """SELECT id, 'missing' AS issue FROM cmp WHERE change IN ('changed', 'absent') AND id NOT IN (SELECT id FROM dec)
UNION ALL SELECT id, 'extra' FROM dec WHERE id NOT IN (SELECT id FROM cmp WHERE change IN ('changed', 'absent'))""")
def undecided(spark, sf_dir):
    compared = load.compare(*bases(spark, sf_dir), "id", FIELDS)
    return load.undecided(compared, decisions(compared), "id")


@query(BASES + """SELECT id, name, brand, size FROM inc WHERE id NOT IN (SELECT cur.id FROM cur JOIN dec USING (id) WHERE decision = 'keep')
UNION ALL SELECT id, name, brand, size FROM cur WHERE id IN (SELECT id FROM dec WHERE decision = 'keep')""")
def three_way_merge(spark, sf_dir):
    current, incoming = bases(spark, sf_dir)
    return load.merge(current, incoming, decisions(load.compare(current, incoming, "id", FIELDS)), "id")


@query(BASES + "SELECT id, name, brand, size FROM inc UNION ALL SELECT id, name, brand, size FROM cur WHERE id NOT IN (SELECT id FROM inc)")
def complement_load(spark, sf_dir):
    return load.complement(*bases(spark, sf_dir), "id")


@query(BASES + """SELECT id, brand, CAST(NULL AS VARCHAR) AS issue FROM cur WHERE brand NOT IN ('Brand#11', 'Brand#7')
UNION ALL SELECT id, brand, CASE WHEN brand NOT IN ('Brand#11', 'Brand#7') THEN 'foreign' WHEN id IN (SELECT id FROM cur WHERE brand NOT IN ('Brand#11', 'Brand#7')) THEN 'collision' END FROM (
  SELECT id, CASE WHEN id % 14 = 0 THEN 'Brand#11' ELSE brand END AS brand FROM inc) WHERE brand IN ('Brand#11', 'Brand#7', 'Brand#4')""")
def merge_scope(spark, sf_dir):
    """A load of two brands: rows of a third are foreign, ids that other brands own collide."""
    current, incoming = bases(spark, sf_dir)
    moved = incoming.withColumn("brand", F.when(F.col("id") % 14 == 0, "Brand#11").otherwise(F.col("brand"))).filter(F.col("brand").isin("Brand#11", "Brand#7", "Brand#4"))
    return load.merge_scope(current, moved, "id", "brand", ["Brand#11", "Brand#7"]).select("id", "brand", "issue")


@query("""
WITH known AS (SELECT p_type AS title, bool_or(p_size % 5 = 0) AS archived FROM part WHERE p_partkey % 3 = 0 GROUP BY 1),
bef AS (SELECT DISTINCT p_type AS title FROM part WHERE p_partkey % 6 = 0), now AS (SELECT DISTINCT p_type AS title FROM part WHERE p_partkey % 11 = 1),
x AS (SELECT coalesce(k.title, n.title) AS title, archived, n.title IS NOT NULL AS here, b.title IS NOT NULL AS was FROM known k FULL JOIN now n ON n.title = k.title LEFT JOIN bef b ON b.title = coalesce(k.title, n.title)),
a AS (SELECT title, CASE WHEN archived IS NULL THEN 'create' WHEN archived AND here THEN 'restore' WHEN NOT here AND was AND NOT archived THEN 'archive' END AS action FROM x)
SELECT title, action FROM a WHERE action IS NOT NULL
""")
def project_plan(spark, sf_dir):
    part = table(spark, sf_dir, "part", "p_partkey", "p_type", "p_size")
    known = part.filter("p_partkey % 3 = 0").groupBy(F.col("p_type").alias("title")).agg(F.bool_or(F.col("p_size") % 5 == 0).alias("archived"))
    pick = lambda where: part.filter(where).select(F.col("p_type").alias("title"))
    return load.lifecycle_plan(known, pick("p_partkey % 6 = 0"), pick("p_partkey % 11 = 1"), "title", overwrite=True)


@query("""
WITH cur AS (SELECT o_orderkey AS id, o_custkey AS owner, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_orderstatus AS s FROM orders WHERE o_orderkey % 8 <> 0),
inc AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 21 = 0 THEN o_custkey + 1 ELSE o_custkey END AS owner, CAST(o_totalprice AS DECIMAL(18,2)) + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS amount, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 9 <> 0)
SELECT coalesce(c.id, i.id) AS id, CASE WHEN c.id IS NULL THEN 'added' WHEN i.id IS NULL THEN 'legacy' WHEN c.owner <> i.owner THEN 'moved' WHEN c.amount = i.amount AND c.s = i.s THEN 'unchanged' WHEN c.id IN (SELECT user_id FROM events) THEN 'adjusted' ELSE 'updated' END AS action FROM cur c FULL JOIN inc i USING (id)
""")
def activity_plan(spark, sf_dir):
    """Amounts written with more zeros are the same amounts; rows under an adjustment are told apart."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    k, amount = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    current = orders.filter(k % 8 != 0).select(k.alias("id"), F.col("o_custkey").alias("owner"), amount.cast("string").alias("amount"), F.col("o_orderstatus").alias("s"))
    grown = (amount + F.when(k % 5 == 0, 1).otherwise(0).cast("decimal(18,2)")).cast("decimal(24,4)").cast("string")
    incoming = orders.filter(k % 9 != 0).select(k.alias("id"), F.when(k % 21 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("owner"), grown.alias("amount"), F.when(k % 13 == 0, "X").otherwise(F.col("o_orderstatus")).alias("s"))
    adjusted = table(spark, sf_dir, "events", "user_id").select(F.col("user_id").alias("id"))
    return load.activity_plan(current, incoming, adjusted, "id", "owner", "amount", ["s"])


@query("""
WITH n AS (SELECT o_orderkey AS note_id, CAST(year(o_orderdate) AS INTEGER) AS y, o_orderkey % 400 AS num, o_orderstatus AS s FROM orders),
known AS (SELECT note_id, y, num, s FROM n WHERE note_id % 5 <> 0 UNION ALL SELECT note_id, y, num, 'E' FROM n WHERE note_id % 15 = 1),
inc AS (SELECT note_id, y, num, CASE WHEN note_id % 15 = 1 THEN 'E' WHEN note_id % 7 = 0 THEN 'Z' ELSE s END AS s FROM n WHERE note_id % 3 <> 0 OR note_id % 2 = 1),
b AS (SELECT y, num, min(note_id) AS lo, max(note_id) AS hi FROM known GROUP BY 1, 2)
SELECT note_id, CASE WHEN EXISTS (SELECT 1 FROM known k WHERE k.note_id = inc.note_id AND k.s = inc.s) THEN 'existing' WHEN inc.note_id IN (SELECT note_id FROM known) OR coalesce(lo <> note_id OR hi <> note_id, false) THEN 'conflict' ELSE 'new' END AS status FROM inc LEFT JOIN b USING (y, num)
""")
def note_import_compare(spark, sf_dir):
    """Incoming notes against the source and the effective versions of known ones."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_orderstatus")
    k = F.col("o_orderkey")
    n = orders.select(k.alias("note_id"), F.year("o_orderdate").alias("year"), (k % 400).cast("string").alias("number_key"), F.col("o_orderstatus").alias("s"))
    known = n.filter("note_id % 5 != 0").unionByName(n.filter("note_id % 15 = 1").withColumn("s", F.lit("E")))
    incoming = n.filter("note_id % 3 != 0 OR note_id % 2 = 1").withColumn("s", F.when(F.col("note_id") % 15 == 1, "E").when(F.col("note_id") % 7 == 0, "Z").otherwise(F.col("s")))
    return load.compare_notes(known, incoming, ["s"])


@query("""
WITH r AS (SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 31 = 0 THEN '  ' WHEN o_orderkey % 17 = 0 THEN CAST(o_orderkey - 1 AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) END AS id FROM orders),
f AS (SELECT id, min(pos) AS first, count(*) AS n FROM r WHERE trim(id) <> '' GROUP BY 1 HAVING count(*) > 1)
SELECT pos, concat_ws(',', CASE WHEN trim(id) = '' THEN 'required:id' END, CASE WHEN pos % 23 = 0 THEN 'required:project' END, CASE WHEN pos % 19 = 0 THEN 'formula' END, CASE WHEN first IS NOT NULL AND pos > first THEN 'repeated_id' END,
 CASE WHEN pos % 13 = 0 THEN 'date:day' END, CASE WHEN pos % 19 = 0 OR pos % 11 = 0 THEN 'decimal:amount' END, CASE WHEN pos % 23 <> 0 AND pos % 29 = 0 THEN 'too_long:project' END) AS errors FROM r LEFT JOIN f USING (id)
""")
def row_validation(spark, sf_dir):
    """Orders as rows of text with errors of each kind; of rows with one id the first is right."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_totalprice")
    k = F.col("o_orderkey")
    ident = F.when(k % 31 == 0, "  ").when(k % 17 == 0, (k - 1).cast("string")).otherwise(k.cast("string"))
    project = F.when(k % 23 == 0, "").when(k % 29 == 0, F.repeat(F.lit("p"), 121)).otherwise("Projeto")
    day = F.when(k % 13 == 0, "31/02/2024").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    amount = F.when(k % 19 == 0, "=A1+1").when(k % 11 == 0, "1,2,3").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    rows = orders.select(k.alias("pos"), ident.alias("id"), project.alias("project"), day.alias("day"), amount.alias("amount"))
    checked = load.validate(rows, "id", "pos", required=("id", "project"), dates=("day",), amounts=("amount",), lengths={"project": 120})
    return checked.select("pos", F.array_join("errors", ",").alias("errors"))


@query("""
SELECT p_partkey, 'ATV-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS code FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_brand, p_partkey) AS n FROM part)
""")
def public_codes(spark, sf_dir):
    """Codes by a total order, numbered without one task that sorts all rows."""
    return load.ordered_ids(table(spark, sf_dir, "part", "p_partkey", "p_brand"), ["p_brand", "p_partkey"], "ATV").select("p_partkey", "code")
