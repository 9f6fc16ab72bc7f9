"""Column functions over whole tables: money, durations, dates, keys, redaction, hashes."""

from pyspark.sql import functions as F

from tessera.functions import labels, money, texts, times
from tessera.operators import load, report
from tessera.plans.registry import query, table

PRICE = "CAST(l_extendedprice AS DECIMAL(18,2))"


@query(f"""
WITH t AS (SELECT l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN CAST(CAST(round({PRICE}, 0) AS BIGINT) AS VARCHAR) WHEN l_orderkey % 17 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN CAST(CAST({PRICE} AS DECIMAL(18,1)) AS VARCHAR) ELSE CAST({PRICE} AS VARCHAR) END AS v FROM lineitem),
s AS (SELECT l_linenumber, sum(CAST(v AS DECIMAL(30,4))) AS s, max(CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_linenumber % 3 END) AS scale, count(v) AS n FROM t GROUP BY 1)
SELECT l_linenumber, CASE scale WHEN 0 THEN CAST(CAST(s AS DECIMAL(38,0)) AS VARCHAR) WHEN 1 THEN CAST(CAST(s AS DECIMAL(38,1)) AS VARCHAR) ELSE CAST(CAST(s AS DECIMAL(38,2)) AS VARCHAR) END AS total, CAST(scale AS INTEGER) AS scale, n FROM s
""")
def exact_decimal_sum(spark, sf_dir):
    """Decimal texts of mixed scales add up at the largest scale of their group."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    price, n = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_linenumber") % 3
    text = F.when(n == 0, F.round(price, 0).cast("long").cast("string")).when(F.col("l_orderkey") % 17 == 0, None).when(n == 1, F.round(price, 1).cast("decimal(18,1)").cast("string")).otherwise(price.cast("string"))
    return report.sheet_sum(lines.select("l_linenumber", text.alias("v")), "l_linenumber", "v")


@query(f"""
WITH a AS (SELECT l_returnflag, {PRICE} * CAST(0.0333 AS DECIMAL(5,4)) AS v FROM lineitem)
SELECT l_returnflag, CAST(round(sum(v), 2) * 100 AS BIGINT) AS once, CAST(sum(CAST(round(v, 2) * 100 AS BIGINT)) AS BIGINT) AS each FROM a GROUP BY 1
""")
def round_once(spark, sf_dir):
    """Cents of an exact sum, rounded once, beside the sum of rounded cents."""
    lines = table(spark, sf_dir, "lineitem", "l_returnflag", "l_extendedprice")
    amount = F.col("l_extendedprice").cast("decimal(18,2)") * F.lit("0.0333").cast("decimal(5,4)")
    rows = lines.select("l_returnflag", amount.alias("v"))
    return rows.groupBy("l_returnflag").agg(money.cents(F.sum("v")).alias("once"), F.sum(money.cents(F.col("v"))).alias("each"))


@query(f"""
WITH a AS (SELECT l_orderkey, l_linenumber, CAST({PRICE} * 100 AS HUGEINT) * CASE WHEN l_orderkey % 19 = 0 THEN -1 ELSE 1 END AS c, CASE WHEN l_orderkey % 13 = 0 THEN 0 ELSE CAST(CAST(l_quantity AS DECIMAL(18,2)) * 100 AS HUGEINT) END AS h FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN h > 0 THEN CAST(sign(c) * ((abs(c) * 200 + h) // (h * 2)) AS BIGINT) END AS rate_cents FROM a
""")
def hourly_rate_cents(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    amount = (F.col("l_extendedprice").cast("decimal(18,2)") * F.when(F.col("l_orderkey") % 19 == 0, -1).otherwise(1).cast("decimal(1,0)")).cast(money.SOURCE)
    hours = F.when(F.col("l_orderkey") % 13 == 0, F.lit(0).cast("decimal(18,2)")).otherwise(F.col("l_quantity").cast("decimal(18,2)")).cast(money.SOURCE)
    return lines.select("l_orderkey", "l_linenumber", money.hourly_rate_cents(amount, hours).cast("long").alias("rate_cents"))


@query("""
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 6 AS v, o_orderkey % 100 AS a, o_orderkey // 7 % 60 AS b, o_orderkey // 11 % 60 AS c FROM orders),
s AS (SELECT k, CASE v WHEN 0 THEN a * 60 WHEN 1 THEN a * 60 + b WHEN 2 THEN a * 3600 + b * 60 + c END AS source_seconds, CASE v WHEN 1 THEN a * 3600 + b * 60 WHEN 2 THEN a * 3600 + b * 60 + c END AS owner_seconds FROM o)
SELECT k AS o_orderkey, source_seconds, owner_seconds, (source_seconds // 3600) || ':' || lpad(CAST(source_seconds // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(source_seconds % 60 AS VARCHAR), 2, '0') AS clock,
  lpad(CAST(source_seconds // 3600 AS VARCHAR), greatest(2, CAST(length(CAST(source_seconds // 3600 AS VARCHAR)) AS INTEGER)), '0') || ':' || lpad(CAST(source_seconds // 60 % 60 AS VARCHAR), 2, '0') || CASE WHEN source_seconds % 60 = 0 THEN '' ELSE ':' || lpad(CAST(source_seconds % 60 AS VARCHAR), 2, '0') END AS short_clock FROM s
""")
def duration_grammar(spark, sf_dir):
    """The same texts under the source's grammar and the owner's."""
    orders = table(spark, sf_dir, "orders", "o_orderkey")
    k, div = F.col("o_orderkey"), lambda n: F.call_function("div", F.col("o_orderkey"), F.lit(n)) % 60
    a, b, c = (k % 100).cast("string"), F.lpad(div(7).cast("string"), 2, "0"), F.lpad(div(11).cast("string"), 2, "0")
    text = F.when(k % 6 == 0, a).when(k % 6 == 1, F.concat_ws(":", a, b)).when(k % 6 == 2, F.concat_ws(":", a, b, c)).when(k % 6 == 3, F.concat(a, F.lit(":61"))).when(k % 6 == 4, F.concat(F.lit("h"), a))
    rows = orders.select("o_orderkey", times.source_duration(text).alias("source_seconds"), times.owner_duration(text).alias("owner_seconds"))
    return rows.withColumns({"clock": times.clock(F.col("source_seconds")), "short_clock": times.short_clock(F.col("source_seconds"))})


SIGNED = "CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN -1 ELSE 1 END * CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT)"


@query(f"""
WITH o AS (SELECT o_orderkey, {SIGNED} AS c FROM orders)
SELECT o_orderkey, coalesce(CASE WHEN c < 0 THEN '−' ELSE '' END || 'R$ ' || replace(format('{{:,}}', abs(c) // 100), ',', '.') || ',' || lpad(CAST(abs(c) % 100 AS VARCHAR), 2, '0'), 'Não informado') AS shown FROM o
""")
def brl_format(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    sign = F.when(F.col("o_orderkey") % 23 == 0, None).when(F.col("o_orderkey") % 5 == 0, -1).otherwise(1)
    return orders.select("o_orderkey", money.brl(sign * money.cents(F.col("o_totalprice").cast("decimal(18,2)")), minus="−").alias("shown"))


@query("""
WITH o AS (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) * (o_orderkey % 9) // 7 AS p, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) END AS w FROM orders),
q AS (SELECT o_orderkey, CASE WHEN w > 0 THEN (p * 10000 + w // 2) // w END AS x FROM o)
SELECT o_orderkey, (x // 100) || ',' || lpad(CAST(x % 100 AS VARCHAR), 2, '0') || '%' AS shown FROM q
""")
def percent_format(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    cents = money.cents(F.col("o_totalprice").cast("decimal(18,2)"))
    part = F.call_function("div", cents * (F.col("o_orderkey") % 9), F.lit(7))
    return orders.select("o_orderkey", money.percent(part, F.when(F.col("o_orderkey") % 10 == 0, F.lit(0).cast("long")).otherwise(cents)).alias("shown"))


@query("""
WITH p AS (SELECT p_partkey, p_partkey % 8 AS v, CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS c FROM part)
SELECT p_partkey,
  CASE v WHEN 0 THEN c WHEN 1 THEN c WHEN 2 THEN -(c // 10 * 10) WHEN 3 THEN c // 100 * 100 WHEN 7 THEN 50 END AS sheet_cents,
  CASE v WHEN 1 THEN c // 100 || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') WHEN 2 THEN '-' || c // 100 || '.' || c // 10 % 10 WHEN 3 THEN CAST(c // 100 AS VARCHAR) WHEN 7 THEN '0.50' END AS ledger,
  CASE v WHEN 0 THEN c WHEN 1 THEN c WHEN 3 THEN c // 100 * 100 WHEN 7 THEN 50 END AS owner_cents
FROM p
""")
def parse_mixed_decimal(spark, sf_dir):
    """Amounts written in many ways under the three grammars: of sheets, of the ledger, and of owners."""
    part = table(spark, sf_dir, "part", "p_partkey", "p_retailprice")
    c, v = money.cents(F.col("p_retailprice").cast("decimal(18,2)")), F.col("p_partkey") % 8
    whole, cents = F.call_function("div", c, F.lit(100)), F.lpad((c % 100).cast("string"), 2, "0")
    tenth = (F.call_function("div", c, F.lit(10)) % 10).cast("string")
    text = (
        F.when(v == 0, F.concat(F.lit(" R$ "), F.translate(F.format_number(whole, 0), ",", "."), F.lit(","), cents))
        .when(v == 1, F.concat(whole.cast("string"), F.lit("."), cents))
        .when(v == 2, F.concat(F.lit("-"), whole.cast("string"), F.lit(","), tenth))
        .when(v == 3, F.concat(F.lit(" "), whole.cast("string")))
        .when(v == 4, F.lit("1,2,3"))
        .when(v == 5, F.lit("abc"))
        .when(v == 6, F.lit(""))
        .otherwise(F.lit("00,50"))
    )
    rows = part.select("p_partkey", text.alias("t"))
    return rows.select("p_partkey", money.cents(money.spreadsheet_decimal(F.col("t"))).alias("sheet_cents"), money.ledger_decimal(F.col("t")).alias("ledger"), money.brl_cents(F.col("t")).cast("long").alias("owner_cents"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders
""")
def date_or_serial(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    day, v = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 5
    serial = F.date_diff(day, F.lit(times.SERIAL_ZERO).cast("date")).cast("string")
    text = F.when(v == 0, F.date_format(day, "dd/MM/yyyy")).when(v == 1, F.concat(F.lit(" "), serial)).when(v == 2, F.date_format(day, "yyyy-MM-dd")).when(v == 3, F.lit("31/02/2024")).otherwise(F.lit("2024-2-1"))
    return orders.select("o_orderkey", F.date_format(times.mixed_date(text), "yyyy-MM-dd").alias("day"))


@query("""
WITH k AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderkey // 4 % 5000 AS VARCHAR) ELSE 'ab ' || o_orderkey // 8 END AS key FROM orders)
SELECT key, count(*) AS n, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id FROM k GROUP BY key HAVING count(*) > 1
""")
def invoice_number_key(spark, sf_dir):
    """Invoice numbers that several orders have once prefixes, zeros and case are gone."""
    orders = table(spark, sf_dir, "orders", "o_orderkey")
    k = F.col("o_orderkey")
    number = (F.call_function("div", k, F.lit(4)) % 5000).cast("string")
    text = F.when(k % 4 == 0, F.concat(F.lit("NFS-e 000"), number)).when(k % 4 == 1, F.concat(F.lit(" nfse"), number)).when(k % 4 == 2, F.concat(F.lit("0"), number)).otherwise(F.concat(F.lit(" AB "), F.call_function("div", k, F.lit(8)).cast("string")))
    return orders.select("o_orderkey", texts.invoice_key(text).alias("key")).groupBy("key").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_id"), F.max("o_orderkey").alias("last_id")).filter("n > 1")


@query(r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}', '[dado pessoal omitido]', 'gi'), '\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b', '[dado pessoal omitido]', 'g'),
  '\b\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}\b', '[dado pessoal omitido]', 'g'), '\(?\d{2}\)?[\s\x{A0}\x{3000}]?9?\d{4}-?\d{4}\b', '[dado pessoal omitido]', 'g')) AS redacted FROM documents
""")
def redact_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", F.md5(texts.redact_personal(F.col("text"))).alias("redacted"))


def public_sql(v):
    """SQL of a public text: places that end in a file's ending, other places, control characters."""
    root = r"(?:file://)?(?:/(?:Users|home)/[^/\s]+/|/(?:tmp|private|Volumes|var(?:/folders|/tmp)?|opt|srv|mnt)/|[A-Za-z]:\\|\\\\[^\\\s]+\\)"
    ended = rf"regexp_replace({v}, '{root}[^\r\n,;]*?\.[A-Za-z0-9]{{1,10}}(\s|[),;]|$)', '[caminho local omitido]\1', 'gi')"
    return rf"regexp_replace(regexp_replace({ended}, '{root}[^\s<>\"]+', '[caminho local omitido]', 'gi'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')"


@query(r"""
WITH t AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url || ' C:\Users\x.txt' WHEN 1 THEN '(/home/a/b c.pdf), ' || url WHEN 2 THEN 'file:///Volumes/X/y ' || url WHEN 3 THEN '\\host\share\z d.xlsx' ELSE url || chr(7) || '/tmp/q' END AS v FROM pages)
SELECT page_id, """ + public_sql("v") + """ AS shown FROM t
""")
def redact_paths(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    v, url = F.col("page_id") % 5, F.col("url")
    text = (
        F.when(v == 0, F.concat(url, F.lit(" C:\\Users\\x.txt"))).when(v == 1, F.concat(F.lit("(/home/a/b c.pdf), "), url)).when(v == 2, F.concat(F.lit("file:///Volumes/X/y "), url))
        .when(v == 3, F.lit("\\\\host\\share\\z d.xlsx")).otherwise(F.concat(url, F.lit("\x07/tmp/q")))
    )
    return pages.select("page_id", texts.redact_paths(text).alias("shown"))


def places_sql(text):
    for pattern in texts.PLACES:
        text = f"regexp_replace({text}, '{pattern}', '{texts.OMITTED_PATH}', 'g')"
    return f"regexp_replace({text}, '{texts.CONTROLS}', '', 'g')"


@query(r"""WITH t AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url || ' D:/Users/x y' WHEN 1 THEN '(/home/a/b c), ' || url WHEN 2 THEN 'file:///D:/x/y z.pdf; ' || url WHEN 3 THEN '\\host\share\z d <' || url ELSE url || chr(7) || '/tmp/q r' END AS v FROM pages)
SELECT page_id, """ + places_sql("v") + " AS shown FROM t")
def redact_places(spark, sf_dir):
    """Places in file systems by the fourth form of publications."""
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    v, url = F.col("page_id") % 5, F.col("url")
    text = (
        F.when(v == 0, F.concat(url, F.lit(" D:/Users/x y"))).when(v == 1, F.concat(F.lit("(/home/a/b c), "), url)).when(v == 2, F.concat(F.lit("file:///D:/x/y z.pdf; "), url))
        .when(v == 3, F.concat(F.lit("\\\\host\\share\\z d <"), url)).otherwise(F.concat(url, F.lit("\x07/tmp/q r")))
    )
    return pages.select("page_id", texts.redact_places(text).alias("shown"))


@query(r"""
WITH t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '=' || text WHEN 1 THEN text || chr(10) || '"end"' WHEN 2 THEN ' -' || text ELSE chr(160) || chr(8203) || '@' || text END AS v FROM conversations),
f AS (SELECT *, regexp_replace(""" + public_sql("coalesce(v, '')") + r""", '\r?\n', ' ', 'g') AS flat FROM t)
SELECT conv_id, turn, '"' || replace(CASE WHEN regexp_matches(flat, '^[\x00-\x20\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]*[=+\-@]') THEN chr(39) || flat ELSE flat END, '"', '""') || '"' AS cell FROM f
""")
def csv_guard(spark, sf_dir):
    """Cells that no spreadsheet runs as a formula."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    v, t = F.col("turn") % 4, F.col("text")
    text = F.when(v == 0, F.concat(F.lit("="), t)).when(v == 1, F.concat(t, F.lit('\n"end"'))).when(v == 2, F.concat(F.lit(" -"), t)).otherwise(F.concat(F.lit("\u00a0\u200b@"), t))
    return rows.select("conv_id", "turn", texts.csv_cell(text).alias("cell"))


@query("""
SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped, CAST(length(html) AS INTEGER) AS units FROM pages
""")
def html_escape(spark, sf_dir):
    """Escaped pages, and their length in UTF-16 units (the pages hold the first plane only)."""
    pages = table(spark, sf_dir, "pages", "page_id", "html")
    return pages.select("page_id", F.md5(texts.html_text(F.col("html"))).alias("escaped"), texts.utf16_length(F.col("html")).alias("units"))


@query("""
SELECT c_custkey, sha256('{"balance":"' || CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) || '","name":"' || c_name || '","segment":"' || c_mktsegment || '"}') AS hash FROM customer
""")
def canonical_hash(spark, sf_dir):
    """The hash of a flat map doesn't depend on the order in which it was built."""
    customer = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    payload = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name"), F.lit("balance"), F.col("c_acctbal").cast("decimal(18,2)").cast("string"))
    return customer.select("c_custkey", F.sha2(texts.canonical_map(payload), 256).alias("hash"))


@query("""
WITH h AS (SELECT o_orderkey, sha256('nfs:' || o_orderkey) AS s, md5(CAST(o_orderkey AS VARCHAR)) AS m FROM orders)
SELECT o_orderkey, s[1:8] || '-' || s[9:12] || '-' || s[13:16] || '-' || s[17:20] || '-' || s[21:32] AS sha_id, m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32] AS md5_id FROM h
""")
def stable_id(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", texts.hash_id("nfs:", key).alias("sha_id"), texts.md5_id(key).alias("md5_id"))


@query("""
WITH n AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN ' ' || upper(c_mktsegment) || '  x' WHEN 1 THEN lower(c_mktsegment) || ' X' WHEN 2 THEN ' - ' WHEN 3 THEN '' ELSE c_mktsegment || '   ' || c_nationkey END AS name FROM customer),
t AS (SELECT c_custkey, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS name FROM n)
SELECT lower(name) AS name_key, arg_min(name, c_custkey) AS name FROM t WHERE name NOT IN ('', '-') GROUP BY 1
""")
def executor_distinct(spark, sf_dir):
    """Distinct names without regard to case and blanks, each in its first spelling."""
    customer = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_nationkey")
    v, s = F.col("c_custkey") % 5, F.col("c_mktsegment")
    name = F.when(v == 0, F.concat(F.lit(" "), F.upper(s), F.lit("  x"))).when(v == 1, F.concat(F.lower(s), F.lit(" X"))).when(v == 2, F.lit(" - ")).when(v == 3, F.lit("")).otherwise(F.concat_ws("   ", s, F.col("c_nationkey").cast("string")))
    return load.first_spellings(customer.select("c_custkey", name.alias("name")), "name", "c_custkey")


@query("""
WITH d AS (SELECT o_custkey, CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders)
SELECT o_custkey, strftime(min(day), '%m/%Y') || ' a ' || strftime(max(day), '%m/%Y') AS period FROM d GROUP BY 1
""")
def period_extremes(spark, sf_dir):
    """The period of each customer's orders; texts that aren't dates count for nothing."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    text = F.when(F.col("o_orderkey") % 6 == 0, F.lit("30/02/2020")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    days = orders.select("o_custkey", times.mixed_date(text).alias("day"))
    return days.groupBy("o_custkey").agg(times.period(F.min("day"), F.max("day")).alias("period"))


@query("""
SELECT event_id, strftime(ts - INTERVAL 3 HOUR, '%d/%m/%Y, %H:%M:%S') AS shown FROM events
""")
def local_stamp(spark, sf_dir):
    """Instants shown in local time (the events fall in months of one offset)."""
    return table(spark, sf_dir, "events", "event_id", "ts").select("event_id", times.local_stamp(F.col("ts")).alias("shown"))


@query("""
SELECT l_orderkey, l_linenumber, CAST(round(CAST(l_quantity AS DECIMAL(18,2)) * CAST(0.0375 AS DECIMAL(5,4)) * 3600, 0) AS BIGINT) AS seconds FROM lineitem
""")
def hours_to_seconds(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    hours = (F.col("l_quantity").cast("decimal(18,2)") * F.lit("0.0375").cast("decimal(5,4)")).cast(money.SOURCE)
    return lines.select("l_orderkey", "l_linenumber", times.hours_to_seconds(hours).alias("seconds"))


@query("""
WITH p AS (SELECT p_partkey AS k, p_partkey % 7 AS v, CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS c FROM part)
SELECT k AS p_partkey,
  CASE v WHEN 0 THEN '-' || c // 100 || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') WHEN 1 THEN c // 100 || '.' || c || '0000000000' WHEN 2 THEN c // 100 || '.0' WHEN 3 THEN '123456789012' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') || '.5' WHEN 4 THEN '0.' || c % 10 END AS adjustment,
  CASE v WHEN 2 THEN c // 100 || '.00' WHEN 3 THEN '123456789012' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') || '.50' WHEN 4 THEN '0.' || c % 10 || '0' WHEN 5 THEN '1234567890123456' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') || '.00' END AS fiscal,
  CASE v WHEN 2 THEN c // 100 || '00' WHEN 3 THEN '123456789012' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') || '50' WHEN 4 THEN CAST(c % 10 * 10 AS VARCHAR) WHEN 5 THEN '1234567890123456' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') || '00' END AS cents
FROM p
""")
def brl_decimals(spark, sf_dir):
    """Signed amounts of adjustments, amounts of notes, and cents of up to 24 digits."""
    part = table(spark, sf_dir, "part", "p_partkey", "p_retailprice")
    c, v = money.cents(F.col("p_retailprice").cast("decimal(18,2)")), F.col("p_partkey") % 7
    whole, cents = F.call_function("div", c, F.lit(100)).cast("string"), F.lpad((c % 100).cast("string"), 2, "0")
    text = (
        F.when(v == 0, F.concat(F.lit(" R$ -"), whole, F.lit(","), cents))
        .when(v == 1, F.concat(F.lit("00"), whole, F.lit("."), c.cast("string"), F.lit("0000000000")))
        .when(v == 2, F.concat(F.lit("0"), whole))
        .when(v == 3, F.concat(F.lit("12.345.678.901.2"), cents, F.lit(",5")))
        .when(v == 4, F.concat(F.lit("r$\u00a00,"), (c % 10).cast("string")))
        .when(v == 5, F.concat(F.lit("1234567890123456"), cents))
        .otherwise(F.concat(whole, F.lit(",")))
    )
    t = F.col("t")
    rows = part.select("p_partkey", text.alias("t"))
    return rows.select("p_partkey", money.adjustment_decimal(F.lit("present"), t).alias("adjustment"), money.fiscal_decimal(t).alias("fiscal"), money.brl_cents(t).cast("string").alias("cents"))


@query("""
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS p, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders)
SELECT k AS o_orderkey, sha256('{"customer":{"id":' || c || ',"open":' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || '},"notes":{"B":["x\\"y","\\u0001\\n"],"a":[' || coalesce('"' || s || '"', 'null') || '],"é":[]},"priority":"' || p || '"}') AS hash FROM o
""")
def canonical_nested(spark, sf_dir):
    """Hashes of nested records, whatever the order in which their parts were named."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    k, none = F.col("o_orderkey"), F.array().cast("array<string>")
    notes = F.create_map(F.lit("é"), none, F.lit("a"), F.array(F.when(k % 3 != 0, F.col("o_orderstatus"))), F.lit("B"), F.array(F.lit('x"y'), F.lit("\x01\n")))
    rows = orders.select("o_orderkey", F.struct(F.col("o_orderpriority").alias("priority"), notes.alias("notes"), F.struct((k % 2 == 0).alias("open"), F.col("o_custkey").alias("id")).alias("customer")).alias("r"))
    return rows.select("o_orderkey", F.sha2(texts.canonical_json(F.col("r"), rows.schema["r"].dataType), 256).alias("hash"))


@query("""
SELECT c_custkey, sha256(encode(sha256(c_name)) || '\\x00'::BLOB || encode('header') || '\\x00'::BLOB || encode(CAST(c_custkey % 9 AS VARCHAR)) || '\\x00'::BLOB || encode('situação de ' || lower(c_mktsegment))) AS plain,
  sha256(encode(sha256(c_name)) || '\\x00'::BLOB || encode('header') || '\\x00'::BLOB || encode(CAST(c_custkey % 9 AS VARCHAR)) || '\\x00'::BLOB || encode('situacao de ' || lower(c_mktsegment))) AS header FROM customer
""")
def header_ids(spark, sf_dir):
    """Identifiers of headers: blanks around, marks and case don't count (``plain`` is the same without folding)."""
    customer = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    source, place = F.sha2("c_name", 256), F.col("c_custkey") % 9
    zero = F.lit(b"\x00")
    plain = F.concat(source.cast("binary"), zero, F.lit(b"header"), zero, place.cast("string").cast("binary"), zero, F.concat(F.lit("situação de "), F.lower("c_mktsegment")).cast("binary"))
    label = F.concat(F.lit("  Situac\u0327a\u0303o de "), F.col("c_mktsegment"), F.lit("\u00a0"))
    return customer.select("c_custkey", F.sha2(plain, 256).alias("plain"), labels.header_id(source, place, label).alias("header"))


@query("""
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) * 100 AS BIGINT) END AS v FROM customer), m AS (SELECT max(abs(v)) AS most FROM c)
SELECT c_custkey, CASE WHEN v = 0 THEN 0.0::DOUBLE ELSE round(greatest(1.0::DOUBLE, abs(v) * 100.0::DOUBLE / greatest(1, most)), 6) END AS width FROM c, m
""")
def bar_widths(spark, sf_dir):
    """Widths of bars against the longest one."""
    customer = table(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    rows = customer.select("c_custkey", F.when(F.col("c_custkey") % 11 == 0, 0).otherwise(money.cents(F.col("c_acctbal").cast("decimal(18,2)"))).alias("v"))
    most = rows.agg(F.max(F.abs("v")).alias("most"))
    return rows.crossJoin(F.broadcast(most)).select("c_custkey", F.round(labels.bar_width(F.col("v"), F.col("most")), 6).alias("width"))  # one row
