"""Queries over files that the tables stand for, and over text lines."""

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tessera.functions import labels
from tessera.operators import commitment, preview
from tessera.plans.registry import query, table
from tessera.sources import delimited, invoices, pages, sheets


@query("""
WITH c AS (SELECT c_custkey, c_name || ', "' || c_mktsegment || '"' AS label, c_custkey // 100 AS f, row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey) AS n FROM customer)
SELECT 'f' || f AS path, CAST(n AS INTEGER) AS row, 'row:' || (1 + n) AS locator, CAST(c_custkey AS VARCHAR) AS id, label, CAST(NULL AS VARCHAR) AS issue FROM c WHERE f % 5 <> 1
UNION ALL SELECT DISTINCT 'f' || f, NULL, NULL, NULL, NULL, 'CSV_MALFORMED' FROM c WHERE f % 5 = 1
""")
def strict_csv(spark, sf_dir):
    """Customers as delimited files of a hundred lines; every fifth file is malformed and refused whole."""
    customer = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    number = F.call_function("div", F.col("c_custkey"), F.lit(100))
    label = F.concat(F.col("c_name"), F.lit(', "'), F.col("c_mktsegment"), F.lit('"'))
    quoted = F.concat(F.lit('"'), F.replace(label, F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(","), quoted, F.when(number % 5 == 1, "x").otherwise(""), F.lit("\r\n"))
    lines = customer.groupBy(F.concat(F.lit("f"), number.cast("string")).alias("path")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))).alias("lines"))
    files = lines.select("path", F.concat(F.lit("id,label\r\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "")).cast("binary").alias("content"))
    found = delimited.read_strict(files)
    return found.filter("row IS NULL OR row > 0").select("path", "row", "locator", F.col("cells")[0].alias("id"), F.col("cells")[1].alias("label"), "issue")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS number, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS issued,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS amount, CASE WHEN o_orderkey % 11 = 0 THEN 'CANCELLED_OR_REPLACED' END AS issue FROM orders
""")
def xml_note(spark, sf_dir):
    """Orders as invoices in XML; every eleventh is cancelled and therefore refused."""
    orders = dealt(table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_totalprice"), F.col("o_orderkey"))
    text = F.concat(
        F.lit(f'<n:Nfse xmlns:n="{invoices.CITY}" versao="2.04"><n:InfNfse><n:Numero>'), F.col("o_orderkey").cast("string"), F.lit("</n:Numero><n:DataEmissao>"), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit("T10:00:00Z</n:DataEmissao><n:DeclaracaoPrestacaoServico><n:InfDeclaracaoPrestacaoServico><n:Servico><n:Valores><n:ValorServicos>"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
        F.lit("</n:ValorServicos></n:Valores></n:Servico></n:InfDeclaracaoPrestacaoServico></n:DeclaracaoPrestacaoServico></n:InfNfse>"), F.when(F.col("o_orderkey") % 11 == 0, "<n:NfseCancelamento/>").otherwise(""), F.lit("</n:Nfse>"),
    )
    notes = invoices.read_notes(orders.select(F.col("o_orderkey").cast("string").alias("path"), text.cast("binary").alias("content")))
    return notes.select(F.col("path").cast("long").alias("o_orderkey"), "number", "issued", "amount", "issue")


def dealt(rows, key):
    """Rows dealt by a key to as many tasks as the session shuffles to: files are small beside what they are read into, so their bytes don't say how many fit a task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


@F.pandas_udf(BinaryType())
def _archive(parts: pd.Series) -> pd.Series:
    """Archives of files by name, to be read back."""
    def packed(files):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, text in dict(files).items():
                archive.writestr(name, text)
        return buffer.getvalue()

    return parts.map(packed)


@query("""
WITH c AS (SELECT o_orderkey, o_orderstatus, o_orderdate, o_orderkey // 400 AS f, o_totalprice,
  row_number() OVER (PARTITION BY o_orderkey // 400, o_orderkey % 2 ORDER BY o_orderkey) AS n FROM orders)
SELECT 'f' || f AS path, CAST(o_orderkey % 2 AS INTEGER) AS ordinal, CASE o_orderkey % 2 WHEN 0 THEN 'even' ELSE 'Aba 2' END AS sheet, o_orderkey % 2 = 0 AS visible, CAST(n AS INTEGER) AS row,
 'row:' || (3 + o_orderkey % 400) AS locator, CAST(o_orderkey AS VARCHAR) AS code, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS day,
 CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS amount, CASE WHEN o_orderkey % 3 = 0 THEN 'true' ELSE 'false' END AS flag, CAST(NULL AS VARCHAR) AS issue
FROM c WHERE f % 6 <> 1
UNION ALL SELECT DISTINCT 'f' || f, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'WORKBOOK_UNSAFE' FROM c WHERE f % 6 = 1
""")
def workbook_rows(spark, sf_dir):
    """Orders as workbooks of 400 lines on two sheets, with shared texts, serials as days, gaps and flags; every sixth has a formula."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    k, f = F.col("o_orderkey"), F.call_function("div", F.col("o_orderkey"), F.lit(400))
    at = (k % 400 + 3).cast("string")
    serial = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date")).cast("string")
    place = F.instr(F.lit("FOP"), F.col("o_orderstatus")) - 1
    cell = lambda column, more, body: F.concat(F.lit(f'<c r="{column}'), at, F.lit(f'"{more}>'), body, F.lit("</c>"))
    held = lambda x: F.concat(F.lit("<v>"), x.cast("string"), F.lit("</v>"))
    amount = F.when(k % 5 == 0, "").otherwise(cell("D", ' t="inlineStr"', F.concat(F.lit("<is><r><t>"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("</t></r></is>"))))
    line = F.concat(F.lit('<row r="'), at, F.lit('">'), cell("A", "", held(k)), cell("B", ' t="s"', held(place)), cell("C", ' s="1"', held(serial)), amount, cell("E", ' t="b"', held((k % 3 == 0).cast("int"))), F.lit("</row>"))
    head = "".join(f'<c t="inlineStr"><is><t>{h}</t></is></c>' for h in ("code", "status", "day", "amount", "flag"))
    formula = F.when(F.col("f") % 6 == 1, '<row r="500"><c r="A500"><f>1+1</f><v>2</v></c></row>').otherwise("")
    sheet = lambda n: F.concat(F.lit(f'<worksheet><sheetData><row r="2">{head}</row>'), F.array_join(F.transform(F.filter("lines", lambda x: x["k"] % 2 == n), lambda x: x["line"]), ""), formula, F.lit("</sheetData></worksheet>"))
    fixed = {
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="even" r:id="a"/><sheet state="hidden" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Target="worksheets/one.xml"/><Relationship Id="b" Target="xl/worksheets/two.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>F</t></si><si><t>O</t></si><si><r><t>P</t></r></si></sst>",
        "xl/styles.xml": '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    }
    lines = dealt(orders.withColumn("f", f), F.col("f")).groupBy("f").agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), line.alias("line")))).alias("lines"))  # 400 a file
    parts = F.create_map(*(F.lit(x) for pair in fixed.items() for x in pair), F.lit("xl/worksheets/one.xml"), sheet(0), F.lit("xl/worksheets/two.xml"), sheet(1))
    found = sheets.read_sheets(lines.select(F.concat(F.lit("f"), F.col("f").cast("string")).alias("path"), _archive(parts).alias("content")))
    values = (F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(("code", "status", "day", "amount", "flag")))
    return found.filter("row IS NULL OR row > 0").select("path", "ordinal", "sheet", "visible", "row", "locator", *values, "issue")


@query("""
WITH o AS (SELECT o_orderkey AS doc, CASE o_orderkey % 4 WHEN 0 THEN 'suggested' WHEN 1 THEN 'suggested' WHEN 2 THEN 'several_notes' ELSE 'unsafe' END AS v, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount FROM orders)
SELECT doc, 'number' AS field, CASE v WHEN 'suggested' THEN CAST(doc AS VARCHAR) END AS value, CASE v WHEN 'unsafe' THEN 'absent' ELSE v END AS verdict FROM o
UNION ALL SELECT doc, 'date', NULL, CASE v WHEN 'several_notes' THEN v ELSE 'absent' END FROM o
UNION ALL SELECT doc, 'amount', CASE v WHEN 'suggested' THEN amount END, v FROM o
""")
def label_value_extract(spark, sf_dir):
    """Labels and values on the lines of pages: one note, two notes, or a label without a value."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    k, amount = F.col("o_orderkey"), F.replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    number = F.concat(F.lit("Número da NFS-e: "), k.cast("string"))
    value = F.concat(F.lit("\nValor bruto\nR$ "), amount)
    text = F.when(k % 4 == 0, F.concat(number, value)).when(k % 4 == 1, F.concat(number, F.lit("\r\nValor total da nota = "), amount)).when(k % 4 == 2, F.concat(number, value, F.lit("\nNúmero da nota: X"))).otherwise(F.lit("Valor bruto: a combinar"))
    return pages.suggestions(orders.select(k.alias("doc"), F.lit(0).alias("page"), text.alias("text")))


@query("""
WITH t AS (SELECT o_orderkey AS k, o_orderkey % 9 = 0 AS blank, o_orderkey % 8 = 0 AS bad_day, o_orderkey % 7 = 0 AS bad_value, o_orderkey % 10 = 0 AS formula FROM orders)
SELECT k AS o_orderkey, CASE WHEN blank OR bad_day OR bad_value OR (formula AND NOT blank) THEN 'rejected' ELSE 'valid' END AS status,
 concat_ws(',', CASE WHEN blank THEN 'REQUIRED_FIELD:codigo' WHEN formula THEN 'FORMULA:codigo' END, CASE WHEN bad_day THEN 'INVALID_DATE:data' END, CASE WHEN bad_value THEN 'INVALID_DECIMAL:valor' END) AS errors FROM t
""")
def ledger_preview(spark, sf_dir):
    """Orders as rows of a ledger import."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_totalprice")
    k = F.col("o_orderkey")
    code = F.when(k % 9 == 0, " ").when(k % 10 == 0, F.concat(F.lit("="), k.cast("string"))).otherwise(k.cast("string"))
    day = F.when(k % 8 == 0, "2024-02-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    value = F.when(k % 7 == 0, "1.2,3").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    rows = orders.select("o_orderkey", F.concat(F.lit("row:"), k.cast("string")).alias("locator"), F.array(code, day, value).alias("cells"))
    schema = [preview.Field("codigo", required=True, most=120), preview.Field("data", "date"), preview.Field("valor", "decimal")]
    checked = preview.preview(rows, {0: "codigo", 1: "data", 2: "valor"}, schema, 3, ("codigo",))
    return checked.select("o_orderkey", "status", F.array_join("errors", ",").alias("errors"))


@query("""
WITH r AS (SELECT event_id, user_id, event_id % 6 AS v FROM events), k AS (SELECT DISTINCT user_id FROM events WHERE event_id % 50 = 0)
SELECT event_id, CASE WHEN k.user_id IS NOT NULL AND v = 0 THEN 'conflict' WHEN k.user_id IS NOT NULL THEN 'reused' WHEN v = 1 THEN 'expired' ELSE 'applied' END AS verdict FROM r LEFT JOIN k USING (user_id)
""")
def request_replay(spark, sf_dir):
    """Requests that repeat a key: with the same payload they are reused, with another they conflict."""
    events = table(spark, sf_dir, "events", "event_id", "user_id")
    key, v = F.concat(F.lit("k"), F.col("user_id").cast("string")), F.col("event_id") % 6
    print_ = F.concat(F.lit("p"), F.col("user_id").cast("string"))
    requests = events.select(F.col("event_id").alias("request_id"), key.alias("idempotency_key"), F.when(v == 0, F.concat(print_, F.lit("x"))).otherwise(print_).alias("fingerprint"), (v == 1).alias("expired"))
    known = events.filter("event_id % 50 = 0").select(key.alias("idempotency_key"), print_.alias("fingerprint")).distinct()
    return preview.settle_requests(requests, known).withColumnRenamed("request_id", "event_id")


#: Levels of a hash tree in SQL: enough for 64 ** 5 leaves. A level of one node is the root and stays as it is.
LEVELS = range(1, 6)


def tree_sql(leaves):
    """Levels ``l0`` (place, hash) to ``l5`` over the leaves of a query, and ``t`` (hash, height)."""
    level = "l{1} AS (SELECT place // 64 AS place, CASE WHEN (SELECT count(*) FROM l{0}) = 1 THEN min(hash) ELSE sha256('node:' || string_agg(hash, ':' ORDER BY place)) END AS hash FROM l{0} GROUP BY 1)"
    height = " + ".join(f"CAST((SELECT count(*) FROM l{i - 1}) > 1 AS INTEGER)" for i in LEVELS)
    return ", ".join([f"l0 AS ({leaves})", *(level.format(i - 1, i) for i in LEVELS), f"t AS (SELECT coalesce((SELECT hash FROM l{LEVELS[-1]}), sha256('empty')) AS hash, {height} AS height)"])


@query(f"""
WITH a AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)), {tree_sql("SELECT row_number() OVER (ORDER BY id) - 1 AS place, sha256('leaf:' || id) AS hash FROM a")}
SELECT hash, height FROM t
""")
def absence_commitment(spark, sf_dir):
    """The hash that stands for all customers without orders."""
    customer, orders = table(spark, sf_dir, "customer", "c_custkey"), table(spark, sf_dir, "orders", "o_custkey")
    absent = customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return commitment.root(commitment.tree(absent, "c_custkey"))


LINE_FIELDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]
PACKED_LINE = " || ".join(f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in LINE_FIELDS)


@query(f"""
WITH c AS (SELECT l_orderkey, l_linenumber, {PACKED_LINE} AS content FROM lineitem), {tree_sql("SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, content) - 1 AS place, sha256('leaf:' || content) AS hash FROM c")}
SELECT (SELECT count(*) FROM l0) AS n, height, hash AS root_hash, sha256('lines/v1/root:' || (SELECT count(*) FROM l0) || ':' || hash) AS commitment FROM t
""")
def ordered_root(spark, sf_dir):
    """All order lines as one ordered list under a hash; their dates are left out."""
    lines = table(spark, sf_dir, "lineitem", *LINE_FIELDS)
    return commitment.ordered_root(commitment.ordered_tree(lines, ["l_orderkey", "l_linenumber"], LINE_FIELDS), "lines/v1")


@query()
def absence_tree(spark, sf_dir):
    """The same set under a balanced binary tree, as one commitment (its tree has no SQL)."""
    customer, orders = table(spark, sf_dir, "customer", "c_custkey", "c_name"), table(spark, sf_dir, "orders", "o_custkey")
    absent = customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    items = absent.select(F.md5(F.col("c_custkey").cast("string")).alias("record"), F.col("c_name").alias("content"))
    return commitment.balanced_root(commitment.balanced(items, "record", "content", "absence/v1"), "absence/v1")


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Forte' WHEN 1 THEN 'Média' WHEN 2 THEN 'Fraca' ELSE 'Sem relação confirmada' END AS relation, CASE WHEN p_partkey % 3 = 0 THEN 'Disponível' ELSE 'Pendente' END AS evidence,
 CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS eligible FROM part
""")
def state_labels(spark, sf_dir):
    part = table(spark, sf_dir, "part", "p_partkey")
    k = F.col("p_partkey")
    strength = F.element_at(F.array(F.lit("FORTE"), F.lit("Médio"), F.lit("fraco"), F.lit("forte"), F.lit("outra")), (k % 5 + 1).cast("int"))
    status = F.when(k % 3 == 0, "Confirmado").otherwise("aberto")
    eligible = F.element_at(F.array(F.lit("Sim "), F.lit("NÃO elegível"), F.lit("talvez"), F.lit("")), (k % 4 + 1).cast("int"))
    return part.select("p_partkey", labels.relation(strength, k % 5 != 3).alias("relation"), labels.availability(status).alias("evidence"), labels.yes_no(eligible).alias("eligible"))
