"""Column functions on written cases."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera.functions import labels, money, texts, times


def values(spark, f, cases, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (money.spreadsheet_decimal, {"-1.234,5678": Decimal("-1234.5678"), "R$ 10": Decimal(10), "1,2,3": None, "": None, None: None, "1" * 15: None, "0." + "1" * 17: None}),
        (money.ledger_decimal, {"1,20": "1.20", "007": "7", ".5": "0.5", "-0,50": "-0.50", "1.2,3": None, "1.": None, "": None, None: None}),
        (money.brl_cents, {"1.234,56": 123456, "R$ 1,5": 150, "10.5": 1050, "1.234": 123400, "1.23.4": None, "-1": None, "": None, None: None}),
        (times.source_duration, {"90": 5400, "59:59": 3599, "1:00:30": 3630, "1:60": None, "": None, None: None}),
        (times.owner_duration, {"90": None, "59:59": 59 * 3600 + 59 * 60, "1:00:30": 3630, "1:60": None, None: None}),
        (lambda c: times.mixed_date(c).cast("string"), {"22/08/2024": "2024-08-22", "45526": "2024-08-22", "2024-08-22": "2024-08-22", "31/02/2024": None, "2024-02-31": None, "1": None, "": None, None: None}),
        (texts.invoice_key, {"NFS-e 007": "7", "nfse 0": "0", "NFSe": "nfse", " Ab ": "ab", "000": "0", "NFS e: 007": "7", "nfs-e #12": "12", "NFSE - 3": "3", "NFSE -- 3": "nfse -- 3", "a  b\tc": "a b c", "nfs 1": "nfs 1", None: None}),
        (texts.title_key, {"  Ação  Ímpar ": "acao impar", "Šabăc ő ą e\u0301 \u1ea5": "sabac o a e a", "\u00a0x\u2003y\ufeff": "x y", "": "", None: None}),
        (texts.csv_cell, {"\u00a0=1+1": "\"'\u00a0=1+1\"", "\u3000@x": "\"'\u3000@x\"", "\u2028-2": "\"'\u2028-2\"", "\x07+1": "\"'+1\"", "see /Users/jo/My file.pdf, end": '"see [caminho local omitido], end"', "=1": "\"'=1\"", "​@x": "\"'​@x\"", 'a"b\r\nc': '"a""b c"', "": '""', None: '""'}),
        (texts.redact_personal, {"a@b.co 11.222.333/0001-44": " ".join([texts.OMITTED] * 2), "111.222.333-44 (11) 91234-5678": " ".join([texts.OMITTED] * 2), "(11) 912345678": texts.OMITTED, "11 1234-5678.": texts.OMITTED + ".", "A.B+c@D-e.ORG": texts.OMITTED, "12": "12", None: None}),
        (texts.redact_paths, {"/Users/jo/My file.pdf": texts.OMITTED_PATH, "x file:///home/a/b c": f"x {texts.OMITTED_PATH} c", "/Volumes/A b/c": f"{texts.OMITTED_PATH} b/c", "\\\\host\\x y.doc; z": f"{texts.OMITTED_PATH}; z", "c:\\a b.txt)": f"{texts.OMITTED_PATH})", "/var/folders/q\x07r": texts.OMITTED_PATH, "a\x07b\tc": "ab\tc", "/home": "/home", None: None}),
        (texts.html_text, {"<a b=\"c\">'&": "&lt;a b=&quot;c&quot;&gt;&#39;&amp;", None: None}),
        (texts.utf16_length, {"a😀": 3, "": 0, None: None}),
        (labels.whole, {"12.00": "12", "1.5": None, " 7 ": "7", None: None}),
        (labels.grouped_number, {"1.234,500": "1234.5", "007": "7", "0,00": "0", "-01.50": "-1.5", "x": None, None: None}),
        (labels.yes_no, {"Sim": True, "sim, tudo": None, "sim claro": True, "NÃO": False, "Não elegível": False, "": None, None: None}),
        (labels.availability, {"Confirmado": "Disponível", "ok": "Disponível", "x ok": "Pendente", None: "Pendente"}),
        (lambda c: labels.relation(c, F.lit(True)), {"MÉDIO": "Média", "forte": "Forte", "x": labels.NO_RELATION, None: labels.NO_RELATION}),
        (labels.tri_state, {"yes": True, "no": False, "unknown": None}),
    ],
)
def test_texts(spark, f, cases):
    assert values(spark, f, cases) == list(cases.values())


def test_money_is_rounded_once_and_away_from_zero(spark):
    cents = lambda c: money.cents(c.cast("decimal(30,16)"))
    assert values(spark, cents, ["0.005", "-0.005", "1.004", "-1234.5678", None]) == [1, -1, 100, -123457, None]
    three = spark.createDataFrame([("0.004",)] * 3, "v string").agg(money.cents(F.sum(F.col("v").cast("decimal(30,16)"))).alias("x"))
    assert three.first()["x"] == 1
    assert values(spark, money.brl, [123456, -5, 0, None], "long") == ["R$ 1.234,56", "-R$ 0,05", "R$ 0,00", money.UNKNOWN]
    rows = spark.createDataFrame([("10", "3"), ("-10", "4"), ("10.0000000000000001", "3"), ("1", "0"), ("1", None)], "a string, h string")
    rate = money.hourly_rate_cents(F.col("a").cast(money.SOURCE), F.col("h").cast(money.SOURCE))
    assert [r["x"] for r in rows.select(rate.alias("x")).collect()] == [333, -250, 333, None, None]


def test_shown_states(spark):
    df = spark.createDataFrame([("recebido_confirmado", "2024-08-22"), ("revertido", None), (None, None)], "s string, d string")
    assert [r["x"] for r in df.select(labels.refund(F.col("s"), F.col("d").cast("date")).alias("x")).collect()] == ["Recebido confirmado · 22/08/2024", "Desconsiderado / revertido", labels.UNKNOWN_STATE]
    assert values(spark, lambda c: labels.cost(F.lit("Pagamento"), c, F.lit(None).cast("date")), ["confirmado", "nao_informado", None])[0].startswith("Saída de custo confirmada · Data")


def test_hashes_do_not_depend_on_order(spark):
    df = spark.sql("SELECT map('b', '1', 'a', cast(null AS string)) AS x, map('a', cast(null AS string), 'b', '1') AS y")
    row = df.select(texts.canonical_map(F.col("x")).alias("x"), texts.canonical_map(F.col("y")).alias("y")).first()
    assert row["x"] == row["y"]
    ids = values(spark, lambda c: labels.header_id(F.lit("s"), F.lit(1), c), ["Código", " codigo ", "outro"])
    assert ids[0] == ids[1] != ids[2] and len(ids[0]) == 64


def test_places_of_the_fourth_form(spark):
    """Drives with either slash, blanks in places without a file's ending, and what ends a place."""
    gone = "[caminho local omitido]"
    cases = {
        "file:///D:/x/y z.pdf": gone, "see C:/a b/c, then": f"see {gone}, then", "/home/u/a b c (x) y": f"{gone}) y", "\\\\srv\\share\\a b;c": f"{gone};c", "D:\\one two\nnext": f"{gone}\nnext",
        "file:///Users/ann/My Files": gone, "/VAR/tmp/q r <b>": f"{gone}<b>", "http://a.com/home": f"htt{gone}", "bell\x07": "bell", "": "",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", texts.redact_places(F.col("t")).alias("s"), texts.csv_cell(F.col("t"), texts.redact_places).alias("c")).collect()
    assert {r["t"]: r["s"] for r in rows} == cases
    assert all(r["c"].startswith('"') and "/home/u" not in r["c"] for r in rows)
    assert spark.range(1).select(texts.redact_places(F.lit(None).cast("string")).alias("s")).first()["s"] is None
