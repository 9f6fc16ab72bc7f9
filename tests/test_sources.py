"""Sources and sinks on small files."""

import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import delimited, files, invoices, pages, sheets


def source(spark, contents):
    return spark.createDataFrame([(f"f{i}", bytearray(c) if c is not None else None) for i, c in enumerate(contents)], "path string, content binary")


def read(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["path"], r["row"] or 0)):
        out.setdefault(r["path"], []).append(r["issue"] or (r["locator"], r["cells"]))
    return list(out.values())


def test_strict_csv(spark):
    contents = [
        b'codigo,descricao\r\nA-1,"linha 1\r\nlinha 2"\r\nA-2,normal\r\n',
        b'a,b\n1,"x"y\n',
        b'a,b\n1,x"y\n',
        b'a,b\n1,"open\n',
        b"a\nA\0B",
        b"\xef\xbb\xbfa\n1\n",
        b"a\n\xff\n",
        b"",
        None,
        b' ,b\n1,2',
        b'a,b\n"x ""q""" ,\n',
    ]
    got = read(delimited.read_strict(source(spark, contents), multiline=True))
    assert got[0] == [("row:1", ["codigo", "descricao"]), ("row:2", ["A-1", "linha 1\nlinha 2"]), ("row:4", ["A-2", "normal"])]
    by_path = dict(zip(sorted(f"f{i}" for i in range(11)), got, strict=True))
    assert {p: g[0] for p, g in by_path.items() if isinstance(g[0], str)} == {f"f{i}": c for i, c in {1: "CSV_MALFORMED", 2: "CSV_MALFORMED", 3: "CSV_MALFORMED", 4: "CSV_MALFORMED", 5: "CSV_OPTIONS_UNSUPPORTED", 6: "CSV_OPTIONS_UNSUPPORTED", 7: "CSV_MALFORMED", 8: "CSV_MALFORMED", 9: "CSV_MALFORMED"}.items()}
    assert by_path["f10"][1] == ("row:2", ['x "q"', ""])
    assert read(delimited.read_strict(source(spark, contents[:1])))[0] == ["CSV_MALFORMED"]
    small = delimited.Budget(rows=1, cell_chars=3)
    assert read(delimited.read_strict(source(spark, [b"a\n1\n2\n", b"a\n1234\n", b"a\n123"]), budget=small)) == [["TABULAR_LIMIT_EXCEEDED"], ["TABULAR_LIMIT_EXCEEDED"], [("row:1", ["a"]), ("row:2", ["123"])]]
    assert read(delimited.read_strict(source(spark, [b"\xef\xbb\xbfa;b\n1;2"]), delimiter=";", bom=True))[0][1] == ("row:2", ["1", "2"])
    assert read(delimited.read_strict(source(spark, [b'a|b\n"1|2']), delimiter="|", quote=False))[0][1] == ("row:2", ['"1', "2"])


def book(sheet, extra=(), styles=None, relation="worksheets/sheet1.xml"):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="Resumo" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships><Relationship Id="rId1" Target="{relation}"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{sheet}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>codigo</t></si><si><t>A-1</t></si></sst>")
        if styles:
            z.writestr("xl/styles.xml", styles)
        for name, data in extra:
            z.writestr(name, data)
    return buffer.getvalue()


HEADER = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>data</t></is></c></row>'


def test_workbooks(spark):
    styles = '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'
    contents = [
        book(HEADER + '<row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3" s="1"><v>45526</v></c></row><row r="4"><c r="B4" t="b"><v>1</v></c></row>', styles=styles),
        book(HEADER + '<row r="2"><c r="A2"><f>SUM(1)</f><v>1</v></c></row>'),
        book(HEADER, extra=[("xl/embeddings/object.bin", b"x")]),
        book(HEADER, extra=[("../x", b"x")]),
        book(HEADER, relation="http://example.org/x.xml"),
        book(HEADER + '<row r="2"><c r="A2" t="s"><v>7</v></c></row>'),
        book(HEADER + '<row r="2"><c r="C2"><v>7</v></c></row>'),
        book("<!DOCTYPE x>" + HEADER),
        book(HEADER, extra=[("big.xml.bin", b"0" * 2_000_000)]),
        b"\xd0\xcf\x11\xe0",
    ]
    got = sheets.read_sheets(source(spark, contents))
    good = got.filter("path = 'f0'").orderBy("row").collect()
    assert [(r["row"], r["locator"], r["cells"]) for r in good] == [(0, "row:1", ["codigo", "data"]), (1, "row:3", ["A-1", "2024-08-22"]), (2, "row:4", ["", "true"])]
    assert (good[0]["sheet"], good[0]["visible"], good[0]["ordinal"]) == ("Resumo", True, 0)
    issues = {r["path"]: r["issue"] for r in got.filter("issue IS NOT NULL").collect()}
    assert issues == {"f1": "WORKBOOK_UNSAFE", "f2": "WORKBOOK_UNSAFE", "f3": "WORKBOOK_UNSAFE", "f4": "WORKBOOK_UNSAFE", "f5": "WORKBOOK_INVALID", "f6": "WORKBOOK_INVALID", "f7": "WORKBOOK_UNSAFE", "f8": "TABULAR_LIMIT_EXCEEDED", "f9": "XLS_BINARY_UNSUPPORTED"}
    days = spark.createDataFrame([(59, False), (60, False), (61, False), (0, True), (2_958_466, True)], "n int, old boolean")
    assert [r[0] for r in days.select(sheets.serial_date(F.col("n"), F.col("old"))).collect()] == ["1900-02-28", None, "1900-03-01", "1904-01-01", None]


def packed(sheets_xml, shared="", styles="", base=""):
    """An archive of (name, state, sheet XML)."""
    names = "".join(f'<x:sheet name="{n}" state="{state}" r:id="r{i}"/>' for i, (n, state, _) in enumerate(sheets_xml))
    parts = {
        "xl/workbook.xml": f'<x:workbook xmlns:x="m" xmlns:r="r">{base}<x:sheets>{names}</x:sheets></x:workbook>',
        "xl/_rels/workbook.xml.rels": "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="./worksheets/s{i}.xml"/>' for i in range(len(sheets_xml))) + "</Relationships>",
        "xl/sharedStrings.xml": f"<sst>{shared}</sst>",
        "xl/styles.xml": f"<styleSheet>{styles}</styleSheet>",
    } | {f"xl/worksheets/s{i}.xml": f"<worksheet><sheetData>{x}</sheetData></worksheet>" for i, (_, _, x) in enumerate(sheets_xml)}
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return buffer.getvalue()


def test_workbooks_of_random_cells_read_back(spark):
    rng = random.Random(7)
    letters = lambda n: ("" if n < 26 else chr(64 + n // 26)) + chr(65 + n % 26)
    shared = ["plain", "rich text", ""]
    shared_xml = "<si><t>plain</t></si><si><r><t>rich </t></r><r><t>text</t></r></si><si/>"
    styles = '<numFmts><numFmt numFmtId="164" formatCode="0.00&quot;d&quot;"/><numFmt numFmtId="165" formatCode="[Red]d\\-m"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs>'
    contents, want = [], {}
    for b in range(25):
        old, book_sheets = b % 2 == 1, []
        for ordinal in range(rng.randint(1, 3)):
            width = rng.choice([1, 3, 30])
            rows, number, xml = [], 0, ""
            for i in range(rng.randint(1, 5)):
                skip = rng.choice([1, 1, 4])
                number += skip
                cells, at, inner = [""] * width, -1, ""
                for c in range(width):
                    if i and rng.random() < 0.4:
                        continue
                    kind = 0 if i == 0 else rng.randrange(7)
                    style = rng.randrange(4)
                    text, body, more = [
                        (f"h{c}", f"<is><t>h{c}</t></is>", 't="inlineStr"'),
                        (shared[k := rng.randrange(3)], f"<v>{k}</v>", 't="s"'),
                        ("true", "<v>1</v>", 't="b"'),
                        ("false", "<v>0</v>", 't="b"'),
                        ("1.5", "<v>1.5</v>", f's="{style}"'),
                        (("1904-03-01" if old else "60") if style in (1, 3) else "60", "<v>60</v>", f's="{style}" t="n"'),
                        (("2028-08-23" if old else "2024-08-22") if style in (1, 3) else "45526.0", "<v>45526.0</v>", f's="{style}"'),
                    ][kind]
                    place = "" if at == c - 1 and rng.random() < 0.5 else f'r="{letters(c)}{number}"'
                    inner, at, cells[c] = inner + f"<c {place} {more}>{body}</c>", c, text
                xml += f"<row {'' if skip == 1 and rng.random() < 0.5 else f'r=\"{number}\"'}>{inner}</row>"
                rows.append((f"row:{number}", cells))
            name, state = rng.choice([("", "visible"), (f"S{ordinal}", "hidden")])
            book_sheets.append((name, state, xml))
            for i, (locator, cells) in enumerate(rows):
                want[f"f{b}", ordinal, i] = (name or f"Aba {ordinal + 1}", state == "visible", locator, cells, None)
        contents.append(packed(book_sheets, shared_xml, styles, '<x:workbookPr date1904="1"/>' if old else ""))
    got = {(r["path"], r["ordinal"], r["row"]): (r["sheet"], r["visible"], r["locator"], r["cells"], r["issue"]) for r in sheets.read_sheets(source(spark, contents)).collect()}
    assert got == want


def test_faults_of_workbooks(spark):
    row = lambda cells, number=2: f'<row r="{number}">{cells}</row>'
    cases = [
        (b"", "WORKBOOK_INVALID"), (None, "WORKBOOK_INVALID"), (b"PK\3\4", "WORKBOOK_UNSAFE"),
        (book(HEADER + row('<c r="A2"/>', 1)), "WORKBOOK_INVALID"), (book(HEADER + row("", "x")), "WORKBOOK_INVALID"),
        (book(HEADER + row('<c r="A3"/>')), "WORKBOOK_INVALID"), (book(HEADER + row('<c r="A2"/><c r="A2"/>')), "WORKBOOK_INVALID"),
        (book(HEADER + row('<c r="IW2"><v>1</v></c>')), "TABULAR_LIMIT_EXCEEDED"), (book(HEADER + row('<c r="ABCDEFGHIJKL2"/>')), "TABULAR_LIMIT_EXCEEDED"),
        # The first fault of a sheet counts.
        (book(HEADER + row('<c r="IW2"/>') + row('<c r="A9"/>', 3)), "TABULAR_LIMIT_EXCEEDED"), (book(HEADER + row('<c r="A9"/>') + row('<c r="IW3"/>', 3)), "WORKBOOK_INVALID"),
        (book(HEADER + row(f'<c r="A2" t="inlineStr"><is><t>{"x" * 10_001}</t></is></c>')), "TABULAR_LIMIT_EXCEEDED"),
        (book(""), "WORKBOOK_INVALID"), (book(row('<c r="A2"/>')), "WORKBOOK_INVALID"), (book(HEADER, relation="worksheets/none.xml"), "WORKBOOK_INVALID"),
        (book(HEADER + row('<c r="A2" n:r="B2" xmlns:n="n"/>')), "WORKBOOK_UNSAFE"), (book(HEADER, extra=[("xl/more.xml", b"<a>")]), "WORKBOOK_UNSAFE"),
        (book(HEADER, extra=[("xl/more.xml", "<a/>".encode("utf-16"))]), "WORKBOOK_UNSAFE"), (book(HEADER, extra=[("xl/more.xml", b"<a>" * 65 + b"</a>" * 65)]), "TABULAR_LIMIT_EXCEEDED"),
        (book(HEADER, extra=[("xl/more.rels", b'<Relationships><Relationship Id="a" Target="m.xml" TargetMode="External"/></Relationships>')]), "WORKBOOK_UNSAFE"),
        (packed([("a", "", HEADER)] * 65, "<si><t>a</t></si>"), "TABULAR_LIMIT_EXCEEDED"),
        (packed([("a", "", row('<c r="A2" t="inlineStr"><is><t>\u2003</t></is></c>'))]), "WORKBOOK_INVALID"),
    ]
    got = sheets.read_sheets(source(spark, [c for c, _ in cases]))
    assert {r["path"]: r["issue"] for r in got.collect()} == {f"f{i}": code for i, (_, code) in enumerate(cases)}
    assert {len(r["cells"] or []) for r in got.filter("issue IS NOT NULL").collect()} == {0}
    # Files of one path stay apart, and a frame without files has no rows.
    same = spark.createDataFrame([("p", bytearray(book(HEADER))), ("p", bytearray(book(HEADER))), (None, bytearray(b"x"))], "path string, content binary")
    assert sorted((r["path"] or "", r["issue"] or "") for r in sheets.read_sheets(same).collect()) == [("", "WORKBOOK_INVALID"), ("p", ""), ("p", "")]
    assert sheets.read_sheets(same.limit(0)).count() == 0


def city(version="2.04", amount="1234.5", number="12", more="", prefix="", namespace=invoices.CITY):
    p = f"{prefix}:" if prefix else ""
    at = f"xmlns:{prefix}" if prefix else "xmlns"
    body = f"<{p}InfNfse><{p}Numero>{number}</{p}Numero><{p}DataEmissao>2024-08-22T10:00:00-03:00</{p}DataEmissao><{p}DeclaracaoPrestacaoServico><{p}InfDeclaracaoPrestacaoServico><{p}Servico><{p}Valores><{p}ValorServicos>{amount}</{p}ValorServicos></{p}Valores></{p}Servico></{p}InfDeclaracaoPrestacaoServico></{p}DeclaracaoPrestacaoServico></{p}InfNfse>"
    return f'<{p}CompNfse {at}="{namespace}"><{p}Nfse versao="{version}">{body}</{p}Nfse>{more}</{p}CompNfse>'.encode()


def nation(version="1.01", state="100"):
    return f'<NFSe xmlns="{invoices.NATION}" versao="{version}"><infNFSe><nNFSe>9</nNFSe><cStat>{state}</cStat><dhProc>2024-02-29T00:00:00Z</dhProc><DPS versao="1.00"><infDPS><valores><vServPrest><vServ>007.10</vServ></vServPrest></valores></infDPS></DPS></infNFSe></NFSe>'.encode()


def test_invoices(spark):
    contents = [city(), city(prefix="n"), nation(), city("1.00"), city(amount="1.234"), city(namespace="x"), city(more="<NfseCancelamento/>"), nation(state="101"), b"<a", b"", city().replace(b"2024-08-22", b"2024-02-30"), None]
    got = {r["path"]: tuple(r)[1:] for r in invoices.read_notes(source(spark, contents)).collect()}
    assert got["f0"] == got["f1"] == ("12", "2024-08-22", "1234.50", "ABRASF 2.04", None)
    assert got["f2"] == ("9", "2024-02-29", "7.10", "NFS-e nacional 1.01", None)
    more = [
        (city().replace(b"<CompNfse", b"<?xml version='1.0' encoding='latin-1'?><CompNfse"), "INVALID"), (b"\xff", "INVALID"), (b"x" * (invoices.BUDGET.source_bytes + 1), "TOO_LARGE"),
        (city().replace(b"<Numero>12</Numero>", b"<Numero>12</Numero><Numero>13</Numero>"), "INVALID"), (city().replace(b"<Numero>12</Numero>", b"<Numero><b>12</b></Numero>"), "INVALID"),
        # A second way to a value, even one that leads nowhere.
        (city().replace(b"<Servico>", b"<Servico/><Servico>"), "INVALID"), (city(more="<Nfse/>"), "INVALID"), (city(more="<x><subst/></x>"), "CANCELLED_OR_REPLACED"),
        (city(more="<NfseCancelamento>"), "INVALID"), (city(more="<Numero xmlns='y'>1</Numero>"), None), (b"\xef\xbb\xbf" + city(number=" 0012\n"), None),
        (nation().replace(b'DPS versao="1.00"', b'DPS versao="2.00"'), "INVALID"), (city().replace(b"2024-08-22", b"1899-12-31"), "INVALID"), (b"<a/>", "INVALID"),
    ]
    issues = {r["path"]: r["issue"] for r in invoices.read_notes(source(spark, [c for c, _ in more])).collect()}
    assert issues == {f"f{i}": code for i, (_, code) in enumerate(more)}
    assert {p: v[-1] for p, v in got.items() if v[-1]} == {"f3": "INVALID", "f4": "INVALID", "f5": "INVALID", "f6": "CANCELLED_OR_REPLACED", "f7": "INVALID", "f8": "INVALID", "f9": "TOO_LARGE", "f10": "INVALID", "f11": "TOO_LARGE"}


def test_suggestions(spark):
    rows = [
        (1, 0, "Número da NFS-e: 007\nData de emissão\n22/08/2024\r\nValor total da nota: R$ 1.234,50"),
        (2, 0, "Numero da nota 1\nvalor bruto 5"),
        (2, 1, "Numero da nota 2\nData emissao 2024-02-30"),
        (3, 0, "Data de emissao 01-02-2024"), (3, 1, "data de emissão: 02/02/2024"),
        (4, 0, None),
    ]
    got = {(r["doc"], r["field"]): (r["value"], r["verdict"]) for r in pages.suggestions(spark.createDataFrame(rows, "doc int, page int, text string")).collect()}
    assert [got[1, f] for f in ("number", "date", "amount")] == [("007", "suggested"), ("2024-08-22", "suggested"), ("1234.50", "suggested")]
    assert {got[2, f] for f in ("number", "date", "amount")} == {(None, "several_notes")}
    assert got[3, "date"] == (None, "conflicting") and got[3, "number"] == (None, "absent")
    assert got[4, "amount"] == (None, "absent") and len(got) == 12


def test_certain_lines(spark):
    words = [(1, 1, 1, 1, 1, 1, 95.0, "Valor"), (1, 1, 1, 1, 1, 2, 91.0, " bruto "), (1, 1, 1, 1, 2, 1, 89.0, "x"), (1, 1, 1, 1, 2, 2, 99.0, "y"), (1, 1, 1, 1, 3, 1, None, "z")]
    got = pages.certain_lines(spark.createDataFrame(words, "doc int, page int, block int, par int, line int, word int, conf double, text string")).collect()
    assert [(r["line"], r["text"]) for r in got] == [(1, "Valor bruto")]


def plain_csv(content: bytes, delimiter: str, quote: bool, bom: bool, multiline: bool, budget):
    """(locator, cells) of each record, the header first; the locator is the record's first physical line."""
    if delimiter not in delimited.DELIMITERS:
        raise delimited.Refused("CSV_OPTIONS_UNSUPPORTED")
    if len(content) > min(budget.source_bytes, budget.expanded_bytes):
        raise delimited.Refused("TABULAR_LIMIT_EXCEEDED")
    if content.startswith(b"\xef\xbb\xbf") != bom:
        raise delimited.Refused("CSV_OPTIONS_UNSUPPORTED")
    try:
        text = content.decode("utf-8-sig" if bom else "utf-8")
    except UnicodeDecodeError:
        raise delimited.Refused("CSV_OPTIONS_UNSUPPORTED") from None
    if "\0" in text:
        raise delimited.Refused("CSV_MALFORMED")
    d = re.escape(delimiter)
    end = rf"({d}|\r\n|\n|\r|\Z)"
    # A cell is quoted as a whole or holds no quote at all; anything else has no match.
    cell = re.compile(rf'(?:"((?:[^"]++|"")*+)"[^\S\r\n{d}]*+|([^"\r\n{d}]*+)){end}' if quote else rf"()([^\r\n{d}]*+){end}")
    line, first, start, at, record = 1, 1, 0, 0, []
    while at < len(text) or record:
        found = cell.match(text, at)
        if found is None:
            raise delimited.Refused("CSV_MALFORMED")
        inner, plain, stop = found.groups()
        value = plain if plain is not None else inner.replace('""', '"')
        if plain is None and ("\n" in value or "\r" in value):
            if not multiline:
                raise delimited.Refused("CSV_MALFORMED")
            value = value.replace("\r\n", "\n")
            line += value.count("\n") + value.count("\r")
        record.append(value)
        at = found.end()
        if stop == delimiter:
            continue
        if len(text[start:at].encode()) > budget.record_bytes:
            raise delimited.Refused("TABULAR_LIMIT_EXCEEDED")
        yield f"row:{first}", record
        line += 1
        record, first, start = [], line, at


@pytest.mark.parametrize(("delimiter", "quote", "bom", "multiline"), [(",", True, False, True), (",", True, False, False), ("\t", True, True, True), ("|", False, False, False)])
def test_strict_text_against_a_plain_parser(spark, delimiter, quote, bom, multiline):
    rng = random.Random(delimiter)
    pool = ["a", "é", " ", '"', '""', '"x"', '"p{d}q"', '"l\n"', '"l\r\nm"', "{d}", "\n", "\r\n", "\r", "\u2003", '"" '.strip(), "long long"]
    contents = [None, b"", b"\xef\xbb\xbf", b"\xff\n", b"a\0", b"a\nb", b"a\n" + b"x" * 40, '"h"\n"é{d}1"\u2003\n'.replace("{d}", delimiter).encode()]
    for _ in range(500):
        text = "h" + "".join(rng.choice(pool if rng.random() < 0.5 else pool[:1] + pool[5:14]) for _ in range(rng.randrange(12))).replace("{d}", delimiter)
        contents.append((b"\xef\xbb\xbf" if bom and rng.random() < 0.9 else b"") + text.encode())
    # Cells joined by delimiters and lines: most of these are well formed.
    good = ["a", "é ", '"x"', '"p{d}q"', '"a""b" ', '"l\n\rm"', '"l\r\nm"', "", "b"]
    for _ in range(500):
        lines = [delimiter.join(rng.choice(good).replace("{d}", delimiter) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 5))]
        contents.append((b"\xef\xbb\xbf" if bom else b"") + rng.choice(["\n", "\r\n", "\r"]).join(["h", *lines]).encode())
    budget = delimited.Budget(rows=6, cell_chars=8, columns=3, record_bytes=24)
    want = {}
    for i, content in enumerate(contents):
        try:
            records = list(plain_csv(content or b"", delimiter, quote, bom, multiline, budget))
            if len(records) > budget.rows + 1 or any(len(r) > budget.columns or any(len(c) > budget.cell_chars for c in r) for _, r in records):
                raise delimited.Refused("TABULAR_LIMIT_EXCEEDED")
            if not records or any(not c.strip() for c in records[0][1]):
                raise delimited.Refused("CSV_MALFORMED")
            want[i] = [(n, *r) for n, r in enumerate(records)]
        except delimited.Refused as refused:
            want[i] = refused.code
    got = {}
    df = spark.createDataFrame(list(enumerate(contents)), "path int, content binary")
    for r in delimited.read_strict(df, delimiter, quote, bom, multiline, budget).orderBy("path", "row").collect():
        if r["issue"]:
            got[r["path"]] = r["issue"]
        else:
            got.setdefault(r["path"], []).append((r["row"], r["locator"], r["cells"]))
    assert {str(w) if isinstance(w, str) else "rows" for w in want.values()} == {"rows", "CSV_MALFORMED", "CSV_OPTIONS_UNSUPPORTED", "TABULAR_LIMIT_EXCEEDED"}
    for i, content in enumerate(contents):
        assert got[i] == want[i], content


WORDS = "doc int, page int, block int, par int, line int, word int, left double, top double, width double, height double, conf double, text string"


def plain_page(words):
    """A page's text by its definition, line after line."""
    out, before, lines = "", None, {}
    for w in sorted(words):
        lines.setdefault(w[:3], []).append(w)
    for key, line in lines.items():
        if any(w[8] is None or w[8] != w[8] or w[8] < 90 or not (w[9] or "").strip() for w in line):
            out, before = out + "\n\n", None
            continue
        text, end = "", line[0][4]
        for *_, left, _, width, height, _, t in line:
            gap = left - end
            text += (("\n\n" if gap > max(24, 3 * height) or gap < -height else " ") if text else "") + t.strip()
            end = left + width
        _, _, _, _, left, top, _, height = line[0][:8]
        near = before and before[0] == key[:2] and abs(left - before[1]) <= max(12, height) and abs(top - before[2]) <= max(height, before[3]) * 2.5
        out += (("\n" if near else "\n\n") if out else "") + text
        before = key[:2], left, top, height
    return out


def test_page_texts(spark):
    one = lambda line, text, conf, word=1, left=0.0, block=1, top=None: (block, 1, line, word, left, line * 10.0 if top is None else top, 100.0, 10.0, conf, text)
    cases = {
        "uncertain": ([one(1, "Numero da NFS-e:", 96.0), one(2, "98/654321", 89.0), one(3, "123", 97.0)], "Numero da NFS-e:\n\n\n\n123"),
        "near": ([one(1, "Numero da nota:", 96.0), one(2, "7", 97.0)], "Numero da nota:\n7"),
        "column": ([one(1, "Numero", 96.0), one(1, "da", 96.0, 2, 130.0), one(1, "Valor", 96.0, 3, 261.0), one(1, "back", 96.0, 4, 340.0)], "Numero da\n\nValor\n\nback"),
        "aside": ([one(1, "a", 96.0), one(2, "b", 96.0, left=13.0), one(3, "c", 96.0, left=13.0, top=46.0)], "a\n\nb\n\nc"),
        "block": ([one(1, "a", 96.0), one(2, "b", 96.0, block=2)], "a\n\nb"),
        "first": ([one(1, " ", 96.0), one(2, "b", None), one(3, "c", float("nan")), one(4, "d", 90.0)], "\n\n\n\n\n\n\n\nd"),
    }
    rng = random.Random(11)
    for i in range(40):
        words = [(rng.randrange(2), rng.randrange(2), line, w, w * 60.0 + rng.choice([0, 0, 30, -20]), line * rng.choice([10.0, 25.0]), 50.0, rng.choice([8.0, 12.0]), rng.choice([95.0, 95.0, 95.0, 95.0, 20.0]), rng.choice(["x", "yy", " z "])) for line in range(8) for w in range(3)]
        words = [w for w in words if rng.random() < 0.9]
        cases[i] = words, plain_page(words)
    rows = [(n, 0, *w) for n, (words, _) in enumerate(cases.values()) for w in words]
    rng.shuffle(rows)
    got = {r["doc"]: r["text"] for r in pages.page_texts(spark.createDataFrame(rows, WORDS)).collect()}
    for n, (name, (words, want)) in enumerate(cases.items()):
        assert plain_page(words) == want and got[n] == want, name


def test_values_beside_an_uncertain_line_are_not_suggested(spark):
    rows = [(d, 0, 1, 1, i, 1, 0.0, i * 10.0, 100.0, 10.0, c, t) for d, conf in ((1, 89.0), (2, 95.0)) for i, c, t in ((1, 96.0, "Numero da NFS-e:"), (2, conf, "98/654321"), (3, 97.0, "123"))]
    got = {(r["doc"], r["field"]): (r["value"], r["verdict"]) for r in pages.suggestions(pages.page_texts(spark.createDataFrame(rows, WORDS))).collect()}
    assert got[1, "number"] == (None, "unsafe") and got[2, "number"] == ("98/654321", "suggested")


def test_contract_csv(spark, tmp_path):
    import hashlib

    data = "﻿a;b\n1;x\n2;\n".encode()
    (tmp_path / "in.csv").write_bytes(data)
    path = str(tmp_path / "in.csv")
    ok = files.contract_csv(spark, path, ["a", "b"], ";", 2, hashlib.sha256(data).hexdigest())
    assert [tuple(r) for r in ok.collect()] == [("1", "x"), ("2", None)]
    for wrong in ({"columns": ["a", "c"]}, {"columns": ["a", "b"], "rows": 3}, {"columns": ["a", "b"], "sha256": "0" * 64}):
        with pytest.raises(files.ContractError):
            files.contract_csv(spark, path, sep=";", **wrong)


def test_tables_and_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k int, v string")
    path = str(tmp_path / "t")
    assert files.append_new(rows, path, ["k"]).count() == 2
    assert files.append_new(rows, path, ["k"]).count() == 0
    assert files.append_new(rows.selectExpr("k + 1 AS k", "v"), path, ["k"]).count() == 1
    root = str(tmp_path / "s")
    files.write_snapshot(rows, root, 1)
    files.write_snapshot(rows.limit(1), root, 2)
    assert files.read_snapshot(spark, root)[1] == 2 and files.read_snapshot(spark, root, 1)[0].count() == 3
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_snapshot(rows, root, 2)
    again = rows.orderBy(F.desc("k"))
    assert files.backup_catalog(t=rows, u=rows.limit(0)).collect() == files.backup_catalog(t=again, u=rows.limit(0)).collect()
    out = str(tmp_path / "e")
    files.export_csv(spark.createDataFrame([(2, "=x"), (1, 'q"')], "k int, v string"), out, ["k", "v"], ["k"], plain=("k",))
    text = "".join(p.read_text(newline="") for p in sorted((tmp_path / "e").glob("part-*.csv")))
    assert [line for line in text.split("\r\n") if line and line != '"k";"v"'] == ['"1";"q"""', "\"2\";\"'=x\""]


def test_verified_and_catalog(spark):
    held = spark.createDataFrame([("a", 2, bytearray(b"hi")), ("b", 2, bytearray(b"ho")), ("c", 1, bytearray(b"x"))], "path string, length long, content binary")
    sha = "8f434346648f6b96df89dda901c5176b10a6d83961dd3c1ac88b59b2dc327aa4"
    catalog = spark.createDataFrame([("a", 2, sha), ("b", 2, sha), ("c", 2, sha)], "path string, bytes long, sha256 string")
    assert {r["path"]: r["issue"] for r in files.verified(held, catalog).collect()} == {"a": None, "b": "hash", "c": "size"}
    reserved = spark.createDataFrame([("x", 1), ("y", 9), ("z", 1)], "object_key string, expires_at int")
    objects = spark.createDataFrame([("z",), ("w",)], "object_key string")
    assert {(r[0], r[1]) for r in files.catalog_issues(reserved, objects, F.lit(5)).collect()} == {("x", "expired"), ("w", "orphan")}


def test_cells_hold_their_texts(spark):
    """An outermost cell is one row with the first texts inside it; values are no rows of their own, formulas are."""
    from tessera.sources import xmls

    text = b"<s><row><c r='A1'><f>1</f><v>a</v><v>b</v><is><r><t>x</t></r><t>y</t></is><c><v>z</v></c></c><c/></row><v>out</v></s>"
    found = xmls.elements(spark.createDataFrame([("p", bytearray(text), None)], "part string, content binary, issue string"), texts=("c", "v", "is"), whole_of="c")
    rows = [(r["name"], r["whole"], r["inner"]) for r in found.collect()]
    assert [r for r in rows if r[0] == "c"] == [("c", "1abxyz", {"v": "a", "is": "xy", "c": "z"}), ("c", "", {})]
    assert [r[1] for r in rows if r[0] == "v"] == ["out"]
    assert [r[0] for r in rows if r[0] == "f"] == ["f"]


def test_files_are_dealt_to_all_tasks(spark):
    """Whatever their bytes: adaptive execution doesn't put them together."""
    from tessera.plans import ingest

    dealt = ingest.dealt(spark.range(100), F.col("id")).withColumn("at", F.spark_partition_id())
    assert dealt.select("at").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
