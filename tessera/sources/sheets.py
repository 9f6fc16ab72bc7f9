"""Workbooks read passively: no formula is run, no relation leaves the file, archives are checked before they expand."""

from __future__ import annotations

import re
import zipfile
from functools import reduce
from io import BytesIO

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.delimited import Budget, Refused
from tessera.sources.xmls import above, ambiguous, attribute, elements
from tessera.storage import written

#: Entries of archives that mean active content or links.
ACTIVE = re.compile(r"vbaProject\.bin|embeddings/|activeX/|externalLinks/|macrosheets/|connections\.xml$", re.IGNORECASE)
#: Numbers of built-in date formats, the last day and the last row of a sheet, the form of a cell's place.
DATE_FORMATS = (*range(14, 23), *range(45, 48))
LAST_SERIAL, LAST_ROW = 2_958_465, 1_048_576
PLACE = "^([A-Za-z]+)([1-9][0-9]*)$"
#: Parts of a workbook.
BOOK, RELATIONS, STRINGS, STYLES = "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/sharedStrings.xml", "xl/styles.xml"


def entries(content: bytes, budget: Budget) -> dict[str, bytes]:
    """The archive's XML files by name, after every guard."""
    if content[:4] == b"\xd0\xcf\x11\xe0":
        raise Refused("XLS_BINARY_UNSUPPORTED")
    if len(content) > budget.source_bytes:
        raise Refused("TABULAR_LIMIT_EXCEEDED")
    if content[:2] != b"PK":
        raise Refused("WORKBOOK_INVALID")
    try:
        archive = zipfile.ZipFile(BytesIO(content))
    except (zipfile.BadZipFile, ValueError, OSError):
        raise Refused("WORKBOOK_UNSAFE") from None
    infos = archive.infolist()
    names = [i.filename for i in infos]
    parts = [p for n in names for p in n.removesuffix("/").split("/")]
    unsafe = len(set(names)) < len(names) or any(p in ("", ".", "..") for p in parts) or any(c in n for n in names for c in "\\:\0") or any(ACTIVE.search(n) for n in names)
    if unsafe or any(i.flag_bits & 1 or (i.external_attr >> 16) & 0xF000 == 0xA000 for i in infos):
        raise Refused("WORKBOOK_UNSAFE")
    if len(infos) > budget.entries or sum(i.file_size for i in infos) > budget.expanded_bytes or any(i.file_size > budget.ratio * i.compress_size for i in infos):
        raise Refused("TABULAR_LIMIT_EXCEEDED")
    try:
        # All are read, as reading is what checks a file against its sum.
        read = {i.filename: archive.read(i) for i in infos if not i.is_dir()}
    except (zipfile.BadZipFile, RuntimeError, OSError, NotImplementedError, EOFError):
        raise Refused("WORKBOOK_UNSAFE") from None
    return {name: data for name, data in read.items() if name.endswith((".xml", ".rels"))}


def unzipped(files: DataFrame, budget: Budget) -> DataFrame:
    """(file, path, sha, part, content, issue): the XML parts of each of ``files`` (path, content), or one row with the issue."""

    def read(batches):
        for batch in batches:
            for file, path, sha, content in zip(batch["file"], batch["path"], batch["sha"], batch["content"]):
                try:
                    out = [(file, path, sha, name, data, None) for name, data in entries(bytes(content or b""), budget).items()]
                    # An archive without any XML is still a file.
                    out = out or [(file, path, sha, None, None, "WORKBOOK_INVALID")]
                except Refused as refused:
                    out = [(file, path, sha, None, None, refused.code)]
                yield from (pd.DataFrame([row], columns=["file", "path", "sha", "part", "content", "issue"]) for row in out)

    given = files.select(F.monotonically_increasing_id().alias("file"), "path", F.sha2(F.coalesce("content", F.lit(b"")), 256).alias("sha"), "content")
    return given.mapInPandas(read, "file long, path string, sha string, part string, content binary, issue string")


def serial_date(serial: Column, base_1904: Column) -> Column:
    """The day of a serial; day 60 of the 1900 base never was."""
    day = F.when(base_1904, F.date_add(F.lit("1904-01-01").cast("date"), serial)).when(serial != 60, F.date_add(F.lit("1899-12-31").cast("date"), serial - F.when(serial > 60, 1).otherwise(0)))
    return F.when(serial.between(0, LAST_SERIAL), day).cast("string")


def _date_styles(found: DataFrame) -> DataFrame:
    """(file, style) of the cell styles that show a date."""
    styles = found.filter(F.col("part") == STYLES)
    first = styles.filter("name = 'cellXfs'").groupBy("file").agg(F.min("node").alias("_forms"))
    number = attribute("numFmtId").try_cast("int").alias("format")
    code = F.regexp_replace(attribute("formatCode"), r'"[^"]*"|\[[^\]]*\]|\\.', "")
    custom = styles.filter("name = 'numFmt'").groupBy("file", number).agg(F.max_by(code, "node").alias("code"))
    forms = styles.filter("size(places) > 1").join(first, "file").filter(F.get("places", F.size("places") - 2) == F.col("_forms"))
    # A workbook has few styles: one task a workbook numbers them.
    numbered = forms.select("file", F.coalesce(number, F.lit(0)).alias("format"), (F.row_number().over(Window.partitionBy("file").orderBy("node")) - 1).alias("style"))
    shown = F.col("format").isin(*DATE_FORMATS) | F.coalesce(F.col("code").rlike("(?i)[ymdhs]"), F.lit(False))
    return numbered.join(custom, ["file", "format"], "left").filter(shown).select("file", "style")


def _counted(given: Column, window) -> Column:
    """Numbers given by some rows of a window; the others count on from the last one given (from 1 before the first)."""
    row = F.row_number().over(window)
    at = F.last(F.when(given.isNotNull(), F.struct(given.alias("n"), row.alias("row"))), ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(at["n"] + row - at["row"], row)


def _sheet_list(found: DataFrame) -> DataFrame:
    """(file, ordinal, node, part, sheet, visible) of the sheets that workbooks name; part is null where there is none."""
    sheets = found.filter((F.col("part") == BOOK) & (F.col("name") == "sheet"))
    targets = found.filter((F.col("part") == RELATIONS) & (F.col("name") == "Relationship")).groupBy("file", attribute("Id").alias("_id")).agg(F.max(attribute("Target")).alias("_target"))
    place = F.regexp_replace("_target", r"^\./", "")
    parts = found.filter("node = 1").select("file", F.col("part").alias("_there"))
    ordinal = F.row_number().over(Window.partitionBy("file").orderBy("node")) - 1
    named = sheets.select("file", "node", ordinal.alias("ordinal"), attribute("id").alias("_id"), attribute("name").alias("_name"), (~attribute("state").isin("hidden", "veryHidden")).alias("visible"))
    name = F.substring(F.when(F.col("_name") == "", F.concat(F.lit("Aba "), (F.col("ordinal") + 1).cast("string"))).otherwise(F.col("_name")), 1, 120)
    aimed = named.join(targets, ["file", "_id"], "left").withColumn("_there", F.when(F.startswith(place, F.lit("xl/")), place).otherwise(F.concat(F.lit("xl/"), place)))
    return aimed.join(parts.withColumn("part", F.col("_there")), ["file", "_there"], "left").select("file", "ordinal", "node", "part", name.alias("sheet"), "visible")


def _rows(inside: DataFrame) -> DataFrame:
    """(file, part, row_node, row, number, fault) of the rows of sheets; row counts from 0."""
    window = Window.partitionBy("file", "part").orderBy("node")
    given = attribute("r")
    number = _counted(F.when(given != "", F.coalesce(given.try_cast("long"), F.lit(0))), window)
    rows = inside.filter("name = 'row'").select("file", "part", F.col("node"), (F.row_number().over(window) - 1).alias("row"), number.alias("number"), (given.rlike("^[0-9]*$") & ~ambiguous("r")).alias("_right"))
    right = F.col("_right") & (F.col("number") > F.coalesce(F.lag("number").over(window), F.lit(0))) & (F.col("number") <= LAST_ROW)
    return rows.select("file", "part", F.col("node").alias("row_node"), "row", "number", F.when(~right, "WORKBOOK_INVALID").alias("fault"))


def _cells(found: DataFrame, inside: DataFrame, rows: DataFrame, budget: Budget) -> DataFrame:
    """(file, part, row_node, node, at, value, fault) of the cells of sheets; at counts columns from 0."""
    # An outermost cell holds its first value and its first text inline, or all its text.
    cell = inside.filter("name = 'c'").select("*", above("row").alias("row_node")).filter((F.col("node") == above("c")) & (F.col("node") > F.col("row_node")))
    whole = cell.select("file", "part", "row_node", "node", "attributes", F.col("whole").alias("_c"), F.col("inner")["v"].alias("_v"), F.col("inner")["is"].alias("_is"))
    kind, place = attribute("t"), attribute("r")
    raw = F.coalesce(F.when(kind == "inlineStr", F.col("_is")).otherwise(F.col("_v")), F.col("_c"))
    letters, digits = F.regexp_extract("_place", PLACE, 1), F.regexp_extract("_place", PLACE, 2)
    # More letters than a sheet of any width has are simply far to the right.
    letter = lambda n, c: n * 26 + F.ascii(c) - 64
    given = F.when(letters == "", None).when(F.length(letters) > 4, F.lit(10**6)).otherwise(F.reduce(F.split(F.upper(letters), ""), F.lit(0), letter))
    unsure = ambiguous("r", "t", "s")
    read = whole.select("file", "part", "row_node", "node", kind.alias("kind"), place.alias("_place"), raw.alias("raw"), F.when(attribute("s") == "", 0).otherwise(attribute("s").try_cast("int")).alias("style"), unsure.alias("_unsure"))
    at = _counted(given, Window.partitionBy("file", "part", "row_node").orderBy("node")) - 1
    placed = read.withColumns({"at": at, "_digits": digits}).join(rows.select("file", "part", "row_node", "number"), ["file", "part", "row_node"])
    strings = found.filter((F.col("part") == STRINGS) & (F.col("name") == "si"))
    strings = strings.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("node")) - 1).alias("_string"), F.col("whole").alias("_shared"))
    string = F.when((F.col("kind") == "s") & F.col("raw").rlike("^[0-9]{1,9}$"), F.col("raw").cast("int"))
    old = found.filter((F.col("part") == BOOK) & (F.col("name") == "workbookPr") & attribute("date1904").isin("1", "true")).select("file").distinct().withColumn("_1904", F.lit(True))
    joined = placed.withColumn("_string", string).join(strings, ["file", "_string"], "left").join(_date_styles(found).withColumn("_date", F.lit(True)).join(old, "file", "left"), ["file", "style"], "left")
    serial = F.when(F.col("raw").rlike(r"^[0-9]{1,9}(\.0+)?$"), F.substring_index("raw", ".", 1).cast("int"))
    day = F.when(F.col("_date") & F.col("kind").isin("", "n"), serial_date(serial, F.coalesce("_1904", F.lit(False))))
    value = F.when(F.col("kind") == "s", F.col("_shared")).when(F.col("kind") == "b", F.when(F.col("raw") == "1", "true").otherwise("false")).otherwise(F.coalesce(day, "raw"))
    again = F.row_number().over(Window.partitionBy("file", "part", "row_node", "at").orderBy("node")) > 1
    valued = joined.select("file", "part", "row_node", "node", "kind", "number", "at", "_place", "_digits", "_unsure", value.alias("value"))
    fault = (
        F.when(F.col("_unsure"), "WORKBOOK_UNSAFE")
        .when((F.col("_place") != "") & ~F.coalesce(F.col("_digits").try_cast("long") == F.col("number"), F.lit(False)), "WORKBOOK_INVALID")
        .when(~F.col("at").between(0, budget.columns - 1), "TABULAR_LIMIT_EXCEEDED")
        .when(F.col("value").isNull(), "WORKBOOK_INVALID")
        .when(again, "WORKBOOK_INVALID")
        .when(F.length("value") > budget.cell_chars, "TABULAR_LIMIT_EXCEEDED")
    )
    return valued.select("file", "part", "row_node", "node", "at", "value", fault.alias("fault"))


def _book_faults(found: DataFrame, sheets: DataFrame, budget: Budget) -> DataFrame:
    """(file, rank, at, code) of what is wrong with a workbook as a whole."""
    target = attribute("Target")
    outside = (target == "") | F.contains(target, F.lit("..")) | F.contains(target, F.lit("\\")) | target.rlike(r"(?i)^(/|[a-z][a-z0-9+.-]*:)") | (attribute("TargetMode") == "External") | ambiguous("Id", "Target", "TargetMode")
    relation = F.col("name") == "Relationship"
    named = (F.col("part") == BOOK) & F.col("name").isin("sheet", "workbookPr") & ambiguous("name", "state", "id", "date1904")
    marks = found.groupBy("file").agg(
        F.min(F.when(F.col("issue").isNotNull(), F.struct(F.coalesce("part", F.lit("")), "issue"))).alias("_issue"),
        (F.count_if((F.col("part") == BOOK) & (F.col("node") == 1)) * F.count_if((F.col("part") == RELATIONS) & (F.col("node") == 1)) == 0).alias("_bare"),
        F.bool_or((F.col("name") == "f") | relation & outside | named).alias("_unsafe"),
    )
    ids = found.filter(relation & (F.col("part") == RELATIONS)).groupBy("file", attribute("Id").alias("_id")).count().filter("count > 1").select("file").distinct()
    sizes = sheets.groupBy("file").agg(F.count("*").alias("_n"))
    fault = lambda rank, code: (F.lit(rank).alias("rank"), F.lit(0).cast("long").alias("at"), (F.lit(code) if isinstance(code, str) else code).alias("code"))
    all_files = marks.join(sizes, "file", "left")
    faults = [
        marks.filter("_issue IS NOT NULL").select("file", *fault(0, F.col("_issue.issue"))),
        marks.filter("_bare").select("file", *fault(1, "WORKBOOK_INVALID")),
        marks.filter("_unsafe").select("file", *fault(2, "WORKBOOK_UNSAFE")),
        ids.select("file", *fault(3, "WORKBOOK_UNSAFE")),
        all_files.filter("_n IS NULL").select("file", *fault(4, "WORKBOOK_INVALID")),
        all_files.filter(F.col("_n") > budget.sheets).select("file", *fault(5, "TABULAR_LIMIT_EXCEEDED")),
    ]
    return reduce(DataFrame.unionByName, faults)


def read_sheets(files: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """Rows of all sheets of ``files`` (path, content); row 0 is the header; a refused file is one row with its issue.

    (path, sheet_id, sheet, ordinal, visible, row, locator, cells, issue). A task unzips a file and turns its parts into
    elements, which are written once; sheets, rows, cells, styles and shared strings are joins and windows over them. The
    first fault counts: of the archive, of its XML, of the workbook, then of its sheets in their order. Null or empty content
    is no workbook. Files of one path stay apart; the frame reads a table in the shared folder, which stays for it.
    """
    found = written(elements(unzipped(files, budget), budget, texts=("c", "v", "is", "si"), whole_of="c"), "elements")
    sheets = written(_sheet_list(found), "sheets")
    inside = found.join(sheets.filter("part IS NOT NULL").select("file", "part").distinct(), ["file", "part"], "left_semi")
    rows = _rows(inside)
    cells = written(_cells(found, inside, rows, budget), "cells")
    held = cells.filter("fault IS NULL").groupBy("file", "part", "row_node").agg(F.map_from_entries(F.collect_list(F.struct("at", "value"))).alias("_cells"), (F.max("at") + 1).alias("_size"))
    # A row's cells are at most as many as the budget's columns.
    table = written(rows.join(held, ["file", "part", "row_node"], "left").withColumn("_size", F.coalesce("_size", F.lit(0))), "rows")
    widths = table.groupBy("file", "part").agg(F.max(F.when(F.col("row") == 0, F.col("_size"))).alias("width"), F.max("_size").alias("_widest"), F.count("*").alias("_n"), F.min_by("_cells", "row").alias("_header"))
    blank = F.exists(F.sequence(F.lit(0), F.greatest("width", F.lit(1)) - 1), lambda i: F.regexp_replace(F.coalesce(F.get(F.array("_header"), F.lit(0))[i], F.lit("")), r"(?U)[\s\x1c-\x1f]+", "") == "")
    after = F.when(F.col("_n") > budget.rows + 1, "TABULAR_LIMIT_EXCEEDED").when(F.col("_widest") > F.col("width"), "WORKBOOK_INVALID").when((F.col("width") == 0) | blank, "WORKBOOK_INVALID")
    ends = F.lit(2**31)
    in_part = cells.select("file", "part", F.col("node").cast("long").alias("at"), "fault").unionByName(table.select("file", "part", F.col("row_node").cast("long").alias("at"), "fault")).unionByName(widths.select("file", "part", ends.alias("at"), after.alias("fault"))).filter("fault IS NOT NULL")
    # Sheets without part, or without rows, are faults of their own.
    empty = sheets.join(widths.select("file", "part"), ["file", "part"], "left_anti").select("file", (F.lit(6) + F.col("ordinal")).alias("rank"), F.lit(0).cast("long").alias("at"), F.lit("WORKBOOK_INVALID").alias("code"))
    in_sheet = sheets.join(in_part.groupBy("file", "part").agg(F.min(F.struct("at", "fault")).alias("_f")), ["file", "part"]).select("file", (F.lit(6) + F.col("ordinal")).alias("rank"), F.col("_f.at").alias("at"), F.col("_f.fault").alias("code"))
    faults = _book_faults(found, sheets, budget).unionByName(empty).unionByName(in_sheet)
    issues = faults.groupBy("file").agg(F.min_by("code", F.struct("rank", "at")).alias("issue"))
    names = found.groupBy("file", "path", "sha").agg(F.lit(1).alias("_")).drop("_")
    judged = names.join(issues, "file", "left")
    padded = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.col("_cells")[i], F.lit("")))
    good = judged.filter("issue IS NULL").join(sheets, "file").join(table.drop("fault"), ["file", "part"]).join(widths.select("file", "part", "width"), ["file", "part"])
    sheet_id = F.concat(F.lit("sheet-"), F.substring("sha", 1, 24), F.lit("-"), (F.col("ordinal") + 1).cast("string"))
    shown = good.select("path", sheet_id.alias("sheet_id"), "sheet", "ordinal", "visible", "row", F.concat(F.lit("row:"), F.col("number").cast("string")).alias("locator"), F.coalesce(padded, F.array_repeat(F.lit(""), F.col("width"))).alias("cells"), "issue")
    return shown.unionByName(judged.filter("issue IS NOT NULL").select("path", "issue"), allowMissingColumns=True)
