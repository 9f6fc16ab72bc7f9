"""Strict delimited text: what isn't well formed is refused whole, never repaired."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The delimiters of the contract.
DELIMITERS = (",", ";", "\t", "|")


@dataclass(frozen=True)
class Budget:
    """What one source may cost."""

    source_bytes: int = 50 * 2**20
    expanded_bytes: int = 64 * 2**20
    rows: int = 10_000
    columns: int = 256
    cell_chars: int = 10_000
    record_bytes: int = 2**20
    entries: int = 1_000
    ratio: int = 100
    sheets: int = 64
    xml_nodes: int = 3_000_000
    xml_depth: int = 64
    xml_attributes: int = 64


class Refused(ValueError):
    """A source that is refused, with a code."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


SCHEMA = "path string, row int, locator string, cells array<string>, issue string"


#: What ends a physical line; the blanks that may follow a closing quote.
END = r"(\r\n|\n|\r)"
BLANKS = r"(?U)[\s\x1c-\x1f&&[^\r\n]]+\z"
#: Marks of ends of records and cells: texts with NUL are refused, so none has them.
RECORD, CELL = "\0R", "\0C"


def _cells(raw: Column, quote: bool, multiline: bool) -> Column:
    """(value, breaks, bad) of cells, each quoted as a whole or without any quote.

    Step by step, as a lambda computes what it names anew at each use.
    """
    if not quote:
        return F.transform(raw, lambda c: F.struct(c.alias("value"), F.lit(0).alias("breaks"), F.lit(False).alias("bad")))
    whole = F.transform(raw, lambda c: F.struct(c.alias("raw"), F.when(F.startswith(c, F.lit('"')), F.regexp_replace(c, BLANKS, "")).alias("whole")))
    inner = F.transform(whole, lambda c: F.struct(c["raw"].alias("raw"), F.substring(c["whole"], F.lit(2), F.length(c["whole"]) - 2).alias("inner"), ((F.length(c["whole"]) >= 2) & F.endswith(c["whole"], F.lit('"'))).alias("closed")))
    value = F.transform(inner, lambda c: F.struct(
        F.when(c["inner"].isNull(), c["raw"]).otherwise(F.replace(F.replace(c["inner"], F.lit('""'), F.lit('"')), F.lit("\r\n"), F.lit("\n"))).alias("value"),
        F.when(c["inner"].isNull(), F.contains(c["raw"], F.lit('"'))).otherwise(~c["closed"] | F.contains(F.replace(c["inner"], F.lit('""'), F.lit("")), F.lit('"'))).alias("bad"),
    ))
    broken = F.transform(value, lambda c: F.struct(c["value"].alias("value"), (F.length(c["value"]) - F.length(F.translate(c["value"], "\r\n", ""))).alias("breaks"), c["bad"].alias("bad")))
    return broken if multiline else F.transform(broken, lambda c: F.struct(c["value"].alias("value"), c["breaks"].alias("breaks"), (c["bad"] | (c["breaks"] > 0)).alias("bad")))


def _records(opened: DataFrame, delimiter: str, quote: bool, multiline: bool) -> DataFrame:
    """``opened`` (path, early, text) with the records ``r`` of each text: (cells, breaks, bad, size in bytes).

    Every other stretch between quotes is outside of them; only there do delimiters and line ends part cells and records.
    """
    def marked(stretch, i):
        parted = F.replace(F.regexp_replace(stretch, END, "$1" + RECORD), F.lit(delimiter), F.lit(CELL))
        return F.when(i % 2 == 0, parted).otherwise(stretch)

    stretches = F.split("text", '"', -1) if quote else F.array("text")
    parted = opened.select("path", "early", F.split(F.array_join(F.transform(stretches, marked), '"'), r"\x00R", -1).alias("_f"))
    # Behind the last line end there is no record.
    found = parted.select("path", "early", F.when(F.element_at("_f", -1) == "", F.slice("_f", F.lit(1), F.size("_f") - 1)).otherwise(F.col("_f")).alias("_f"))

    def record(raw):
        cells = _cells(F.split(F.regexp_replace(raw, END + r"\z", ""), r"\x00C", -1), quote, multiline)
        return F.struct(cells.alias("cells"), F.octet_length(raw).alias("size"))

    def summed(r):
        breaks = F.aggregate(r["cells"], F.lit(0), lambda n, c: n + c["breaks"])
        return F.struct(F.transform(r["cells"], lambda c: c["value"]).alias("cells"), breaks.alias("breaks"), F.exists(r["cells"], lambda c: c["bad"]).alias("bad"), (r["size"] - F.size(r["cells"]) + 1).alias("size"))

    return found.select("path", "early", F.transform(F.transform("_f", record), summed).alias("r"))


def read_strict(files: DataFrame, delimiter: str = ",", quote: bool = True, bom: bool = False, multiline: bool = False, budget: Budget = Budget()) -> DataFrame:
    """(path, row, locator, cells, issue): row 0 is the header; a refused file is one row with its issue.

    ``files`` (path, content) is ``spark.read.format("binaryFile")``: each file is one row and within the budget. The
    locator is a record's first physical line. All of it is column expressions over the file's row: no Python, no shuffle.
    Null content is an empty file, and that is malformed, as it has no header. The first fault of a file counts.
    """
    content = F.coalesce("content", F.lit(b""))
    mark = F.lit(b"\xef\xbb\xbf")
    has_bom = F.substring(content, 1, 3) == mark
    body = F.substring(content, F.lit(4), F.length(content)) if bom else content
    text = body.cast("string")
    early = (
        F.when(F.lit(delimiter not in DELIMITERS), "CSV_OPTIONS_UNSUPPORTED")
        .when(F.length(content) > min(budget.source_bytes, budget.expanded_bytes), "TABULAR_LIMIT_EXCEEDED")
        .when(has_bom != F.lit(bom), "CSV_OPTIONS_UNSUPPORTED")
        .when(~F.is_valid_utf8(text), "CSV_OPTIONS_UNSUPPORTED")
        .when(F.contains(text, F.lit("\0")), "CSV_MALFORMED")
    )
    opened = files.select("path", early.alias("early"), F.when(early.isNull(), text).alias("text"))
    records = _records(opened, delimiter, quote, multiline)
    # Of a record that is both, the fault inside comes before the size at its end.
    fault = lambda r: F.when(r["bad"], "CSV_MALFORMED").when(r["size"] > budget.record_bytes, "TABULAR_LIMIT_EXCEEDED")
    first = F.get(F.filter(F.transform("r", fault), lambda f: f.isNotNull()), F.lit(0))
    over = (F.size("r") > budget.rows + 1) | F.exists("r", lambda r: (F.size(r["cells"]) > budget.columns) | F.exists(r["cells"], lambda c: F.length(c) > budget.cell_chars))
    headless = (F.size("r") == 0) | F.exists(F.get("r", F.lit(0))["cells"], lambda c: F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", "") == "")
    issue = F.coalesce("early", first, F.when(over, "TABULAR_LIMIT_EXCEEDED"), F.when(headless, "CSV_MALFORMED"))
    judged = records.select("path", "r", issue.alias("issue"))
    # The breaks inside the records before; a file has few records (its budget).
    sums = F.aggregate("r", F.struct(F.array().cast("array<int>").alias("lines"), F.lit(1).alias("next")), lambda s, r: F.struct(F.concat(s["lines"], F.array(s["next"])).alias("lines"), (s["next"] + r["breaks"] + 1).alias("next")))["lines"]
    lines = F.when(F.exists("r", lambda r: r["breaks"] > 0), sums).otherwise(F.transform("r", lambda _, i: i + 1))
    numbered = judged.select("path", "issue", F.arrays_zip(F.transform("r", lambda r: r["cells"]).alias("cells"), lines.alias("line")).alias("_z"))
    row = F.transform("_z", lambda z, i: F.struct(i.alias("row"), F.concat(F.lit("row:"), z["line"].cast("string")).alias("locator"), z["cells"].alias("cells")))
    refused = F.array(F.struct(F.lit(None).cast("int").alias("row"), F.lit(None).cast("string").alias("locator"), F.lit(None).cast("array<string>").alias("cells")))
    shown = numbered.select("path", "issue", F.explode(F.when(F.col("issue").isNull(), row).otherwise(refused)).alias("_r"))
    return shown.select("path", "_r.row", "_r.locator", "_r.cells", "issue")
