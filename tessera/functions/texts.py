"""Text keys, redaction, cell guards and hashes."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of a source text, without the line's own escapes: a class for both engines.
SPACE = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
MARKS = r"[\x{300}-\x{36F}]"


def _folding() -> tuple[str, str]:
    """All letters that canonical decomposition gives as one letter and combining marks, and these letters."""
    pairs = [(chr(c), re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFD", chr(c)))) for c in range(0xC0, 0x10000) if not 0xAC00 <= c < 0xE000]
    pairs = [(c, base) for c, base in pairs if len(base) == 1 and base != c]
    return "".join(c for c, _ in pairs), "".join(base for _, base in pairs)


MARKED, PLAIN = _folding()

#: What stands for personal data, and the patterns of such, in the order in which they are replaced.
OMITTED = "[dado pessoal omitido]"
PERSONAL = (
    r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}",
    r"\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b",
    r"\b\d{2}\.?\d{3}\.?\d{3}\/?\d{4}-?\d{2}\b",
    r"\(?\d{2}\)?" + SPACE + r"?9?\d{4}-?\d{4}\b",
)
#: What stands for a place in a file system, where such places begin, and the control characters that go.
OMITTED_PATH = "[caminho local omitido]"
ROOT = r"(?:file:\/\/)?(?:\/(?:Users|home)\/[^\/\s]+\/|\/(?:tmp|private|Volumes|var(?:\/folders|\/tmp)?|opt|srv|mnt)\/|[A-Za-z]:\\|\\\\[^\\\s]+\\)"
#: The same of the fourth form of publications, one after the other; what follows belongs to a place up to these signs.
REST = r"""[^\r\n,;"<>)]*"""
PLACES = (
    r"(?i)(?:file:\/\/)?\/(?:Users|home)\/[^\/\s]+\/" + REST,
    r"(?i)(?:file:\/\/)?\/(?:tmp|private|Volumes|var(?:\/folders|\/tmp)?|opt|srv|mnt)\/" + REST,
    r"(?i)(?:file:\/\/\/)?[A-Za-z]:\/" + REST,
    r"[A-Za-z]:\\" + REST,
    r"\\\\[^\\\s]+\\" + REST,
)
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
#: What a spreadsheet passes over before a formula.
UNSEEN = r"[\x00-\x20\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: An invoice number with or without its kind.
INVOICE = r"^(?:(?:nfs[ -]*e|nfse)\s*[:#-]?\s*)?(\d+)$"


def folded(text: Column) -> Column:
    """Without marks: letters are decomposed and their combining marks go."""
    return F.regexp_replace(F.translate(text, MARKED, PLAIN), MARKS, "")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def header_key(text: Column) -> Column:
    """Without marks, trimmed, lower case."""
    return F.lower(trimmed(folded(text)))


def title_key(text: Column) -> Column:
    """A title for comparison: like a header, and each run of blanks as one."""
    return trimmed(F.regexp_replace(F.lower(folded(text)), f"{SPACE}+", " "))


def invoice_key(text: Column) -> Column:
    """An invoice number for comparison: ``NFS-e: 007`` and ``7`` are the same; other texts lower-cased, each run of blanks as one."""
    bare = F.regexp_replace(F.lower(trimmed(text)), f"{SPACE}+", " ")
    number = F.regexp_extract(bare, INVOICE, 1)
    digits = F.ltrim(number, F.lit("0"))
    return F.when(number == "", bare).when(digits == "", "0").otherwise(digits)


def redact_personal(text: Column) -> Column:
    for pattern in PERSONAL:
        text = F.regexp_replace(text, pattern, OMITTED.replace("$", r"\$"))
    return text


def redact_paths(text: Column) -> Column:
    """Places in file systems become a token, first those that end in a file's ending (blanks are part of them); control characters go."""
    ended = F.regexp_replace(text, rf"(?i){ROOT}[^\r\n,;]*?\.[A-Za-z0-9]{{1,10}}(?=\s|[),;]|\z)", OMITTED_PATH)
    return F.regexp_replace(F.regexp_replace(ended, rf"(?i){ROOT}[^\s<>\"]+", OMITTED_PATH), CONTROLS, "")


def redact_places(text: Column) -> Column:
    """As :func:`redact_paths` in the fourth form of publications: drives with either slash, and places with blanks whether they end in a file's ending or not, go up to the next separator.

    A web address goes from the last letter of its scheme on, as a letter, a colon and a slash begin a drive there.
    """
    for pattern in PLACES:
        text = F.regexp_replace(text, pattern, OMITTED_PATH)
    return F.regexp_replace(text, CONTROLS, "")


def csv_cell(text: Column, redact: Callable[[Column], Column] = redact_paths) -> Column:
    """A quoted cell that no spreadsheet runs as a formula: places go (by ``redact``), line breaks become blanks, a quote stands before ``= + - @``."""
    flat = F.regexp_replace(redact(F.coalesce(text, F.lit(""))), r"\r?\n", " ")
    safe = F.when(flat.rlike(rf"^{UNSEEN}*[=+\-@]"), F.concat(F.lit("'"), flat)).otherwise(flat)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def html_text(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the first plane count twice."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[\x{0}-\x{FFFF}]", ""))


def canonical_map(payload: Column) -> Column:
    """A flat map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(payload))))


def json_text(text: Column) -> Column:
    """A JSON string with the shortest escapes; other control characters as four lower-case hex digits."""
    for sign, name in (("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\t", "\\t"), ("\n", "\\n"), ("\f", "\\f"), ("\r", "\\r")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    full = text
    for c in sorted(set(range(0x20)) - {8, 9, 10, 12, 13}):
        full = F.replace(full, F.lit(chr(c)), F.lit(f"\\u{c:04x}"))
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1F]"), full).otherwise(text), F.lit('"'))


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """Canonical JSON of nested maps, structs and arrays: keys in the order of their UTF-16 units, lists in their own order.

    ``kind`` is the value's type. Texts, booleans, whole numbers and days are leaves; amounts are held as texts, so
    that no binary fraction is written: any other type raises a TypeError.
    """
    if isinstance(kind, T.StringType):
        made = json_text(value)
    elif isinstance(kind, T.DateType):
        made = json_text(value.cast("string"))
    elif isinstance(kind, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        made = value.cast("string")
    elif isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda v: canonical_json(v, kind.elementType))
        made = F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        # The first field sorts, the second is the written member.
        member = lambda e: F.struct(F.encode(e["key"], "UTF-16BE").alias("k"), F.concat(json_text(e["key"]), F.lit(":"), canonical_json(e["value"], kind.valueType)).alias("m"))
        members = F.transform(F.array_sort(F.transform(F.map_entries(value), member)), lambda m: m["m"])
        made = F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))
    elif isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name.encode("utf-16-be"))
        members = [F.concat(json_text(F.lit(f.name)), F.lit(":"), canonical_json(value[f.name], f.dataType)) for f in fields]
        made = F.when(value.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}")))
    else:
        raise TypeError(f"no canonical form of {kind.simpleString()}")
    return F.coalesce(made, F.lit("null"))


def hash_id(prefix: str, key: Column) -> Column:
    """A stable identifier in the form of a UUID, from a SHA-256."""
    return dashed(F.substring(F.sha2(F.concat(F.lit(prefix), key), 256), 1, 32))


def md5_id(key: Column) -> Column:
    return dashed(F.md5(key))


def dashed(hex32: Column) -> Column:
    return F.concat_ws("-", *(F.substring(hex32, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def escaped_contains(text: Column, query: str) -> Column:
    """Case-folded literal search: no character of the query is a wildcard."""
    return F.contains(F.lower(text), F.lit(query.lower()))
