"""Exact amounts. Decimals stay decimals until the last step; rounding is half up, away from zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.texts import SPACE

UNKNOWN = "Não informado"
#: Source amounts: up to 14 digits before the point and 16 after it.
SOURCE = "decimal(30,16)"


def cents(amount: Column) -> Column:
    """Whole cents of a decimal amount (long)."""
    return (F.round(amount, 2) * 100).cast("long")


def spreadsheet_decimal(text: Column) -> Column:
    """A cell's amount: ``R$`` and blanks go, with a comma points are group marks; null where it is none."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^R\$\s*", ""), r"\s", "")
    plain = F.when(F.contains(bare, F.lit(",")), F.regexp_replace(F.replace(bare, F.lit("."), F.lit("")), ",", ".")).otherwise(bare)
    return F.when(plain.rlike(r"^-?\d{1,14}(\.\d{1,16})?$"), plain.try_cast(SOURCE))


def ledger_decimal(text: Column) -> Column:
    """A ledger amount as text: comma or point, no leading zeros, fraction zeros kept, ``.5`` as ``0.5``."""
    bare = F.trim(text)
    point = F.regexp_replace(bare, ",", ".")
    whole = F.regexp_replace(F.regexp_extract(point, r"^-?(\d*)", 1), "^0+(?=.)", "")
    sign = F.when(F.startswith(bare, F.lit("-")), "-").otherwise("")
    fraction = F.regexp_extract(point, r"(\.\d+)$", 1)
    built = F.concat(sign, F.when(whole == "", "0").otherwise(whole), fraction)
    return F.when(bare.rlike(r"^-?(\d+([.,]\d+)?|[.,]\d+)$"), built)


def scale_of(text: Column) -> Column:
    """Digits after the point of a decimal text."""
    return F.length(F.regexp_extract(text, r"\.(\d*)$", 1))


def _point(bare: Column, fraction: int) -> Column:
    """Unsigned digits with a point, of an amount written grouped, with a comma or with a point; null where it is none."""
    end = rf"\d{{1,{fraction}}}"
    return (
        F.when(bare.rlike(rf"^\d{{1,3}}(\.\d{{3}})+(,{end})?$"), F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(bare.rlike(rf"^\d+(,{end})?$"), F.replace(bare, F.lit(","), F.lit(".")))
        .when(bare.rlike(rf"^\d+\.{end}$"), bare)
    )


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?i)R\$|{SPACE}", "")


def brl_cents(text: Column) -> Column:
    """Cents, decimal(24,0), of an unsigned amount written in any way; null where it is none or has more than 24 digits."""
    return (_point(_bare(text), 2).try_cast("decimal(36,2)") * 100).try_cast("decimal(24,0)")


def brl_decimal(text: Column, signed: bool, whole: int, fraction: int) -> Column:
    """An amount as a decimal text: no leading zeros, at least one digit after the point; null where it is none or too large."""
    bare = _bare(text)
    minus = F.startswith(bare, F.lit("-"))
    point = _point(F.regexp_replace(bare, "^-", ""), fraction)
    digits = F.regexp_replace(F.substring_index(point, ".", 1), r"^0+(?=\d)", "")
    after = F.when(F.contains(point, F.lit(".")), F.substring_index(point, ".", -1)).otherwise("0")
    fits = (F.length(digits) <= whole) & (F.lit(signed) | ~minus)
    return F.when(fits, F.concat(F.when(minus, "-").otherwise(""), digits, F.lit("."), after))


def adjustment_decimal(mode: Column, text: Column) -> Column:
    """A signed amount of 14 and 16 digits where ``mode`` is ``present``; null where it is ``missing``."""
    return F.when(mode == "present", brl_decimal(text, True, 14, 16))


def fiscal_decimal(text: Column) -> Column:
    """An unsigned amount of 18 and 2 digits, always two after the point."""
    made = brl_decimal(text, False, 18, 2)
    return F.concat(made, F.when(made.rlike(r"\.\d$"), "0").otherwise(""))


def brl(value: Column, minus: str = "-") -> Column:
    """``R$ 1.234,56`` of whole cents; null is unknown, never zero."""
    size = F.abs(value)
    whole = F.translate(F.format_number(F.call_function("div", size, F.lit(100)), 0), ",", ".")
    text = F.concat(F.when(value < 0, minus).otherwise(""), F.lit("R$ "), whole, F.lit(","), F.lpad((size % 100).cast("string"), 2, "0"))
    return F.coalesce(text, F.lit(UNKNOWN))


def percent(part: Column, whole: Column) -> Column:
    """``NN,NN%`` of two cent amounts, half up; null where the whole isn't positive."""
    points = F.call_function("div", part * 10000 + F.call_function("div", whole, F.lit(2)), F.when(whole > 0, whole))
    return F.concat(F.call_function("div", points, F.lit(100)).cast("string"), F.lit(","), F.lpad((points % 100).cast("string"), 2, "0"), F.lit("%"))


def hourly_rate_cents(amount: Column, hours: Column) -> Column:
    """Cents an hour of two decimal(30,16): only the quotient is rounded; null where hours aren't positive.

    Both are scaled to whole numbers first, because a decimal quotient would lose digits.
    """
    scaled = lambda c: (F.abs(c) * F.lit(10**16).cast("decimal(17,0)")).cast("decimal(31,0)")
    top, bottom = scaled(amount), scaled(hours)
    two, most = F.lit(2).cast("decimal(1,0)"), F.lit(200).cast("decimal(3,0)")
    size = F.call_function("div", top * most + bottom, F.when(hours > 0, bottom * two))
    return size * F.when(amount < 0, -1).otherwise(1)
