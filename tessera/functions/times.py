"""Durations and dates. Two duration grammars exist and are kept apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Day 0 of spreadsheet serial numbers.
SERIAL_ZERO = "1899-12-30"


def _part(text: Column, i: int) -> Column:
    return F.try_element_at(F.split(text, ":"), F.lit(i)).try_cast("long")


def source_duration(text: Column) -> Column:
    """Seconds of a source's duration: ``n`` are minutes, ``a:b`` minutes and seconds, ``a:b:c`` hours, minutes, seconds."""
    bare = F.trim(text)
    a, b, c = (_part(bare, i) for i in (1, 2, 3))
    return F.when(bare.rlike(r"^\d{1,9}$"), a * 60).when(bare.rlike(r"^\d{1,9}:[0-5]\d$"), a * 60 + b).when(bare.rlike(r"^\d{1,9}:[0-5]\d:[0-5]\d$"), a * 3600 + b * 60 + c)


def typed_duration(text: Column, unit: Column) -> Column:
    """Seconds of a source's duration with its unit: of ``minutes`` only whole numbers count, of any other the clock too."""
    return F.when(unit.eqNullSafe(F.lit("minutes")), F.when(F.trim(text).rlike(r"^\d{1,9}$"), F.trim(text).try_cast("long") * 60)).otherwise(source_duration(text))


def owner_duration(text: Column) -> Column:
    """Seconds of an owner's input: ``a:b`` are hours and minutes, ``a:b:c`` hours, minutes, seconds."""
    bare = F.trim(text)
    a, b, c = (_part(bare, i) for i in (1, 2, 3))
    return F.when(bare.rlike(r"^\d{1,9}:[0-5]\d$"), a * 3600 + b * 60).when(bare.rlike(r"^\d{1,9}:[0-5]\d:[0-5]\d$"), a * 3600 + b * 60 + c)


def hours_to_seconds(hours: Column) -> Column:
    """Whole seconds of decimal hours (decimal(30,16)), half up."""
    return F.round(hours * F.lit(3600).cast("decimal(4,0)"), 0).cast("long")


def clock(seconds: Column) -> Column:
    """``H:MM:SS`` of whole seconds."""
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(F.call_function("div", seconds, F.lit(3600)).cast("string"), F.lit(":"), pad(F.call_function("div", seconds % 3600, F.lit(60))), F.lit(":"), pad(seconds % 60))


def short_clock(seconds: Column) -> Column:
    """``HH:MM``, with ``:SS`` only where seconds are left."""
    pad = lambda c: F.when(F.length(c.cast("string")) >= 2, c.cast("string")).otherwise(F.lpad(c.cast("string"), 2, "0"))
    base = F.concat(pad(F.call_function("div", seconds, F.lit(3600))), F.lit(":"), pad(F.call_function("div", seconds % 3600, F.lit(60))))
    return F.when(seconds % 60 == 0, base).otherwise(F.concat(base, F.lit(":"), pad(seconds % 60)))


def mixed_date(text: Column) -> Column:
    """A date written ``dd/mm/yyyy``, ``yyyy-mm-dd`` or as a five-digit spreadsheet serial; null where it is none."""
    bare = F.trim(text)
    return (
        F.when(bare.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_date(bare, "dd/MM/yyyy"))
        .when(bare.rlike(r"^\d{5}$"), F.date_add(F.lit(SERIAL_ZERO).cast("date"), bare.try_cast("int")))
        .when(bare.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(bare, "yyyy-MM-dd"))
    )


def month_label(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def period(first: Column, last: Column) -> Column:
    """``MM/YYYY a MM/YYYY``; null without dates."""
    return F.concat(F.date_format(first, "MM/yyyy"), F.lit(" a "), F.date_format(last, "MM/yyyy"))


def local_stamp(instant: Column, zone: str = "America/Sao_Paulo") -> Column:
    return F.date_format(F.from_utc_timestamp(instant, zone), "dd/MM/yyyy, HH:mm:ss")
