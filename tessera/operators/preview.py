"""Previews of ledger imports: header mapping, row validation, policies, and requests that may come twice."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import money, texts
from tessera.operators import commitment

#: Columns that never take part, and names that can't identify a record.
IGNORED = ("curso", "trilha")
PROHIBITED = re.compile(r"(^|_|-)(id|hash|valor|value|amount|data|date|linha|row|locator)($|_|-)", re.IGNORECASE)
FIELD_NAME = re.compile(r"[a-z][a-z0-9_-]{0,63}")


class MappingError(ValueError):
    """A header mapping that can't be used, with a code."""


@dataclass(frozen=True)
class Field:
    """A field of a schema: type text, date, decimal or duration."""

    name: str
    kind: str = "text"
    required: bool = False
    most: int | None = None


def check_mapping(headers: list[str], mapping: dict[int, str], schema: list[Field]) -> None:
    """Raise :class:`MappingError` unless each column is mapped to one field of its own or ignored, and required fields are there.

    ``headers`` are normalised labels; ``mapping`` goes from column to field.
    """
    used = [h for h in headers if h not in IGNORED]
    if len(set(used)) < len(used):
        raise MappingError("HEADER_COLLISION")
    names = {f.name for f in schema}
    bad = any(i >= len(headers) or headers[i] in IGNORED or name not in names for i, name in mapping.items())
    if not mapping or bad or len(set(mapping.values())) < len(mapping):
        raise MappingError("HEADER_MAPPING_INVALID")
    if any(f.required and f.name not in mapping.values() for f in schema):
        raise MappingError("REQUIRED_FIELD_MISSING")
    if any(i not in mapping and h not in IGNORED for i, h in enumerate(headers)):
        raise MappingError("HEADER_UNMAPPED")


def check_policy(fields: list[str]) -> None:
    """Raise ``ValueError`` unless the fields can identify records: no repeats, no values, dates, hashes or row numbers."""
    if len(set(fields)) < len(fields):
        raise ValueError("a matching policy can't repeat attributes")
    for f in fields:
        if not FIELD_NAME.fullmatch(f) or PROHIBITED.search(f) or f in IGNORED:
            raise ValueError(f"{f} can't identify a record")


def _field(cell: Column, f: Field) -> tuple[Column, Column]:
    """(normalised value, error code) of one cell."""
    text = F.trim(F.coalesce(cell, F.lit("")))
    if f.kind == "date":
        day = F.try_to_date(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text), "yyyy-MM-dd")
        value, code = F.date_format(day, "yyyy-MM-dd"), "INVALID_DATE"
    elif f.kind == "decimal":
        value, code = money.ledger_decimal(text), "INVALID_DECIMAL"
    elif f.kind == "duration":
        value, code = F.when(text.rlike(r"^(\d+|\d+:[0-5]\d(:[0-5]\d)?)$"), text), "INVALID_DURATION"
    else:
        value, code = text, "INVALID_TEXT"
    long = texts.utf16_length(text) > f.most if f.most else F.lit(False)
    error = F.when(text == "", F.lit("REQUIRED_FIELD") if f.required else F.lit(None).cast("string")).when(long, "FIELD_TOO_LONG").when(value.isNull(), code)
    return F.when((text != "") & ~long, value), error


def preview(rows: DataFrame, mapping: dict[int, str], schema: list[Field], width: int, attributes: tuple[str, ...] = ()) -> DataFrame:
    """Rows (locator, cells) with payload, scales of decimals, matching attributes, errors, status and the hash of the source values.

    ``errors`` holds code:field in order; values that break a rule are null in the payload, the cells stay as they came. Formulas
    are refused like any text that isn't of its type, and as FORMULA in text fields.
    """
    fields = {f.name: f for f in schema}
    cell = lambda i: F.try_element_at("cells", F.lit(i + 1))
    found = [(name, cell(i), *_field(cell(i), fields[name])) for i, name in sorted(mapping.items())]
    errors = [F.when(F.size("cells") != width, "FIELD_COUNT:_row")]
    for name, raw, _, error in found:
        formula = F.startswith(F.trim(F.coalesce(raw, F.lit(""))), F.lit("="))
        errors.append(F.concat(F.coalesce(error, F.when(formula, "FORMULA")), F.lit(f":{name}")))
    pairs = lambda items: F.map_from_arrays(F.array(*(F.lit(n) for n, _ in items)), F.array(*(v for _, v in items)))
    decimals = [(n, money.scale_of(v)) for n, _, v, _ in found if fields[n].kind == "decimal"]
    identity = [(n, v) for n, _, v, _ in found if n in attributes]
    source = pairs([(n, F.coalesce(raw, F.lit(""))) for n, raw, _, _ in found])
    out = rows.withColumns({
        "payload": pairs([(n, v) for n, _, v, _ in found]),
        "scales": pairs(decimals) if decimals else F.create_map().cast("map<string,int>"),
        "attributes": pairs(identity) if identity else F.create_map().cast("map<string,string>"),
        "errors": F.array_compact(F.array(*errors)),
        "row_hash": F.sha2(F.concat_ws("\x1f", F.col("locator"), texts.canonical_map(source)), 256),
    })
    return out.withColumn("status", F.when(F.size("errors") == 0, "valid").otherwise("rejected"))


#: Fixed value: days that a preview is kept for.
KEPT_DAYS = 30
#: What a row's result is, in the order in which it is hashed.
RESULT = ("locator", "row_hash", "payload", "cells", "scales", "attributes", "status", "errors")


def sealed(previewed: DataFrame, ordinal: str, source: dict[str, str], contract: str, transformation: str, prepared_at: Column) -> DataFrame:
    """One row: the numbers of a preview's rows, the hashes that seal it, and when it expires.

    row_result_hash is the commitment of a tree over the rows in the order of ``ordinal``, so no task or row holds them all;
    content_hash is over the source's description (name to value) and both contract hashes with it; preview_hash is over
    those, the numbers and the day of expiry. Times of preparing don't count for content_hash: the same file under the same
    contract has the same one.
    """
    rows = previewed.select(ordinal, *(texts.canonical_map(F.col(c)).alias(c) if c in ("payload", "attributes") else F.to_json(F.struct(c)).alias(c) for c in RESULT))
    tree = commitment.ordered_root(commitment.ordered_tree(rows, [ordinal], list(RESULT)), "preview/rows").select(F.col("commitment").alias("row_result_hash"))
    counts = previewed.agg(F.count("*").alias("found"), F.count_if(F.col("status") == "valid").alias("valid"), F.count_if(F.size("errors") > 0).alias("with_error"), F.count_if(F.col("status") == "rejected").alias("rejected"))
    described = [F.lit(part) for item in sorted(source.items()) for part in item]
    one = counts.join(tree)  # one row each
    content = F.sha2(_parts(F.lit("preview/content"), *described, F.lit(contract), F.lit(transformation), F.col("row_result_hash")), 256)
    out = one.withColumns({"content_hash": content, "prepared_at": prepared_at.cast("timestamp"), "retain_until": prepared_at.cast("timestamp") + F.make_dt_interval(F.lit(KEPT_DAYS))})
    numbers = (F.col(c).cast("string") for c in ("found", "valid", "with_error", "rejected"))
    until = F.unix_micros("retain_until").cast("string")
    return out.withColumn("preview_hash", F.sha2(_parts(F.lit("preview/manifest"), F.lit(contract), F.lit(transformation), F.col("row_result_hash"), F.col("content_hash"), *numbers, until), 256))


def _parts(*values: Column) -> Column:
    """Texts as one that tells them apart."""
    return F.concat(*(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v) for v in values))


def retained(previews: DataFrame, now: Column) -> DataFrame:
    """``previews`` (retain_until) with ``expired``: the day itself still counts as kept; without a day nothing is kept."""
    return previews.withColumn("expired", F.coalesce(F.col("retain_until") < now, F.lit(True)))


def settle_requests(requests: DataFrame, known: DataFrame) -> DataFrame:
    """(request_id, verdict) of requests (request_id, idempotency_key, fingerprint, expired) against known ones (idempotency_key, fingerprint).

    conflict: the key stands for another payload. reused: the same key or the same payload is known. expired, else applied.
    """
    by_key = known.groupBy("idempotency_key").agg(F.max("fingerprint").alias("_held"))
    by_print = known.select("fingerprint").distinct().withColumn("_seen", F.lit(True))
    out = requests.join(by_key, "idempotency_key", "left").join(by_print, "fingerprint", "left")
    verdict = F.when(F.col("_held") != F.col("fingerprint"), "conflict").when(F.col("_held").isNotNull() | F.col("_seen"), "reused").when(F.col("expired"), "expired").otherwise("applied")
    return out.select("request_id", verdict.alias("verdict"))


def revision_guard(requests: DataFrame, current: DataFrame, key: str, fields: list[str], known: DataFrame) -> DataFrame:
    """(request_id, verdict) of revisions (request_id, key, expected_revision, restore, fields) against effective rows (key, revision, fields, source_<field>).

    known: (request_id, payload hash) of requests that were applied. Verdicts, the first that holds: reused, conflict (the id
    with another payload, or another revision than expected), missing, unchanged (nothing would change), not_source
    (a restore that isn't the source), overflow, applied.
    """
    payload = lambda prefix="": F.sha2(F.to_json(F.struct(*(F.col(f"{prefix}{f}").cast("string").alias(f) for f in fields)), {"ignoreNullFields": "false"}), 256)
    held = current.select(F.col(key), F.col("revision").alias("_revision"), payload().alias("_now"), payload("source_").alias("_source"))
    out = requests.withColumn("_payload", payload()).join(held, key, "left").join(known.toDF("request_id", "_applied"), "request_id", "left")
    verdict = (
        F.when(F.col("_applied") == F.col("_payload"), "reused")
        .when(F.col("_applied").isNotNull(), "conflict")
        .when(F.col("_revision").isNull(), "missing")
        .when(F.col("expected_revision") != F.col("_revision"), "conflict")
        .when(F.col("restore") & (F.col("_payload") != F.col("_source")), "not_source")
        .when(~F.col("restore") & (F.col("_payload") == F.col("_now")), "unchanged")
        .when(F.col("_revision") == 2**63 - 1, "overflow")
        .otherwise("applied")
    )
    return out.select("request_id", verdict.alias("verdict"))
