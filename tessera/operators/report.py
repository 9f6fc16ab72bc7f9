"""Reports: universes that are never added across, trends, pages, searches, publications and audits."""

from __future__ import annotations

import hmac
import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.times import typed_duration
from tessera.operators import ranges
from tessera.operators.load import numbered


def monthly_trend(rows: DataFrame, date: str, value: str, most: int = 240) -> DataFrame:
    """(month, total): months from the first to the last with a total other than zero; those between without rows are zero.

    Empty if all are zero. Over ``most`` months raise an error: the report has that many columns at most.
    """
    months = rows.filter(F.col(date).isNotNull()).groupBy(F.trunc(F.col(date).cast("date"), "month").alias("month")).agg(F.sum(value).alias("total"))
    ends = months.filter("total != 0").agg(F.min("month").alias("first"), F.max("month").alias("last"))
    n = F.months_between("last", "first") + 1
    checked = F.when(n > most, F.raise_error(F.lit(f"more than {most} months")).cast("date")).otherwise(F.col("last"))
    axis = ends.filter("first IS NOT NULL").select(F.explode(F.sequence("first", checked, F.expr("interval 1 month"))).alias("month"))
    return axis.join(months, "month", "left").select(F.date_format("month", "yyyy-MM").alias("month"), F.coalesce("total", F.lit(0)).alias("total"))


def universes(**sums: tuple[DataFrame, Column]) -> DataFrame:
    """One row with each universe's own sum; a universe without rows is null, not zero."""
    rows = [df.agg(F.sum(value).alias(name)) for name, (df, value) in sums.items()]
    return reduce(lambda a, b: a.crossJoin(b), rows)  # one row each


def models(owner: str, *tables: tuple[DataFrame, dict[str, tuple[Column, Column]]]) -> DataFrame:
    """The models of every owner and the global one: (model, owner, <universe>, n_<universe>), one row each.

    Each table comes with its universes: name -> (owner, value); a row counts where its value isn't null. Universes stay
    apart: each has its own sum, unknown (null) where no row counts. A value without owner counts in the global model
    alone. Each table is read once, whatever its universes, and all models come from one grouping, combined before the shuffle.
    """
    names = [name for _, universes in tables for name in universes]
    rows = []
    for df, own in tables:
        given = [F.struct(at.alias(owner), *((value if n == name else F.lit(None)).alias(n) for n in own)) for name, (at, value) in own.items()]
        rows.append(df.select(F.inline(F.array(*given))).filter(F.coalesce(*own).isNotNull()))
    # A row without owner and values: the global model is there even where no row counts.
    rows.append(tables[0][0].sparkSession.range(1).select(F.lit(None).alias(owner)))
    tagged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    measures = [x for n in names for x in (F.sum(n).alias(n), F.count(n).alias(f"n_{n}"))]
    out = tagged.groupingSets([[owner], []], owner).agg(F.grouping(owner).alias("_all"), *measures)
    return out.filter((F.col("_all") == 1) | F.col(owner).isNotNull()).select(F.when(F.col("_all") == 1, "global").otherwise("project").alias("model"), owner, *(c for n in names for c in (n, f"n_{n}")))


def by_owner(owners: DataFrame, owner: str, **measures: tuple[DataFrame, Column]) -> DataFrame:
    """Owners with the sum and number of each universe, aggregated before the join so that no fan-out multiplies."""
    out = owners
    for name, (df, value) in measures.items():
        out = out.join(df.groupBy(owner).agg(F.sum(value).alias(name), F.count("*").alias(f"n_{name}")), owner, "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    return out


def keyset_page(rows: DataFrame, key: str, after: Column | None, size: int) -> DataFrame:
    """The next ``size`` rows by key, and ``has_more`` on each: one more row is read, and no offset is counted."""
    rest = rows if after is None else rows.filter(F.col(key) > after)
    page = rest.orderBy(key).limit(size + 1)  # size + 1 rows in one task, whatever the table
    return page.withColumn("has_more", F.count("*").over(Window.partitionBy(F.lit(0))) > size).orderBy(key).limit(size)


def _seal(secret: bytes, bound: dict[str, str], last: str) -> str:
    return hmac.new(secret, json.dumps([sorted(bound.items()), last]).encode(), "sha256").hexdigest()


def cursor(secret: bytes, bound: dict[str, str], last: str) -> str:
    """A signed place after ``last``, good only for the same ``bound`` (kind, leaf, query, size, epoch)."""
    return f"{_seal(secret, bound, last)}.{last}"


def cursor_place(secret: bytes, bound: dict[str, str], text: str) -> str:
    """The place of a cursor; one that was changed or belongs to another listing raises an error."""
    seal, _, last = text.partition(".")
    if not hmac.compare_digest(seal.encode(), _seal(secret, bound, last).encode()):
        raise ValueError("the cursor isn't of this listing")
    return last


def member_page(rows: DataFrame, key: str, after: Column | None, size: int) -> DataFrame:
    """A page by key whose begin must itself be a row of the listing; otherwise an error is raised."""
    if after is not None and rows.filter(F.col(key) == after).isEmpty():
        raise ValueError("the cursor's place isn't in the listing")
    return keyset_page(rows, key, after, size)


#: Rows that one task may sort for a page.
NEAR = 10_000


def offset_page(rows: DataFrame, order: list[Column], page: int, size: int = 100) -> DataFrame:
    """A page by number (from 1), clamped to the last one; the last page is the last rows from its begin.

    A page near the begin is a bounded top-k. For any other the rows are numbered in parallel ranges, so that no task gets all rows before it.
    """
    last = max(1, -(-rows.count() // size))
    begin = (min(max(1, page), last) - 1) * size
    if begin + size <= NEAR:
        return rows.orderBy(*order).offset(begin).limit(size)
    return numbered(rows, order, "_place").filter(F.col("_place").between(begin + 1, begin + size)).drop("_place")


def guarded(rows: DataFrame, most: int) -> DataFrame:
    """``rows``, or an error if there are more than ``most``: one more is looked at, never all."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return rows


def text_search(rows: DataFrame, columns: list[str], query: str, archived: str | None = None) -> DataFrame:
    """Rows whose columns hold the query, without regard to case and without wildcards; archived ones only on demand."""
    hit = F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.lower()))
    return rows.filter(hit if archived is None else hit & ~F.col(archived))


def record_search(records: DataFrame, query: str, fields: list[str]) -> DataFrame:
    """Records whose id, matching attributes (keys and values) or allowed payload fields hold the query; disregarded ones never."""
    needle = F.lit(query.lower())
    has = lambda c: F.coalesce(F.contains(F.lower(c), needle), F.lit(False))
    attributes = F.coalesce(F.exists(F.map_entries("attributes"), lambda e: has(e["key"]) | has(e["value"])), F.lit(False))
    found = has(F.col("record").cast("string")) | attributes
    for f in fields:
        found = found | has(F.try_element_at("payload", F.lit(f)))
    return records.filter((F.col("state") != "disregarded") & found)


def official_order(value: Column, descending: bool = False) -> Column:
    """Absent values first, and last when the order is turned."""
    return value.desc_nulls_last() if descending else value.asc_nulls_first()


def publication(sections: dict[str, tuple[DataFrame, Column, Column, Column]]) -> DataFrame:
    """All sections in one long table: section, code, label, value (text)."""
    rows = [df.select(F.lit(name).alias("section"), code.cast("string").alias("code"), label.cast("string").alias("label"), value.cast("string").alias("value")) for name, (df, code, label, value) in sections.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


@dataclass(frozen=True)
class Section:
    """A section of a publication: its rows, their order, what numbers them, and the columns that it fills.

    ``code`` is a prefix, such as ``EVD`` for EVD-001, or a column of codes that the rows have themselves.
    """

    name: str
    rows: DataFrame
    order: list[str]
    code: str | Column
    values: dict[str, Column]


#: The columns of published tables, by the form of publication.
PUBLISHED = {
    "v1": ("publication_code", "section", "record_code", "group_code", "title", "type", "amount_cents", "currency", "display_amount", "origin", "relation", "payment", "status"),
    "v4": ("publication_code", "section", "record_code", "group_code", "title", "effective_value", "source_value", "revision", "actor", "reason", "status"),
}


def published(code: str, form: str, sections: list[Section], redact: Callable[[Column], Column], plain: tuple[str, ...] = ()) -> DataFrame:
    """The sections one after the other as one table of a form: (section_no, place, the form's columns).

    A section's rows are numbered in parallel by their order, which must be total. Columns that it doesn't fill are null, and
    one that the form lacks is an error. All values are texts and go through ``redact``, but for codes and those in ``plain``
    (identifiers, digests, amounts). Sort by section_no and place, as :func:`tessera.sources.files.export_csv` does, to show it.
    """
    columns, out = PUBLISHED[form], []
    for number, s in enumerate(sections):
        if unknown := set(s.values) - set(columns[3:]):
            raise ValueError(f"{form} has no {', '.join(sorted(unknown))}")
        # Values are computed before the rows are numbered, so that columns of any name may be there.
        held = {c: (v if c in plain else redact(v.cast("string"))).cast("string").alias(f"_v_{c}") for c, v in s.values.items()}
        own = [] if isinstance(s.code, str) else [s.code.cast("string").alias("_code")]
        rows = numbered(s.rows.select(*(F.col(c).alias(f"_o_{i}") for i, c in enumerate(s.order)), *own, *held.values()), [f"_o_{i}" for i in range(len(s.order))], "_place")
        shown = F.when(F.col("_place") < 1000, F.lpad(F.col("_place").cast("string"), 3, "0")).otherwise(F.col("_place").cast("string"))
        fixed = [F.lit(code), F.lit(s.name), F.concat(F.lit(f"{s.code}-"), shown) if isinstance(s.code, str) else F.col("_code")]
        rest = [F.col(f"_v_{c}") if c in s.values else F.lit(None).cast("string") for c in columns[3:]]
        out.append(rows.select(F.lit(number).alias("section_no"), F.col("_place").cast("long").alias("place"), *(v.alias(c) for c, v in zip(columns, [*fixed, *rest]))))
    return reduce(DataFrame.unionByName, out)


def versions(snapshots: DataFrame, scope: str, order: str, content: str, in_task: int = ranges.IN_TASK) -> DataFrame:
    """Snapshots that become versions: those whose content hash differs from the one before; A, B, A are three.

    Adds content_hash, version and reused. Snapshots of the same order are taken by their hashes. Where a scope has more
    than ``in_task`` snapshots, ranges of its order are sorted apart; each range gets the last hash of the one before and
    the number of versions so far.
    """
    hashed = snapshots.withColumn("content_hash", F.sha2(F.col(content), 256))
    differs = lambda before: (~before.eqNullSafe(F.col("content_hash"))).cast("long")
    count = ranges.needed(snapshots, [scope], in_task)
    if count == 1:
        by_scope = Window.partitionBy(scope).orderBy(order, "content_hash")
        changed = hashed.withColumn("_new", differs(F.lag("content_hash").over(by_scope)))
        return changed.withColumn("version", F.sum("_new").over(by_scope)).withColumn("reused", F.col("_new") == 0).drop("_new")
    parts = ranges.ranged(hashed, [scope], [order, "content_hash"], count)
    by_part = Window.partitionBy("_part", scope).orderBy(order, "content_hash")
    first = F.row_number().over(by_part) == 1
    inside = parts.withColumn("_is_first", first).withColumn("_new", F.when(F.col("_is_first"), F.lit(0)).otherwise(differs(F.lag("content_hash").over(by_part)))).withColumn("_run", F.sum("_new").over(by_part))
    place = F.struct(order, "content_hash")
    groups = inside.groupBy("_part", scope).agg(F.min(place)["content_hash"].alias("content_hash"), F.max(place)["content_hash"].alias("_last"), F.sum("_new").alias("_n"))
    by_range = Window.partitionBy(scope).orderBy("_part")  # at most two rows a range
    begins = ranges.edges(groups, [scope]).withColumn("_begins", differs(F.lag("_last").over(by_range)))
    before = F.sum(F.col("_begins") + F.col("_n")).over(by_range.rowsBetween(Window.unboundedPreceding, -1))
    carried = begins.select("_part", scope, "_begins", F.coalesce(before, F.lit(0)).alias("_before"))
    out = ranges.handed(inside, carried, [scope])
    # A scope inside one range begins there: its first snapshot is new unless it has no content.
    alone = F.max(F.when(F.col("_is_first"), F.col("content_hash").isNotNull().cast("long"))).over(by_part)
    out = out.withColumn("_begins", F.coalesce("_begins", alone))
    version = F.coalesce("_before", F.lit(0)) + F.col("_begins") + F.col("_run")
    reused = F.when(F.col("_is_first"), F.col("_begins") == 0).otherwise(F.col("_new") == 0)
    return out.withColumn("version", version).withColumn("reused", reused).drop("_part", "_is_first", "_new", "_run", "_begins", "_before")


def purge_boundary(by_key: DataFrame, by_content: DataFrame, scope: str, version: str) -> DataFrame:
    """The first version of each scope that holds the purged file by either source; this and all later ones go."""
    return by_key.select(scope, version).unionByName(by_content.select(scope, version)).groupBy(scope).agg(F.min(version).alias("first_purged"))


def audit(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys on which two derivations of the same table differ, or that only one has."""
    pack = lambda df, name: df.select(key, F.struct(*fields).alias(name))
    both = pack(left, "a").join(pack(right, "b"), key, "full")
    issue = F.when(F.col("a").isNull(), "only_right").when(F.col("b").isNull(), "only_left").when(~F.col("a").eqNullSafe(F.col("b")), "differs")
    return both.select(key, issue.alias("issue")).filter("issue IS NOT NULL")


def checks(**found: tuple[DataFrame, int]) -> DataFrame:
    """(check, value, expected, holds) of named row counts."""
    rows = [df.agg(F.count("*").alias("value")).select(F.lit(name).alias("check"), "value", F.lit(expected).cast("long").alias("expected")) for name, (df, expected) in found.items()]
    return reduce(lambda a, b: a.unionByName(b), rows).withColumn("holds", F.col("value") == F.col("expected"))


def sheet_sum(rows: DataFrame, group: str, text: str) -> DataFrame:
    """Exact sums of decimal texts at the largest scale of their sources; nulls count for neither."""
    value = F.col(text).try_cast("decimal(38,16)")
    scale = F.max(F.when(value.isNotNull(), F.length(F.regexp_extract(F.col(text), r"\.(\d*)$", 1))))
    sums = rows.groupBy(group).agg(F.sum(value).cast("decimal(38,16)").alias("_sum"), scale.alias("scale"), F.count(value).alias("n"))
    shown = F.col("_sum").cast("string")
    return sums.select(group, F.when(F.col("scale") == 0, F.regexp_replace(shown, r"\..*$", "")).otherwise(F.substring(shown, F.lit(1), F.length(shown) - 16 + F.col("scale"))).alias("total"), "scale", "n")


def duration_sum(rows: DataFrame, group: str, text: str, unit: str) -> DataFrame:
    """Exact sums of durations in seconds, how many values they add up, and how many texts were no duration of their unit."""
    seconds = typed_duration(F.col(text), F.col(unit))
    return rows.groupBy(group).agg(F.sum(seconds).alias("seconds"), F.count(seconds).alias("n"), F.count_if(F.col(text).isNotNull() & seconds.isNull()).alias("n_invalid"))


def accumulate(before: DataFrame | None, rows: DataFrame, field: str, text: str) -> DataFrame:
    """A running total by field that new rows are merged into: total, n_sources, n_values, and how many values have each scale.

    What is kept is a few rows a field, so a new batch is added without reading the old ones again.
    """
    value = F.col(text).try_cast("decimal(38,16)")
    scale = F.when(value.isNotNull(), F.length(F.regexp_extract(F.col(text), r"\.(\d*)$", 1)))
    new = rows.select(F.col(field).alias("field"), scale.alias("scale"), value.alias("total"), F.lit(1).cast("long").alias("n"))
    held = new if before is None else new.unionByName(before)
    return held.groupBy("field", "scale").agg(F.sum("total").cast("decimal(38,16)").alias("total"), F.sum("n").alias("n"))


def accumulated(state: DataFrame) -> DataFrame:
    """(field, total, n_sources, n_values, scales) of an accumulator's rows; ``scales`` is a map from scale to count."""
    scales = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("scale").isNotNull(), F.struct("scale", "n")))))
    return state.groupBy("field").agg(F.sum("total").cast("decimal(38,16)").alias("total"), F.sum("n").alias("n_sources"), F.coalesce(F.sum(F.when(F.col("scale").isNotNull(), F.col("n"))), F.lit(0).cast("long")).alias("n_values"), scales.alias("scales"))


def references(notes: DataFrame, owner_declared: str, owner_audited: str, value: str, related: str) -> DataFrame:
    """(owner, basis, n, total, related): what notes declare for a project and what the audit found; only audited notes have a related value."""
    declared = notes.groupBy(F.col(owner_declared).alias("owner")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).withColumn("basis", F.lit("declared")).withColumn("related", F.lit(None).cast(notes.schema[related].dataType))
    audited = notes.groupBy(F.col(owner_audited).alias("owner")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.sum(related).alias("related")).withColumn("basis", F.lit("audited"))
    return declared.unionByName(audited, allowMissingColumns=True).filter("owner IS NOT NULL")


def affected(key: str, **roles: tuple[DataFrame, str]) -> DataFrame:
    """The distinct owners that any of several roles names."""
    rows = [df.select(F.col(c).alias(key)) for df, c in roles.values()]
    return reduce(lambda a, b: a.unionByName(b), rows).filter(F.col(key).isNotNull()).distinct()


def same_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: whether two lists hold the same keys, each once: numbers, distinct numbers, and keys that only one side has."""
    sides = left.select(F.col(key).alias("k"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(F.col(key).alias("k"), F.lit(0).alias("l"), F.lit(1).alias("r")))
    by_key = sides.groupBy("k").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    counts = by_key.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in (("l", "n_left"), ("r", "n_right"))), F.count_if((F.col("l") > 0) & (F.col("r") == 0)).alias("only_left"), F.count_if((F.col("l") == 0) & (F.col("r") > 0)).alias("only_right"), F.count_if((F.col("l") > 1) | (F.col("r") > 1)).alias("repeated"))
    return counts.withColumn("same", (F.col("only_left") == 0) & (F.col("only_right") == 0) & (F.col("repeated") == 0))


def shape(uploads: DataFrame, kind: str, owner: str, expected: dict[str, dict[str, int]], part: str) -> DataFrame:
    """(owner, kind, part, n, expected) of uploads whose parts aren't there in the exact number that their kind asks for."""
    rules = [(k, p, n) for k, parts in expected.items() for p, n in parts.items()]
    asked = uploads.sparkSession.createDataFrame(rules, f"{kind} string, {part} string, expected long")
    found = uploads.groupBy(owner, kind, part).agg(F.count("*").alias("n"))
    wanted = uploads.select(owner, kind).distinct().join(F.broadcast(asked), kind)  # a handful of rules
    both = wanted.join(found, [owner, kind, part], "full")
    zero = F.lit(0).cast("long")
    return both.select(owner, kind, part, F.coalesce("n", zero).alias("n"), F.coalesce("expected", zero).alias("expected")).filter(F.col("n") != F.col("expected"))


def verify_snapshots(snapshots: DataFrame, content: str, hashes: tuple[str, ...], columns: dict[str, str]) -> DataFrame:
    """``snapshots`` with ``issue``: hash (no stored hash fits the content) or columns (a column differs from the content's JSON)."""
    own = F.sha2(F.col(content), 256)
    fits, same = F.lit(False), F.lit(True)
    for h in hashes:
        fits = fits | F.coalesce(F.col(h) == own, F.lit(False))
    for c, path in columns.items():
        same = same & F.col(c).cast("string").eqNullSafe(F.get_json_object(content, path))
    return snapshots.withColumn("issue", F.when(~fits, "hash").when(~same, "columns"))
