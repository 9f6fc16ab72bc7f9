"""Reconciling an incoming batch of lines with stable records.

Lines: line, target record (from a match or a decision), payload (map), provenance (map, may be null).
Records: record, payload, provenance, layer (1 source, 2 adjustment, 3 decision), state (active or disregarded).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.storage import drop_written, tidied, written

#: What decisions a conflict allows.
ALLOWED = {"PROTECTED_LAYER": ("link", "keep", "reject"), "DISREGARDED": ("reject",), "NO_CANDIDATE": ("link", "create", "reject"), "MULTIPLE": ("link", "create", "reject"), "DUPLICATE_TARGET": ("link", "create", "reject")}
#: Keys of payloads that matching reserves.
RESERVED = ("curso", "trilha")
#: What a decision changes in a line.
DECIDED = ("category", "conflict", "target", "outcome", "decided_at")
#: Lines and decisions of a part that one task folds at most.
IN_TASK = 400_000


def entries(payload: Column) -> Column:
    """A map in a form that can be compared; null stays null, apart from the empty map."""
    return F.array_sort(F.map_entries(payload))


def same_content(a: str, b: str, parts: tuple[str, ...] = ("payload", "provenance")) -> Column:
    """Whether two sides agree in payload (without reserved keys) and provenance; null differs from empty."""
    same = F.lit(True)
    for part in parts:
        left, right = (F.map_filter(F.col(f"{side}{part}"), lambda k, v: ~k.isin(*RESERVED)) for side in (a, b))
        same = same & entries(left).eqNullSafe(entries(right))
    return same


def classify(lines: DataFrame, matches: DataFrame, records: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Each line's category (unchanged, updated, created, rejected, kept, conflict), conflict code and target.

    Decisions (line, outcome, record) come before the match. Then a missing or ambiguous target, a disregarded
    record, and a protected layer with other content are conflicts. Last, lines that are accepted on the
    same record make each other conflicts.
    """
    out = lines.join(matches.select("line", "match", F.col("record").alias("_matched")), "line", "left")
    if decisions is None:
        out = out.withColumns({"outcome": F.lit(None).cast("string"), "_decided": F.lit(None).cast("long")})
    else:
        out = out.join(decisions.select("line", "outcome", F.col("record").alias("_decided")), "line", "left")
    out = out.withColumn("target", F.when(F.col("outcome") == "create", None).otherwise(F.coalesce("_decided", "_matched")))
    held = records.select(F.col("record").alias("target"), *(F.col(c).alias(f"_old_{c}") for c in ("payload", "provenance", "layer", "state")))
    out = out.join(held, "target", "left").withColumn("_same", same_content("", "_old_"))
    conflict = (
        F.when(F.col("outcome").isin("reject", "keep", "create"), None)
        .when(F.col("target").isNull() & (F.col("match") == "multiple"), "MULTIPLE")
        .when(F.col("target").isNull() | F.col("_old_state").isNull(), "NO_CANDIDATE")
        .when(F.col("_old_state") == "disregarded", "DISREGARDED")
        .when((F.col("_old_layer") > 1) & ~F.col("_same") & F.col("outcome").isNull(), "PROTECTED_LAYER")
    )
    category = (
        F.when(F.col("outcome") == "reject", "rejected")
        .when(F.col("outcome") == "keep", "kept")
        .when(F.col("outcome") == "create", "created")
        .when(F.col("conflict").isNotNull(), "conflict")
        .when(F.col("_same"), "unchanged")
        .otherwise("updated")
    )
    out = out.withColumn("conflict", conflict).withColumn("category", category)
    return duplicate_targets(out).drop("_same", "_matched", "_decided", "_old_payload", "_old_provenance", "_old_layer", "_old_state")


def duplicate_targets(lines: DataFrame) -> DataFrame:
    """Accepted lines that share a record become conflicts."""
    taken = F.col("category").isin("unchanged", "updated", "kept")
    counts = lines.filter(taken & F.col("target").isNotNull()).groupBy("target").agg(F.count("*").alias("_n")).filter("_n > 1")
    out = lines.join(counts, "target", "left")
    twice = taken & F.col("_n").isNotNull()
    return out.withColumns({"conflict": F.when(twice, "DUPLICATE_TARGET").otherwise(F.col("conflict")), "category": F.when(twice, "conflict").otherwise(F.col("category"))}).drop("_n")


def absences(records: DataFrame, classified: DataFrame) -> DataFrame:
    """Active records that no line observes; a rejected line still observes the record it matched."""
    seen = classified.filter("target IS NOT NULL").select(F.col("target").alias("record")).distinct()
    return records.filter("state = 'active'").join(seen, "record", "left_anti").select("record")


def summary(classified: DataFrame, absent: DataFrame) -> DataFrame:
    """One row: lines of each category, all of them, conflicts that wait, absent records."""
    count = lambda c: F.count_if(F.col("category") == c).alias(f"n_{c}")
    lines = classified.agg(*(count(c) for c in ("unchanged", "updated", "created", "rejected", "kept", "conflict")), F.count("*").alias("n_lines"))
    return lines.crossJoin(absent.agg(F.count("*").alias("n_absent")))  # one row each


def field_diffs(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, field, before, after, kind) for each field whose presence or value differs; a null value isn't a missing field.

    Where both maps are empty but one is null, the row's field is ``*``.
    """
    fields = F.array_distinct(F.concat(F.coalesce(F.map_keys(before), F.array().cast("array<string>")), F.coalesce(F.map_keys(after), F.array().cast("array<string>"))))
    whole = F.when(F.col(before).isNull() != F.col(after).isNull(), F.array(F.lit("*"))).otherwise(F.array().cast("array<string>"))
    rows = pairs.select(key, before, after, F.explode(F.when(F.size(fields) == 0, whole).otherwise(fields)).alias("field"))
    there = lambda side: F.coalesce(F.map_contains_key(side, F.col("field")), F.lit(False))
    value = lambda side: F.when(there(side), F.try_element_at(side, F.col("field")))
    kind = F.when(F.col("field") == "*", "whole").when(~there(before), "added").when(~there(after), "removed").otherwise("changed")
    differs = (F.col("field") == "*") | (there(before) != there(after)) | ~value(before).eqNullSafe(value(after))
    return rows.filter(differs).select(key, "field", value(before).alias("before"), value(after).alias("after"), kind.alias("kind"))


def resolve_decisions(decisions: DataFrame) -> DataFrame:
    """The decision in force for each line: the one of the highest revision, later ones of equal revision win."""
    best = F.max_by(F.struct("outcome", "record"), F.struct("revision", "decision_id"))
    return decisions.groupBy("line").agg(best.alias("_d"), F.max("revision").alias("revision")).select("line", "_d.outcome", "_d.record", "revision")


def decisions_for(lines: DataFrame, decisions: DataFrame) -> DataFrame:
    """(line, outcome, record, revision, by) for lines (line, observation, locator) that a decision reaches.

    Decisions (observation, locator, outcome, record, revision, decision_id) are found by observation and locator, and where there is
    none by observation alone; of several that of the highest revision counts, of equal ones the later. A null locator is an empty one.
    """
    best = F.max_by(F.struct("outcome", "record", "revision"), F.struct(F.coalesce("revision", F.lit(0)), "decision_id"))
    placed = decisions.withColumn("locator", F.coalesce("locator", F.lit("")))
    exact = placed.groupBy("observation", "locator").agg(best.alias("_exact"))
    whole = placed.groupBy("observation").agg(best.alias("_whole"))
    found = lines.select("line", "observation", F.coalesce("locator", F.lit("")).alias("locator")).join(exact, ["observation", "locator"], "left").join(whole, "observation", "left")
    chosen = F.coalesce("_exact", "_whole")
    return found.filter(chosen.isNotNull()).select("line", chosen["outcome"].alias("outcome"), chosen["record"].alias("record"), chosen["revision"].alias("revision"), F.when(F.col("_exact").isNotNull(), "locator").otherwise("observation").alias("by"))


def typed_diffs(pairs: DataFrame, key: str, kinds: dict[str, tuple[str, str]]) -> DataFrame:
    """(key, place, field, before, after, kind, source) of all kinds of content of a record, in the order of field, then of kind.

    ``kinds``: payload, decimal-source, duration-source, each with its columns before and after (maps); ``source`` names
    the kind, ``kind`` what happened. A kind whose map appears or goes while it is empty has the field ``*``.
    """
    parts = [field_diffs(pairs, key, *columns).withColumns({"source": F.lit(name), "_rank": F.lit(rank)}) for rank, (name, columns) in enumerate(kinds.items())]
    every = reduce(DataFrame.unionByName, parts)
    # The diffs of one record are few: as many as it has fields.
    place = F.row_number().over(Window.partitionBy(key).orderBy("field", "_rank"))
    return every.select(key, place.cast("long").alias("place"), "field", "before", "after", "kind", "source")


def check_decisions(decisions: DataFrame, classified: DataFrame) -> DataFrame:
    """Decisions with ``verdict``: applied, not_pending (no conflict waits), or not_allowed for the conflict's code."""
    open_lines = classified.select("line", "conflict")
    fits = _allowed(F.col("conflict"), F.col("outcome"))
    return decisions.join(open_lines, "line", "left").withColumn("verdict", F.when(F.col("conflict").isNull(), "not_pending").when(fits, "applied").otherwise("not_allowed"))


def materialize(root: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A manifest under changed lines: for each line the change of the highest revision, the original order kept."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(*fields), "revision").alias("_c"), F.max("revision").alias("_r"))
    out = root.join(last, key, "left")
    return out.select(*(F.when(F.col("_r").isNotNull(), F.col(f"_c.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in root.columns), F.coalesce("_r", F.lit(0)).alias("revision"))


def events(classified: DataFrame, observation: str) -> DataFrame:
    """The events that applying a batch appends: a source event for each accepted line, an audit event for decided ones."""
    accepted = F.col("category").isin("unchanged", "updated", "created", "kept")
    source = F.when(accepted, F.struct(F.lit("source").alias("type"), F.lit(1).alias("precedence")))
    audit = F.when(F.col("outcome").isin("link", "keep"), F.struct(F.lit("audit").alias("type"), F.lit(3).alias("precedence")))
    made = classified.select("line", "target", "category", F.explode(F.array_compact(F.array(source, audit))).alias("_e"))
    return made.select(F.md5(F.concat_ws(":", F.lit(observation), F.col("line").cast("string"), F.col("_e.type"))).alias("event_id"), "line", "target", "_e.type", "_e.precedence")


def metrics(records: DataFrame, classified: DataFrame, value: str, record_value: str) -> DataFrame:
    """Totals over effective records and accepted lines: a line replaces its record's value, the first line of a record counts."""
    accepted = classified.filter(F.col("category").isin("unchanged", "updated"))
    chosen = accepted.groupBy(F.col("target").alias("record")).agg(F.min_by(value, "line").alias("_line"))
    kept = records.filter("state = 'active'").join(chosen, "record", "left").select(F.coalesce("_line", record_value).alias("value"))
    created = classified.filter("category = 'created'").select(F.col(value).alias("value"))
    both = kept.unionByName(created)
    return both.agg(F.count("*").alias("n_sources"), F.count("value").alias("n_values"), F.sum("value").alias("total"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of edges (a, b): the smallest node that each can reach. A step halves paths, so steps are logarithmic; no group is gathered."""
    pairs = written(edges.filter("a != b").select("a", "b").distinct(), "pairs")
    seen = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("_m"))
        # Neighbours that are larger meet the smallest one, then each node's smaller neighbours meet their smallest.
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(least, "a").filter("b != _m").select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(least.select("a", F.col("_m").alias("b"))).distinct()
        before, pairs = pairs, written(small, "pairs")
        drop_written(before)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        seen = now


def _allowed(conflict: Column, outcome: Column) -> Column:
    fits = F.lit(False)
    for code, outcomes in ALLOWED.items():
        fits = fits | ((conflict == code) & outcome.isin(*outcomes))
    return F.coalesce(fits, F.lit(False))


def _folded_part(rows: list[tuple]) -> Iterator[tuple]:
    """(revision, line, category, conflict, target, outcome, decided_at) of every line that a revision changes in one part.

    ``rows``: (revision, line, outcome, record, state of the record, category, conflict, target); lines first, with a null revision.
    """
    lines = {line: [category, conflict, target, outcome, 0] for revision, line, outcome, _, _, category, conflict, target in rows if revision is None}
    members: dict[int, set[int]] = {}
    joined = lambda s: s[2] is not None and (s[0] in ("unchanged", "updated", "kept") or s[1] == "DUPLICATE_TARGET")
    for line, s in lines.items():
        if joined(s):
            members.setdefault(s[2], set()).add(line)
    for revision, same in groupby((r for r in rows if r[0] is not None), lambda r: r[0]):
        # All decisions of a revision are held against what was before it.
        stand = [r for r in same if r[2] in ALLOWED.get(lines[r[1]][1], ())]
        changed = {r[1] for r in stand}
        for _, line, *_ in stand:
            members.get(lines[line][2], set()).discard(line)
        fresh: dict[int, list[int]] = {}
        for _, line, outcome, record, there, *_ in stand:
            s = lines[line]
            s[2] = record if outcome == "link" else None if outcome == "create" else s[2]
            s[0] = {"reject": "rejected", "keep": "kept", "create": "created"}.get(outcome) or ("updated" if there == "active" else "conflict")
            s[1] = None if outcome != "link" or there == "active" else "NO_CANDIDATE" if there is None else "DISREGARDED" if there == "disregarded" else None
            s[3:] = outcome, revision
            if joined(s):
                fresh.setdefault(s[2], []).append(line)
        for target, new in fresh.items():
            own = members.setdefault(target, set())
            # Where two or more were before, they are in conflict already.
            for line in [*new, *(own if len(own) == 1 else ())] if len(own) + len(new) > 1 else ():
                lines[line][:2] = "conflict", "DUPLICATE_TARGET"
            changed |= {*new, *own} if len(own) < 2 else set(new)
            own.update(new)
        yield from ((revision, line, *lines[line]) for line in changed)


def _in_tasks(state: DataFrame, due: DataFrame) -> DataFrame:
    """Versions of the lines of parts that fit a task: state (with _part) and due (with _part and _there)."""
    decided = StructType([StructField("revision", IntegerType()), *(state.schema[c] for c in ("line", *DECIDED))])

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            out = []
            for part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    out += _folded_part(held)
                    now, held = part, []
                held.append(tuple(row))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=decided.names)
        out = list(_folded_part(held))
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=decided.names)

    types = [to_arrow_type(f.dataType) for f in decided.fields]
    none = lambda c: F.lit(None).cast("string").alias(c)
    begin = state.select("_part", F.lit(None).cast("int").alias("revision"), "line", "outcome", F.lit(None).cast(due.schema["record"].dataType).alias("record"), none("_there"), "category", "conflict", "target")
    steps = due.select("_part", "revision", "line", "outcome", "record", "_there", none("category"), none("conflict"), F.lit(None).cast(state.schema["target"].dataType).alias("target"))
    rows = begin.unionByName(steps).repartition("_part").sortWithinPartitions("_part", F.col("revision").asc_nulls_first())
    return rows.mapInArrow(folded, decided)


def _played(rows: list[tuple]) -> Iterator[tuple]:
    """(revision, category, conflict, target, outcome, decided_at, left, joined) of every version of one line, as its buckets' clocks say.

    ``rows``: (revision, outcome, record, state of the record, category, conflict, target, clash, next); the line first, with revision 0.
    """
    _, outcome, _, _, category, conflict, target, _, turn = rows[0]
    at, member = 0, target is not None and (category in ("unchanged", "updated", "kept") or conflict == "DUPLICATE_TARGET")
    turn = turn if member and conflict is None else None
    for revision, own, record, there, _, _, _, clash, following in rows[1:]:
        if turn is not None and turn < revision:
            category, conflict = "conflict", "DUPLICATE_TARGET"
            yield turn, category, conflict, target, outcome, at, None, None
            turn = None
        if own not in ALLOWED.get(conflict, ()):
            continue
        left, outcome, at = target if member else None, own, revision
        target = record if own == "link" else None if own == "create" else target
        category = {"reject": "rejected", "keep": "kept", "create": "created"}.get(own) or ("updated" if there == "active" else "conflict")
        conflict = None if own != "link" or there == "active" else "NO_CANDIDATE" if there is None else "DISREGARDED" if there == "disregarded" else None
        member = target is not None and category in ("updated", "kept")
        if member and clash:
            category, conflict = "conflict", "DUPLICATE_TARGET"
        turn = following if member and not clash else None
        yield revision, category, conflict, target, outcome, at, left, target if member else None
    if turn is not None:
        yield turn, "conflict", "DUPLICATE_TARGET", target, outcome, at, None, None


def _clock(events: DataFrame) -> DataFrame:
    """(_bucket, revision, _clash, _next) of events (_bucket, revision, _joined, _left): whether lines that join then meet others, and when the next ones join.

    A bucket has a row a revision at most, whatever its lines.
    """
    each = events.groupBy("_bucket", "revision").agg(F.sum("_joined").alias("_joined"), F.sum("_left").alias("_left"))
    forward, back = Window.partitionBy("_bucket").orderBy("revision"), Window.partitionBy("_bucket").orderBy(F.col("revision").desc())
    there = F.sum(F.col("_joined") - F.col("_left")).over(forward.rowsBetween(Window.unboundedPreceding, 0))
    following = F.min(F.when(F.col("_joined") > 0, F.col("revision"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    return each.select("_bucket", "revision", (there > 1).alias("_clash"), following.alias("_next"))


def _in_rounds(state: DataFrame, due: DataFrame) -> DataFrame:
    """Versions of the lines of ``state`` under all decisions of ``due`` (line, outcome, record, revision, _there), however many share a bucket.

    A line asks its buckets only two things: whether others are there when it joins, and when the next ones join. With these
    clocks given, each line is played by itself; what the lines then do gives the clocks anew, until they stay as they are. What
    happens at a revision depends on earlier ones alone (and on departures of the same one, which do too), so clocks that
    stay are the only ones, and a round settles at least one more revision: there are at most as many rounds as the longest
    chain of decisions that really change one another's outcome, and one more to see it.
    """
    state = written(state.select("line", *DECIDED), "fold")
    none = lambda kind, c: F.lit(None).cast(kind).alias(c)
    record, target = due.schema["record"].dataType, state.schema["target"].dataType
    goal = F.when((F.col("outcome") == "link") & (F.col("_there") == "active"), F.col("record")).when((F.col("outcome") == "keep") & (F.col("_conflict") == "PROTECTED_LAYER"), F.col("_from"))
    steps = due.join(state.select("line", F.col("conflict").alias("_conflict"), F.col("target").alias("_from")), "line")
    steps = steps.select("line", "revision", "outcome", "record", "_there", none("string", "category"), none("string", "conflict"), none(target, "target"), goal.alias("_bucket"))
    member = (F.col("category").isin("unchanged", "updated", "kept") | (F.col("conflict") == "DUPLICATE_TARGET")) & F.col("target").isNotNull()
    lone = F.coalesce(member & F.col("conflict").isNull(), F.lit(False))
    decided = due.select("line").distinct().withColumn("_due", F.lit(True))
    # Lines without decisions only turn, if they are alone in their bucket.
    begin = state.join(decided, "line", "left").filter(F.coalesce("_due", F.lit(False)) | lone)
    begin = begin.select("line", F.lit(0).alias("revision"), "outcome", none(record, "record"), none("string", "_there"), "category", "conflict", "target", F.when(lone, F.col("target")).alias("_bucket"))
    plan = written(begin.unionByName(steps), "plan")
    event = lambda df, bucket, joined, left: df.select(F.col(bucket).alias("_bucket"), "revision", joined.cast("long").alias("_joined"), left.cast("long").alias("_left"))
    one, zero = F.lit(1), F.lit(0)
    asked = plan.filter("_bucket IS NOT NULL AND revision > 0").select("_bucket", "revision").distinct()
    asked = written(asked, "clock")
    there = state.filter(member).groupBy(F.col("target").alias("_bucket")).agg(F.count("*").alias("_n")).join(asked.select("_bucket"), "_bucket", "left_semi")
    fixed = written(event(asked, "_bucket", zero, zero).unionByName(event(there.withColumn("revision", zero), "_bucket", F.col("_n"), zero)), "clock")
    # At first all are thought to join that might.
    clock = written(_clock(fixed.unionByName(event(plan.filter("_bucket IS NOT NULL AND revision > 0"), "_bucket", one, zero))), "clock")
    made = StructType([StructField("revision", IntegerType()), *(state.schema[c] for c in ("line", *DECIDED)), StructField("_left", target), StructField("_joined", target)])
    types = [to_arrow_type(f.dataType) for f in made.fields]

    def played(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        shown = lambda out: pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=made.names)
        for batch in batches:
            out = []
            for line, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if line != now:
                    out += ((v[0], now, *v[1:]) for v in (_played(held) if held else ()))
                    now, held = line, []
                held.append(tuple(row))
            yield shown(out)
        yield shown([(v[0], now, *v[1:]) for v in (_played(held) if held else ())])

    while True:
        # Steps that ask no bucket don't meet the clocks, so that they don't meet in one task.
        timed = plan.filter("_bucket IS NOT NULL").join(clock, ["_bucket", "revision"], "left").unionByName(plan.filter("_bucket IS NULL"), allowMissingColumns=True)
        rows = timed.select("line", "revision", "outcome", "record", "_there", "category", "conflict", "target", "_clash", "_next").repartition("line").sortWithinPartitions("line", "revision")
        versions = written(rows.mapInArrow(played, made), "versions")
        moves = event(versions.filter("_joined IS NOT NULL"), "_joined", one, zero).unionByName(event(versions.filter("_left IS NOT NULL"), "_left", zero, one))
        after = written(_clock(fixed.unionByName(moves.join(asked.select("_bucket"), "_bucket", "left_semi"))), "clock")
        old = clock.select("_bucket", "revision", F.struct("_clash", "_next").alias("_old"))
        same = after.join(old, ["_bucket", "revision"], "full").join(fixed.select("_bucket", "revision"), ["_bucket", "revision"], "left_semi").filter(~F.struct("_clash", "_next").eqNullSafe(F.col("_old"))).isEmpty()
        drop_written(clock)
        if same:
            return versions.drop("_left", "_joined")
        clock = after
        drop_written(versions)


def decision_versions(lines: DataFrame, decisions: DataFrame, records: DataFrame, matches: DataFrame, last: int, in_task: int = IN_TASK) -> DataFrame:
    """Every version of every line: all as classified, at revision 0, then each line that a revision of decisions (from 1 up to ``last``) changes, in their order.

    The order matters: a decision stands only if its line waits in a conflict then, and a target that an
    accepted line took makes the next one on it a conflict. A revision holds one decision a line (the later by id).

    Lines act on each other only through records that they share, so the lines are parted by the records that their
    targets and links connect. A part of up to ``in_task`` lines and decisions is folded inside a task, whatever its number of
    revisions; larger ones are played line by line by :func:`_in_rounds`, which needs of a bucket only its clock.
    """
    with tidied() as keep:
        return keep(_versions(lines, decisions, records, matches, last, in_task))


def fold_decisions(lines: DataFrame, decisions: DataFrame, records: DataFrame, matches: DataFrame, last: int, in_task: int = IN_TASK) -> DataFrame:
    """Lines after every revision of decisions: the last of their versions."""
    versions = decision_versions(lines, decisions, records, matches, last, in_task)
    return replayed(versions.filter("revision = 0"), versions.filter("revision > 0"), last)


def replayed(base: DataFrame, versions: DataFrame, last: int) -> DataFrame:
    """Lines of a materialisation under the versions (revision, line and what decisions change) up to revision ``last``."""
    final = versions.filter(F.col("revision") <= last).groupBy("line").agg(F.max_by(F.struct(*DECIDED), "revision").alias("_f"))
    rest = base.drop("revision")
    return rest.join(final, "line", "left").select(*(F.when(F.col("_f").isNotNull(), F.col("_f")[c]).otherwise(F.col(c)).alias(c) if c in DECIDED else F.col(c) for c in rest.columns))


def _versions(lines: DataFrame, decisions: DataFrame, records: DataFrame, matches: DataFrame, last: int, in_task: int) -> DataFrame:
    start = written(classify(lines, matches, records).withColumn("decided_at", F.lit(0)), "fold")
    first = start.select(F.lit(0).alias("revision"), *start.columns)
    due = decisions.filter(F.col("revision").between(1, last)).groupBy("line", F.col("revision").cast("int").alias("revision")).agg(F.max_by(F.struct("outcome", "record"), "decision_id").alias("_d"))
    due = written(due.select("line", "revision", "_d.outcome", "_d.record").join(start.select("line", F.col("target").alias("_from"), F.col("conflict").alias("_conflict")), "line"), "due")
    # A line without conflict waits for no decision unless another can join its bucket; its decisions change nothing.
    goal = F.when(F.col("outcome") == "link", F.col("record")).when((F.col("outcome") == "keep") & (F.col("_conflict") == "PROTECTED_LAYER"), F.col("_from"))
    goals = due.select(goal.alias("_from")).filter("_from IS NOT NULL").distinct()
    waits = due.filter("_conflict IS NOT NULL").unionByName(due.filter("_conflict IS NULL AND _from IS NOT NULL").join(goals, "_from", "left_semi"))
    due = written(waits.drop("_conflict"), "due")
    if due.isEmpty():
        return first
    reach = due.select("line", F.explode(F.array_compact(F.array("_from", F.when(F.col("outcome") == "link", F.col("record"))))).alias("_r")).distinct()
    low = written(reach.groupBy("line").agg(F.min("_r").alias("_low")), "low")
    root = connected(reach.join(low, "line").filter("_r > _low").select(F.col("_r").alias("a"), F.col("_low").alias("b")))
    of_record = reach.select("_r").distinct().join(root, F.col("_r") == F.col("node"), "left").select("_r", F.concat(F.lit("record "), F.coalesce("root", "_r").cast("string")).alias("_part"))
    of_line = due.select("line").distinct().join(low, "line", "left").join(of_record, F.col("_low") == F.col("_r"), "left")
    of_line = written(of_line.select("line", F.coalesce("_part", F.concat(F.lit("line "), F.col("line").cast("string"))).alias("_own")), "own")
    parts = start.select("line", *DECIDED).join(of_record, F.col("target") == F.col("_r"), "left").join(of_line, "line", "left").select("line", *DECIDED, F.coalesce("_own", "_part").alias("_part"))
    parts = written(parts.filter("_part IS NOT NULL"), "parts")
    held = records.select(F.col("record").alias("target"), F.col("state").alias("_state"))
    due = due.join(of_line, "line").withColumnRenamed("_own", "_part").join(held.withColumnRenamed("target", "_t"), (F.col("record") == F.col("_t")) & (F.col("outcome") == "link"), "left")
    due = written(due.select("_part", "line", "outcome", "record", "revision", F.col("_state").alias("_there")), "due")
    sizes = parts.select("_part").unionByName(due.select("_part")).groupBy("_part").agg(F.count("*").alias("_n"))
    large = written(sizes.filter(F.col("_n") > in_task).select("_part"), "large")
    small_due, small_state = due.join(large, "_part", "left_anti"), parts.join(large, "_part", "left_anti")
    changes = _in_tasks(small_state.join(small_due.select("_part").distinct(), "_part", "left_semi"), small_due)
    if not large.isEmpty():
        changes = changes.unionByName(_in_rounds(parts.join(large, "_part", "left_semi"), due.join(large, "_part", "left_semi")))
    # Of what lines are before any decision, later versions repeat only their names.
    return first.unionByName(written(changes, "versions"), allowMissingColumns=True)


def decision_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Lines on which two materialisations differ: (line, from_category, to_category, from_target, to_target)."""
    side = lambda df, p: df.select("line", *(F.col(c).alias(f"{p}_{c}") for c in ("category", "target")))
    both = side(before, "from").join(side(after, "to"), "line", "full")
    return both.filter(~F.struct("from_category", "from_target").eqNullSafe(F.struct("to_category", "to_target")))


def apply_gates(classified: DataFrame, base_version: int, current_version: int) -> DataFrame:
    """(gate, holds) that must all hold before a batch is applied."""
    accepted = F.col("category").isin("unchanged", "updated", "kept")
    targets = classified.filter(accepted & F.col("target").isNotNull()).groupBy("target").count().filter("count > 1")
    waiting = classified.agg((F.count_if(F.col("category") == "conflict") == 0).alias("holds")).select(F.lit("nothing_waits").alias("gate"), "holds")
    unique = targets.agg((F.count("*") == 0).alias("holds")).select(F.lit("unique_targets").alias("gate"), "holds")
    version = classified.sparkSession.range(1).select(F.lit("base_version").alias("gate"), F.lit(base_version == current_version).alias("holds"))
    return waiting.unionByName(unique).unionByName(version)


def append_events(ledger: DataFrame, made: DataFrame) -> DataFrame:
    """Events of a batch that the ledger doesn't hold yet: a replayed batch appends none."""
    return made.dropDuplicates(["event_id"]).join(ledger.select("event_id"), "event_id", "left_anti")
