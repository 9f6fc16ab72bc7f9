"""What a batch should have come to, derived again from the evidence, and how a submitted result differs.

It shares no code with ``reconcile``: contents are compared as sets of entries, not as maps, categories are sets that a
line is in (one in two of them, or in none, shows), and absences are a difference of sets. So a fault of one derivation
shows as a difference, whichever side has it.

All tables grow with the batch, but as Parquet they are many times smaller than in memory, so that Spark would take them
for small enough to broadcast. Every join of two of them is a merge join by hint, or a full one.

Evidence: lines (line, ``attributes``, payload, provenance), records (record, ``attributes``, payload, provenance, layer, state),
decisions (line, outcome, record, revision, decision_id). Submitted: classified (line, observation, match, n_candidates, target,
conflict, category), diffs (line, field, before, after, kind), absent (record), summary (one row of numbers, ``n_<category>``, ``n_lines``, ``n_absent``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import written

#: Keys of payloads that are for matching alone.
MATCHING_KEYS = ("curso", "trilha")
_NAMES = ("unchanged", "updated", "created", "rejected", "kept", "conflict")


def _so(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _entries(rows: DataFrame, part: str) -> Column:
    """The entries of a map, none for null."""
    none = F.create_map().cast(rows.schema[part].dataType)
    return F.filter(F.map_entries(F.coalesce(F.col(part), none)), lambda e: ~e["key"].isin(*MATCHING_KEYS))


def _differing(pairs: DataFrame) -> DataFrame:
    """Pairs of a line (payload, provenance) and its record (_payload, _provenance) with ``_diffs`` of the payload (field, before, after, kind) and whether they differ at all."""
    parts = ("payload", "provenance")
    for part in parts:
        own, old = _entries(pairs, part), _entries(pairs, f"_{part}")
        pairs = pairs.withColumns({f"_own_{part}": F.array_except(own, old), f"_old_{part}": F.array_except(old, own)})
    own, old = F.col("_own_payload"), F.col("_old_payload")
    of = lambda entries, e: F.filter(entries, lambda o: o["key"] == e["key"])
    shown = lambda field, before, after, kind: F.struct(field.alias("field"), before.alias("before"), after.alias("after"), kind.alias("kind"))
    came = F.transform(own, lambda e: shown(e["key"], F.get(of(old, e), 0)["value"], e["value"], F.when(F.size(of(old, e)) > 0, "changed").otherwise("added")))
    went = F.transform(F.filter(old, lambda e: F.size(of(own, e)) == 0), lambda e: shown(e["key"], e["value"], F.lit(None).cast("string"), F.lit("removed")))
    # A map that comes or goes differs even if it is empty.
    apart = reduce(Column.__or__, ((F.size(f"_own_{p}") > 0) | (F.size(f"_old_{p}") > 0) | (F.col(p).isNull() != F.col(f"_{p}").isNull()) for p in parts))
    return pairs.withColumns({"_diffs": F.concat(came, went), "_differs": apart})


def _candidates(lines: DataFrame, records: DataFrame, attributes: list[str]) -> DataFrame:
    """(line, n_candidates, match, record) by counts of the records of each combination; a blank attribute matches none."""
    full = reduce(Column.__and__, (_so(F.trim(F.col(a).cast("string")) != "") for a in attributes))
    counts = records.filter(full).groupBy(*attributes).agg(F.count("*").alias("_n"), F.max("record").alias("_only"))
    met = lines.filter(full).hint("merge").join(counts, attributes, "left").select("line", "_n", "_only")
    found = met.unionByName(lines.filter(~full).select("line"), allowMissingColumns=True)
    n = F.coalesce("_n", F.lit(0))
    match = F.when(n == 0, "none").when(n == 1, "unique").otherwise("multiple")
    return found.select("line", n.cast("long").alias("n_candidates"), match.alias("match"), F.when(n == 1, F.col("_only")).alias("record"))


def derive(lines: DataFrame, records: DataFrame, decisions: DataFrame, attributes: list[str], batch: str) -> dict[str, DataFrame]:
    """classified, diffs, absent and summary as they should be."""
    first = F.row_number().over(Window.partitionBy("line").orderBy(F.col("revision").desc(), F.col("decision_id").desc()))  # a line has few decisions
    decided = decisions.withColumn("_n", first).filter("_n = 1").select("line", "outcome", F.col("record").alias("decided"), F.lit(True).alias("_decided"))
    of = lambda *outcomes: _so(F.col("outcome").isin(*outcomes))
    # Targets: those that decisions name, else the only candidate; created lines have none.
    named = _so(F.col("decided").isNotNull() & (F.col("outcome") != "create"))
    target = F.when(named, F.col("decided")).when(~of("create"), F.col("record"))
    found = _candidates(lines.select("line", *attributes), records, attributes).join(decided.hint("merge"), "line", "left")
    found = written(found.select("line", "match", "n_candidates", "outcome", _so(F.col("_decided")).alias("_decided"), target.alias("target")), "targets")
    pairs = found.filter("target IS NOT NULL").select("line", "target").hint("merge")
    held = records.select(F.col("record").alias("target"), F.col("payload").alias("_payload"), F.col("provenance").alias("_provenance"), "layer", "state").hint("merge")
    live = _differing(lines.select("line", "payload", "provenance").join(pairs, "line").join(held, "target"))
    live = written(live.select("line", "layer", "state", "_diffs", "_differs", F.lit(True).alias("_held")), "live")
    there, differs = _so(F.col("_held")), _so(F.col("_differs"))
    open_ = ~of("reject", "keep", "create")
    ambiguous = open_ & F.col("target").isNull() & (F.col("match") == "multiple")
    gone = open_ & there & _so(F.col("state") == "disregarded")
    fit = open_ & there & ~gone
    guarded = fit & _so(F.col("layer") > 1) & differs & ~F.col("_decided")
    sets = [(of("reject"), "rejected", None), (of("keep"), "kept", None), (of("create"), "created", None), (ambiguous, "conflict", "MULTIPLE"), (open_ & ~there & ~ambiguous, "conflict", "NO_CANDIDATE"), (gone, "conflict", "DISREGARDED"), (guarded, "conflict", "PROTECTED_LAYER"), (fit & ~guarded & differs, "updated", None), (fit & ~guarded & ~differs, "unchanged", None)]
    within = F.array_compact(F.array(*(F.when(s, F.struct(F.lit(c).alias("category"), F.lit(k).cast("string").alias("conflict"))) for s, c, k in sets)))
    placed = found.hint("merge").join(live.drop("_diffs"), "line", "left").withColumn("_set", F.explode(within))
    placed = written(placed.select("line", "match", "n_candidates", "target", "_set.category", "_set.conflict"), "placed")
    taking = F.col("category").isin("unchanged", "updated", "kept") & F.col("target").isNotNull()
    taken = placed.filter(taking)
    crowded = taken.groupBy("target").agg(F.count("*").alias("_n")).filter("_n > 1").select("target", F.lit(True).alias("_twice")).hint("merge")
    twice = _so(F.col("_twice"))
    taken = taken.join(crowded, "target", "left").withColumns({"category": F.when(twice, "conflict").otherwise(F.col("category")), "conflict": F.when(twice, "DUPLICATE_TARGET").otherwise(F.col("conflict"))})
    own = F.md5(F.concat(F.lit(f"{batch}:"), F.col("line").cast("string")))
    whole = taken.select(placed.columns).unionByName(placed.filter(~taking))
    classified = written(whole.select("line", "category", "conflict", "target", "match", "n_candidates"), "derived").withColumn("observation", own)
    # A difference of sets without a join: records that only the first side has.
    seen = records.filter("state = 'active'").select("record", F.lit(False).alias("_seen")).unionByName(pairs.select(F.col("target").alias("record"), F.lit(True).alias("_seen")))
    absent = written(seen.groupBy("record").agg(F.max("_seen").alias("_seen")).filter("NOT _seen").select("record"), "absent")
    counts = classified.groupBy().pivot("category", list(_NAMES)).count().select(*(F.coalesce(c, F.lit(0)).alias(f"n_{c}") for c in _NAMES))
    summary = counts.crossJoin(classified.agg(F.count("*").alias("n_lines"))).crossJoin(absent.agg(F.count("*").alias("n_absent")))  # one row each
    return {"classified": classified, "diffs": live.select("line", F.inline("_diffs")), "absent": absent, "summary": summary}


def _compared(submitted: DataFrame, derived: DataFrame, keys: list[str], kinds: dict[str, list[str]]) -> DataFrame:
    """(kind, key, submitted, derived) of keys that one side lacks (null there) or whose values differ; all kinds (with their values) from one join."""
    values = list(dict.fromkeys(v for own in kinds.values() for v in own))
    key = F.concat_ws("/", *(F.col(k).cast("string") for k in keys)).alias("key")
    side = lambda df, name: df.select(key, F.struct(F.lit(True).alias("_there"), *values).alias(name))
    both = side(submitted, "_submitted").join(side(derived, "_derived"), "key", "full")

    def shown(name: str, own: list[str]) -> Column:
        content = F.to_json(F.struct(*(F.col(name)[v].alias(v) for v in own)), {"ignoreNullFields": "false"}) if own else F.lit("present")
        return F.when(F.col(name).isNotNull(), content)

    rows = F.array(*(F.struct(F.lit(kind).alias("kind"), shown("_submitted", own).alias("submitted"), shown("_derived", own).alias("derived")) for kind, own in kinds.items()))
    return both.select("key", F.inline(rows)).filter(~F.col("submitted").eqNullSafe(F.col("derived"))).select("kind", "key", "submitted", "derived")


def differences(derived: dict[str, DataFrame], classified: DataFrame, diffs: DataFrame, absent: DataFrame, summary: DataFrame) -> DataFrame:
    """(kind, key, submitted, derived), none if all agrees. Kinds: ids, candidates, category, diffs, absences, summary."""
    numbers = lambda df: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("n")) for c in sorted(derived["summary"].columns)))).alias("_s")).select("_s.*")
    parts = [
        _compared(classified, derived["classified"], ["line"], {"ids": ["observation"], "candidates": ["match", "n_candidates"], "category": ["category", "conflict", "target"]}),
        _compared(diffs, derived["diffs"], ["line", "field"], {"diffs": ["before", "after", "kind"]}),
        _compared(absent, derived["absent"], ["record"], {"absences": []}),
        _compared(numbers(summary), numbers(derived["summary"]), ["name"], {"summary": ["n"]}),
    ]
    return reduce(DataFrame.unionByName, parts)
