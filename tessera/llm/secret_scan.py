"""Secret scans by a trigram inverted index, in DataFrame functions only.

Each rule's regular expression gives a Boolean query over trigrams that any match must hold (Cox,
"Regular Expression Matching with a Trigram Index"): an AND of clauses, each an OR of trigram sets.
The index holds the postings of the trigrams that the rules ask for; postings are intersected by
counting, and only the candidates of a rule are verified by its expression. A rule without mandatory
trigrams (hex runs) scans every text. Postings are keyed by document, so a trigram that every text
holds makes no hot key.

Spans are code points, end exclusive. Texts: null counts as empty. Rows that share a key share their
candidates, and each is verified on its own text; a null key is a key like any other. Extra columns
pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import re._constants as rc
import re._parser as rp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import inner, outer, written


@dataclass(frozen=True)
class Rule:
    """A match counts when its ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules, then the formats of well-known credentials.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # the same matches as of [0-9a-f]+ with 24 or more characters
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
)
BASE = 3
#: More candidates than this are joined by a shuffle, fewer are broadcast (a key and a few numbers each).
BROADCAST_ROWS = 500_000

_MOST = 64  # strings that a part of an expression may stand for before it counts as open


def _strings(items) -> set[str] | None:
    """All strings that a sequence of parsed items matches, lower-cased, or None if there are too many."""
    found = {""}
    for op, arg in items:
        if op is rc.LITERAL:
            part = {chr(arg).lower()}
        elif op is rc.IN and all(x[0] is rc.LITERAL for x in arg):
            part = {chr(x[1]).lower() for x in arg}
        elif op is rc.SUBPATTERN:
            part = _strings(arg[3])
        elif op is rc.BRANCH:
            parts = [_strings(x) for x in arg[1]]
            part = None if None in parts else set().union(*parts)
        elif op is rc.MAX_REPEAT and arg[1] <= 8:
            one = _strings(arg[2])
            part = None if one is None else {""} if arg[0] == 0 else set()
            for n in range(max(1, arg[0]), arg[1] + 1):
                if part is None or len(one) ** n > _MOST:
                    return None
                part |= reduce(lambda a, _: {x + y for x in a for y in one}, range(n), {""})
        else:
            part = None
        if part is None or len(found) * len(part) > _MOST:
            return None
        found = {a + b for a in found for b in part}
    return found


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses that all hold in any matched text; a clause is a list of trigram sets, one of which is there whole."""
    clauses, now = [], {""}

    def close() -> None:
        sets = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(now)]
        if all(sets):  # a set that holds another adds nothing to the choice
            clauses.append(sorted({x for x in sets if not any(y < x for y in sets)}, key=sorted))
        now.clear()
        now.add("")

    for item in rp.parse(pattern):
        part = _strings([item])
        if part is not None and len(part) * len(now) <= _MOST:
            longer = {a + b for a in now for b in part}
            now.clear()
            now.update(longer)
        else:
            close()
    close()
    return clauses


def candidates(docs: DataFrame, key: str, text: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, rules): the numbers of the indexed rules whose trigram query a document satisfies."""
    spark = docs.sparkSession
    # At most 62 trigrams of a set are asked for: fewer make more candidates, never fewer matches.
    terms = [(r, c, a, g, 1 << i, min(62, len(grams)), len(query)) for r, rule in enumerate(rules) if (query := trigram_query(rule.pattern)) for c, clause in enumerate(query) for a, grams in enumerate(clause) for i, g in enumerate(sorted(grams)[:62])]
    asked = spark.createDataFrame(terms, "rule int, clause int, choice int, gram string, bit long, n_grams int, n_clauses int")
    content = docs.select(F.col(key).alias("_key"), F.lower(F.col(text)).alias("_low")).filter(F.col("_low").isNotNull())
    postings = content.select("_key", F.explode(F.array_compact(F.array(*(F.when(F.contains("_low", F.lit(g)), F.lit(g)) for g in sorted({t[3] for t in terms}))))).alias("gram"))
    # The terms are as many as the rules make them, whatever the data. A term's place is a bit, so repeated keys don't count twice.
    hits = postings.join(F.broadcast(asked), "gram")
    whole = hits.groupBy("_key", "rule", "clause", "choice", "n_grams", "n_clauses").agg(F.bit_or("bit").alias("bits")).filter(F.bit_count("bits") == F.col("n_grams"))
    clauses = whole.groupBy("_key", "rule", "n_clauses").agg(F.count_distinct("clause").alias("n")).filter("n >= n_clauses")
    return clauses.groupBy("_key").agg(F.collect_set("rule").alias("_rules"))


def _joined(docs: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """(row, text, rules) of every row."""
    found = written(found, "secret-candidates")
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    rows = inner(docs, key=F.col(key), text=F.coalesce(F.col(text), F.lit("")))
    return rows.join(found, F.col("key").eqNullSafe(F.col("_key")), "left").drop("_key")


_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _placed(r: int, rule: Rule) -> Column:
    """The spans of one rule, from its matches and the stretches between them."""
    sizes = F.transform(f"_whole{r}", lambda m, i: F.struct(F.length(F.get(f"_gap{r}", i)).alias("gap"), F.length(m).alias("whole"), F.length(F.get(f"_part{r}", i)).alias("part")))
    spans = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,part:int>>").alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["whole"]).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["whole"]).alias("end"), x["part"].alias("part")))).alias("out"),
        ),
        lambda a: a["out"],
    )
    kept = F.transform(F.filter(spans, lambda s: s["part"] >= rule.least), lambda s: F.struct(s["start"].alias("start"), F.lit(r).alias("kind"), s["end"].alias("end")))
    return F.coalesce(kept, F.array().cast(_SPANS))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``secret_spans``: an array of (start, kind number, end), by start, then kind."""
    found = _joined(docs, candidates(docs, key, text, rules), key, text)
    content = F.col("text")
    columns: dict[str, Column] = {}
    for r, rule in enumerate(rules):
        asked = F.array_contains("_rules", r) if trigram_query(rule.pattern) else F.lit(True)
        hit = F.when(asked, content.rlike(rule.pattern)).otherwise(False)
        columns |= {
            f"_whole{r}": F.when(hit, F.regexp_extract_all(content, F.lit(rule.pattern), F.lit(0))),
            f"_part{r}": F.when(hit, F.regexp_extract_all(content, F.lit(rule.pattern), F.lit(rule.group))),
            f"_gap{r}": F.when(hit, F.split(content, rule.pattern, -1)),
        }
    cut = found.withColumns(columns)
    spans = [_placed(r, rule) for r, rule in enumerate(rules)]
    return outer(cut.withColumn("secret_spans", F.sort_array(F.concat(*spans))), docs, "secret_spans")


def listed(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(rule.kind) for rule in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each stretch of secrets (overlapping spans count as one) replaced by ``mark``; nulls stay null."""
    found = scan(docs, key, text, rules)
    built = F.aggregate(
        "secret_spans",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(
            F.struct(
                s["end"].alias("at"),
                # A span that overlaps the one before only lengthens it.
                F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.array(F.col(text).substr(a["at"] + 1, s["start"] - a["at"]), F.lit(mark)))).alias("out"),
            )
        ),
        lambda a: F.concat(F.array_join(a["out"], ""), F.col(text).substr(a["at"] + 1, F.length(text))),
    )
    return found.withColumn(text, F.when(F.size("secret_spans") > 0, built).otherwise(F.col(text))).select(docs.columns)


def _any_case(pattern: str) -> str:
    """The expression of the base rule with its letters spelled in both cases, for SQL engines."""
    words = "password|passwd|secret|token|api_?key"
    return pattern.replace(f"(?i:({words}))", "(" + "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words) + ")")


def _oracle() -> str:
    parts = []
    for r, rule in enumerate(RULES):
        p = _any_case(rule.pattern).replace("'", "''")
        parts.append(
            f"SELECT doc_id, {r} AS kind, '{rule.kind}' AS name, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s, length(m[i]) AS n "
            f"FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(t, '{p}') AS g, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {rule.group}) AS v FROM d)) "
            f"WHERE length(v[i]) >= {rule.least}"
        )
    union = " UNION ALL ".join(parts)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT *, name || ':' || s || ':' || (s + n) AS span FROM ({union})),
a AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(span, ',' ORDER BY s, kind) FILTER (kind < {BASE}) AS base, string_agg(span, ',' ORDER BY s, kind) AS spans
  FROM x GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""


ORACLE = _oracle()
