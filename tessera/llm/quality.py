"""Quality rules: a table of thresholds compiled into Spark projections, without user functions.

Every rule is a ratio of two counted features with bounds in thousandths, compared by whole
numbers (``low * denominator <= 1000 * numerator <= high * denominator``), so no rounding decides.
All work is inside the row: no shuffle, and memory of one text at a time.

Texts: null counts as empty. An empty text has no words, so it fails the base rule. Repeated rows
are judged each by itself; extra columns pass through, and columns whose names clash with the results
are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD_BREAK, inner, outer

SYMBOLS = r"#*$%&|<>"

#: The most common function words of four languages.
STOP_WORDS = {
    "en": "the of and to in is that for it was on are as with be at by this from or an not".split(),
    "fr": "le la les de des du et un une en que qui pour dans sur par avec au ce est pas".split(),
    "de": "der die das und ist nicht ein eine von zu mit sich auf für den im dem des es auch".split(),
    "es": "el la los las de y que en un una por con para del se al no es lo su".split(),
}


@dataclass(frozen=True)
class Rule:
    """``low`` and ``high`` are thousandths of ``numerator / denominator``; None: no bound."""

    name: str
    numerator: str
    denominator: str
    low: int | None = None
    high: int | None = None


#: The production thresholds: word length, symbols, stop words and lines.
RULES = (
    Rule("word_length", "word_chars", "n_words", low=2000, high=12000),
    Rule("symbols", "n_symbols", "n_words", high=300),
    Rule("stop_words", "n_stop_words", "n_words", low=20),
    Rule("dup_lines", "n_dup_lines", "n_lines", high=500),
    Rule("shouting", "n_shout_words", "n_words", high=500),
)
MIN_WORDS = 50
#: Hundredths of the words that may stand in repeated three-word windows.
MAX_REPEAT = 50

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_ALL = (*FEATURES, "n_lines", "n_stop_words", "n_shout_words")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counted features of each text (long), in place of columns of these names."""
    stop = sorted({w for words in STOP_WORDS.values() for w in words})
    content = F.col("text")
    split = inner(docs, text=F.coalesce(F.col(text), F.lit(""))).withColumns({"_words": F.array_remove(F.split(content, WORD_BREAK), ""), "_lines": F.filter(F.split(content, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))})
    n = F.size("_words")
    window = lambda i: F.xxhash64(*(F.get("_words", i + k) for k in range(3)))
    counted = split.withColumns(
        {
            "_symbols": F.length(F.regexp_replace(content, rf"[^{SYMBOLS}]+", "")).cast("long"),
            "_chars": F.length(F.array_join("_words", "")).cast("long"),
            "_stops": F.size(F.filter("_words", lambda w: F.lower(w).isin(stop))).cast("long"),
            # Words in capitals: with an upper-case letter and no lower-case one.
            "_shouts": F.size(F.filter("_words", lambda w: w.rlike(r"\p{Lu}") & ~w.rlike(r"\p{Ll}"))).cast("long"),
            "_repeated_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_windows": F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)),
        }
    )
    # Windows sorted by hash stand beside their equals; only texts with equals are sorted.
    doubled = F.size(F.array_distinct("_windows")) < F.size("_windows")
    ordered = counted.withColumn("_windows", F.when(doubled, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda e, j: F.coalesce(F.get("_windows", j)["h"] == e["h"], F.lit(False))
    before = lambda i: F.when(i > 0, i - 1).otherwise(-1)
    flagged = F.filter("_windows", lambda e, i: same(e, before(i)) | same(e, i + 1))
    places = ordered.withColumn("_windows", F.sort_array(F.transform(flagged, lambda e: e["i"])))
    # Each flagged window adds the words that the one before it doesn't cover.
    covered = F.aggregate(
        "_windows",
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total")),
        lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(3), p - a["last"])).alias("total")),
        lambda a: a["total"],
    )
    counts = places.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.col("_chars"),
            "n_symbols": F.col("_symbols"),
            "n_dup_lines": F.col("_repeated_lines"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_stop_words": F.col("_stops"),
            "n_shout_words": F.col("_shouts"),
        }
    )
    return outer(counts, docs, *_ALL)


def _passes(rule: Rule) -> Column:
    top, bottom = F.col(rule.numerator) * 1000, F.col(rule.denominator)
    passes = F.lit(True)
    if rule.low is not None:
        passes &= top >= bottom * rule.low
    if rule.high is not None:
        passes &= top <= bottom * rule.high
    return passes


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with its features, ``base_failed``, ``failed_rules`` (names, comma-joined) and ``kept``."""
    verdict = {
        "base_failed": (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT),
        "failed_rules": F.array_join(F.array_compact(F.array(*(F.when(~_passes(r), F.lit(r.name)) for r in rules))), ","),
    }
    return features(docs, text).withColumns(verdict).withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    # The filter also asks for a row number. It holds for every row, but being no function of the row it is a barrier: the
    # optimizer would else push the filter below the features and write all of them out a second time in it.
    judged = judge(inner(docs, text=F.col(text)))
    return outer(judged.withColumn("place", F.monotonically_increasing_id()).filter("kept AND place >= 0"), docs)


def _sql_rule(r: Rule) -> str:
    parts = [f"1000 * {r.numerator} >= {r.low} * {r.denominator}"] * (r.low is not None) + [f"1000 * {r.numerator} <= {r.high} * {r.denominator}"] * (r.high is not None)
    return f"CASE WHEN NOT ({' AND '.join(parts)}) THEN '{r.name}' END"


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), tri AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k
  FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d))
), rep AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM tri, (VALUES (0), (1), (2)) AS o(j) WHERE k > 1 GROUP BY doc_id
), f AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^{SYMBOLS}]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words}))}))) AS BIGINT) AS n_stop_words,
    CAST(len(list_filter(w, lambda x: regexp_matches(x, '\p{{Lu}}') AND NOT regexp_matches(x, '\p{{Ll}}'))) AS BIGINT) AS n_shout_words
  FROM d LEFT JOIN rep USING (doc_id)
), v AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed,
    concat_ws(',', {", ".join(map(_sql_rule, RULES))}) AS failed_rules
  FROM f
)
SELECT *, NOT base_failed AND failed_rules = '' AS kept FROM v
"""
