"""URL filters: association rules mined by FP-growth, matched through an inverted index.

A URL is a set of tokens: its host's labels, scheme, path words, query keys. Rules "these tokens -> bad" that
pass a support and a confidence threshold block. Only minimal rules are kept, as a rule that holds another blocks nothing
more: tokens that are rules alone are counted first and leave the baskets; tokens that
always occur together are one item then, and Spark's FP-growth mines what is left. The index lists each rule under its rarest
token; a URL looks up its tokens and then verifies the whole rule. Explicit (host, path) rules come first: a rule fits its host and all subdomains where the
path starts with the rule's, and the longest fitting rule decides.

Every distinct URL is judged once, whatever its key, so rows that share a key or have none are judged by their own URLs. Null
URLs and URLs without ``://`` have an empty host and path, no tokens, and are allowed. Repeated rows
are judged alike. Labels that repeat for a key count as bad if any is; null labels are left out; of rows that share a key each is a transaction. Extra
columns pass through; columns named as results are replaced. Without labels, or where no rule passes, the method allows.

FP-growth gets the baskets of bad URLs whole, as every rule has its support there; the sets that it finds are then counted
over all other URLs. So work follows the number of token sets that bad URLs share often enough, however long the URLs are.
Tokens of every labelled URL are in no minimal rule of several tokens and leave the baskets, too.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_name, tidied, written

#: Share of labelled URLs that a rule's tokens and label must be on together, and the rule's confidence.
MIN_SUPPORT = 0.002
#: The least number of labelled URLs behind a rule, whatever their share.
MIN_COUNT = 5
MIN_CONFIDENCE = 0.6
#: More mined rules than this are joined by a shuffle instead of a broadcast.
BROADCAST_RULES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The explicit rules of the production list.
HOST_RULES = (
    HostRule("allow", "org", "/"),
    HostRule("block", "example.org", "/es/"),
    HostRule("block", "example.org", "/en/1"),
    HostRule("allow", "com", "/fr/"),
    HostRule("block", "com", "/de/"),
)


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a URL; runs of digits count by their length only."""
    text = F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER)
    rest = F.regexp_extract(text, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    words = F.transform(F.regexp_extract_all(rest, F.lit(r"[a-z0-9_-]+"), F.lit(0)), lambda w: F.when(w.rlike("^[0-9]+$"), F.concat(F.lit("digits:"), F.length(w).cast("string"))).otherwise(F.concat(F.lit("word:"), w)))
    labels = F.transform(F.split(url_host(url), r"\."), lambda w: F.concat(F.lit("host:"), w))
    scheme = F.array(F.concat(F.lit("scheme:"), F.regexp_extract(text, r"(?s)^(.*?)://", 1)))
    return F.when(F.contains(url, F.lit("://")), F.array_distinct(F.concat(scheme, labels, words))).otherwise(F.array().cast("array<string>"))


def mine(urls: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(rule, tokens, anchor, confidence) of the minimal token sets that imply a bad label.

    ``urls``: key, url; ``labels``: key, bad (boolean). Every labelled URL is a transaction.
    """
    with tidied() as keep:
        return keep(written(_mined(urls, labels, min_support, min_confidence), "url-rules"))


def _mined(urls: DataFrame, labels: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    marked = labels.filter("key IS NOT NULL AND bad IS NOT NULL").groupBy("key").agg(F.bool_or("bad").alias("bad"))
    tokens = url_tokens(F.col("url"))
    baskets = urls.join(marked, "key").select(tokens.alias("tokens"), "bad").filter(F.size("tokens") > 0)
    baskets = written(baskets.withColumn("basket", F.monotonically_increasing_id()), "url-baskets")
    n = baskets.count()
    fewest = max(1, MIN_COUNT if n >= MIN_COUNT else n, math.ceil(min_support * n - 1e-9))
    # Each token's baskets: their number, the bad ones, and a fingerprint that tokens of the same baskets share.
    hashes = [F.xxhash64("basket", F.lit(i)) for i in range(2)]
    single = baskets.select(F.explode("tokens").alias("token"), "basket", "bad").groupBy("token").agg(F.count("*").alias("freq"), F.count_if("bad").alias("n_bad"), *(F.bit_xor(h).alias(f"h{i}") for i, h in enumerate(hashes)))
    single = written(single.filter(F.col("n_bad") >= fewest).withColumn("confidence", F.col("n_bad") / F.col("freq")), "url-tokens")
    alone = single.filter(F.col("confidence") >= min_confidence).select(F.array("token").alias("tokens"), "confidence")
    # What is left: one token stands for all of the same baskets.
    rest = single.filter((F.col("confidence") < min_confidence) & (F.col("freq") < n))
    item = written(rest.groupBy("freq", "h0", "h1").agg(F.min("token").alias("item"), F.array_sort(F.collect_set("token")).alias("members")).select("item", "members", "freq"), "url-items")
    known = item.select(F.col("item").alias("token"), "freq")
    known = F.broadcast(known) if item.count() <= BROADCAST_RULES else known
    kept = baskets.select("basket", "bad", F.explode("tokens").alias("token")).join(known, "token")
    left = written(kept.groupBy("basket", "bad").agg(F.collect_set("token").alias("items")).filter(F.size("items") > 1), "url-transactions")
    bad = left.filter("bad").select("items")
    n_bad = bad.count()
    rules = _confident(bad, n_bad, fewest, left.filter("NOT bad").select("basket", "items"), item, min_confidence) if n_bad >= fewest else None
    if rules is None:
        return _posted(alone, single)
    # Of items in a rule each token of the same baskets is told, as they came together only.
    named = rules.withColumn("set", F.array_join(F.array_sort("antecedent"), " ")).select("set", "confidence", F.explode("antecedent").alias("item")).join(item, "item")
    several = named.groupBy("set").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("members")))).alias("tokens"), F.any_value("confidence").alias("confidence"), F.array_sort(F.collect_set("item")).alias("items"))
    several = written(several, "url-rules")
    # Minimal: no other rule's items are among a rule's.
    small = several.select(F.explode("items").alias("item"), F.col("items").alias("less"))
    minimal = several.select("set", "items", F.explode("items").alias("item")).join(small, "item").filter((F.size("less") < F.size("items")) & (F.size(F.array_except("less", "items")) == 0)).select("set").distinct()
    return _posted(alone.unionByName(several.join(minimal, "set", "left_anti").select("tokens", "confidence")), single)


def _confident(bad: DataFrame, n_bad: int, fewest: int, good: DataFrame, item: DataFrame, min_confidence: float) -> DataFrame:
    """(antecedent, confidence): sets of several items that ``fewest`` bad baskets (items) hold, by how many of the others (basket, items) hold them."""
    model = FPGrowth(itemsCol="items", minSupport=(fewest - 0.5) / n_bad).fit(bad)
    sets = model.freqItemsets.filter(F.size("items") > 1).select(F.array_sort("items").alias("antecedent"), F.col("freq").alias("n_bad"))
    sets = sets.withColumn("set", F.array_join("antecedent", " "))
    first = sets.select("set", F.explode("antecedent").alias("item")).join(item.select("item", "freq"), "item").groupBy("set").agg(F.min_by("item", F.struct("freq", "item")).alias("item"))
    sets = written(sets.join(first, "set"), "url-sets")
    # A set is looked up under its rarest item.
    few = F.broadcast(sets) if sets.count() <= BROADCAST_RULES else sets
    held = good.select("items", F.explode("items").alias("item")).join(few, "item").filter(F.size(F.array_except("antecedent", "items")) == 0)
    n_good = held.groupBy("set").agg(F.count("*").alias("n_good"))
    counted = sets.join(n_good, "set", "left").withColumn("confidence", F.col("n_bad") / (F.col("n_bad") + F.coalesce("n_good", F.lit(0))))
    return counted.filter(F.col("confidence") >= min_confidence).select("antecedent", "confidence")


def _posted(rules: DataFrame, single: DataFrame) -> DataFrame:
    """Rules (tokens, confidence) by name, each with its rarest token."""
    found = rules.withColumn("rule", F.array_join("tokens", " "))
    posted = found.select("rule", "tokens", "confidence", F.explode("tokens").alias("token")).join(single.select("token", "freq"), "token")
    return posted.groupBy("rule").agg(F.any_value("tokens").alias("tokens"), F.any_value("confidence").alias("confidence"), F.min_by("token", F.struct("freq", "token")).alias("anchor"))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined_rule) of the distinct ``url``: of the mined rules that it holds whole, that of highest confidence, ties by text."""
    if rules.count() <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    words = urls.select("url").distinct().select("url", url_tokens(F.col("url")).alias("has"))
    found = words.select("url", "has", F.explode("has").alias("anchor")).join(rules, "anchor").filter(F.size(F.array_except("tokens", "has")) == 0)
    return found.groupBy("url").agg(F.max_by("rule", F.struct("confidence", "rule")).alias("mined_rule"))


def judge(pages: DataFrame, labels: DataFrame, key: str = "page_id", url: str = "url", host_rules: tuple[HostRule, ...] = HOST_RULES, **thresholds: float) -> DataFrame:
    """``pages`` with host, path, rule, mined_rule and verdict (allow or block)."""
    urls = pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
    rules = mine(urls, labels, **thresholds)
    same = free_name(pages, "_url")
    mined = match(urls, rules).withColumnRenamed("url", same)
    parsed = pages.drop(*({"mined_rule", "rule", "verdict"} - {key, url})).withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    fits = lambda r: ((F.col("host") == r.host) | F.endswith("host", F.lit(f".{r.host}"))) & F.startswith("path", F.lit(r.path))
    longest = sorted(host_rules, key=lambda r: (-len(r.text), r.text, r.verdict))
    first = lambda value: F.coalesce(*(F.when(fits(r), F.lit(value(r))) for r in longest), F.lit(None).cast("string"))
    judged = parsed.join(mined, F.col(url) == F.col(same), "left").drop(same).withColumn("rule", first(lambda r: r.text))
    return judged.withColumn("verdict", F.coalesce(first(lambda r: r.verdict), F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")))
