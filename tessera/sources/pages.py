"""Lines of scanned and printed pages: certain words to lines, labels and values to suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import texts

#: Labels on normalised lines.
LABELS = {
    "number": r"^(?:numero|n[º°o.]?)\s+(?:(?:da|de)\s+)?(?:nfs[ -]?e|nota(?:\s+fiscal)?)(?=\s|:|$)",
    "date": r"^data\s+(?:de\s+)?emissao(?=\s|:|$)",
    "amount": r"^valor\s+(?:total\s+(?:(?:dos?|da)\s+)?(?:servicos|nota(?:\s+fiscal)?)|bruto(?:\s+da\s+nota)?)(?=\s|:|$)",
}
#: Least confidence of a word, and the lengths that one document may have.
CONFIDENCE, MOST_PAGES, MOST_CHARS = 90, 20, 100_000
#: A column begins after a gap of this many points and heights; lines are near within these at the left edge and below.
COLUMN_GAP, GAP_HEIGHTS, EDGE, LINE_HEIGHTS = 24, 3, 12, 2.5


def certain_lines(words: DataFrame) -> DataFrame:
    """(doc, page, block, par, line, text) of recognised words (doc, page, block, par, line, word, conf, text) whose line is certain as a whole."""
    key = ["doc", "page", "block", "par", "line"]
    sure = F.bool_and((F.coalesce("conf", F.lit(-1.0)) >= CONFIDENCE) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    lines = words.groupBy(*key).agg(sure.alias("_sure"), F.array_sort(F.collect_list(F.struct("word", F.trim("text").alias("t")))).alias("_words"))
    return lines.filter("_sure").select(*key, F.array_join(F.transform("_words", lambda w: w["t"]), " ").alias("text"))


def page_texts(words: DataFrame) -> DataFrame:
    """(doc, page, text) of recognised words (as for :func:`certain_lines`, with left, top, width and height): lines that belong together follow each other, all else is parted by an empty line.

    A line with an uncertain or empty word isn't shown and parts its neighbours. Inside a line, a wide gap before a
    word, or a word that begins well inside the one before, begins another column. A line follows the one before only
    in the same paragraph, at about the same left edge and not far below. Words of a line and lines of a page are few,
    so they are lists; no window. A page without words has no row.
    """
    key = ["doc", "page", "block", "par", "line"]
    sure = F.bool_and((F.coalesce(F.nanvl("conf", F.lit(-1.0)), F.lit(-1.0)) >= CONFIDENCE) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    lines = words.groupBy(*key).agg(sure.alias("sure"), F.array_sort(F.collect_list(F.struct("word", "left", "top", "width", "height", F.trim("text").alias("t")))).alias("_w"))

    def with_gap(w, i):
        before = F.get("_w", i - 1)
        gap = w["left"] - before["left"] - before["width"]
        apart = (gap > F.greatest(F.lit(COLUMN_GAP), w["height"] * GAP_HEIGHTS)) | (gap < -w["height"])
        return F.concat(F.when(i == 0, "").when(apart, "\n\n").otherwise(" "), w["t"])

    head = F.get("_w", F.lit(0))
    shown = lines.select("doc", "page", F.struct("block", "par", "line", "sure", F.array_join(F.transform("_w", with_gap), "").alias("text"), *(head[c].alias(c) for c in ("left", "top", "height"))).alias("_line"))
    pages = shown.groupBy("doc", "page").agg(F.array_sort(F.collect_list("_line")).alias("_l"))

    def with_break(line, i):
        before = F.get("_l", i - 1)
        near = before["sure"] & (line["block"] == before["block"]) & (line["par"] == before["par"])
        near = near & (F.abs(line["left"] - before["left"]) <= F.greatest(F.lit(EDGE), line["height"]))
        near = near & (F.abs(line["top"] - before["top"]) <= F.greatest(line["height"], before["height"]) * LINE_HEIGHTS)
        return F.when(~line["sure"], "\n\n").otherwise(F.concat(F.when(i == 0, "").when(near, "\n").otherwise("\n\n"), line["text"]))

    return pages.select("doc", "page", F.array_join(F.transform("_l", with_break), "").alias("text"))


def _value(field, raw):
    """A value in its canonical form, or null where it isn't safe."""
    raw = F.trim(raw)
    number = F.when(raw.rlike(r"^\d[\dA-Za-z./-]{0,99}$"), raw)
    day = F.coalesce(F.try_to_date(F.when(raw.rlike(r"^\d{2}[/-]\d{2}[/-]\d{4}$"), F.translate(raw, "-", "/")), "dd/MM/yyyy"), F.try_to_date(F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), raw), "yyyy-MM-dd"))
    issued = F.when(F.year(day).between(1900, 2100), F.date_format(day, "yyyy-MM-dd"))
    money = F.regexp_replace(raw, r"(?i)^R\$\s*", "")
    comma = F.replace(F.replace(F.when(money.rlike(r"^(?:\d+|\d{1,3}(?:\.\d{3})+),\d{2}$"), money), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    plain = F.coalesce(comma, F.when(money.rlike(r"^\d+\.\d{2}$"), money))
    amount = F.when(F.length(plain) <= 30, F.regexp_replace(plain, r"^0+(?=\d)", ""))
    return F.when(field == "number", number).when(field == "date", issued).otherwise(amount)


def suggestions(pages: DataFrame) -> DataFrame:
    """(doc, field, value, verdict) of pages (doc, page, text), one row for each field of each document.

    A label's value follows it on the line, or is the next line. Verdicts: suggested (one value), unsafe (a label
    without one), conflicting, absent, several_notes (no field of such a document is suggested), too_long.
    """
    sizes = pages.groupBy("doc").agg((F.count("*") > MOST_PAGES).alias("_many"), (F.sum(texts.utf16_length(F.coalesce("text", F.lit("")))) > MOST_CHARS).alias("_long")).select("doc", (F.col("_many") | F.col("_long")).alias("_over"))
    split = F.transform(F.split(F.coalesce("text", F.lit("")), r"\r?\n"), lambda t: F.trim(F.regexp_replace(t, r"\s+", " ")))
    # Each page carries its own lines, so the next line needs no shuffle.
    lines = pages.select("doc", F.posexplode(F.arrays_zip(split.alias("line"), F.concat(F.slice(split, F.lit(2), F.size(split)), F.array(F.lit(""))).alias("next"))).alias("pos", "_l")).select("doc", "_l.line", "_l.next")
    key = texts.title_key(F.col("line"))
    labels = [F.struct(F.lit(f).alias("field"), F.length(F.regexp_extract(key, pattern, 0)).alias("size")) for f, pattern in LABELS.items()]
    hits = lines.select("doc", "line", "next", F.explode(F.filter(F.array(*labels), lambda h: h["size"] > 0)).alias("_h"))
    suffix = F.regexp_replace(F.substring("line", F.col("_h.size") + 1, F.length("line")), r"^\s*[:=]?\s*", "")
    raw = F.when(suffix != "", suffix).otherwise(F.col("next"))
    valued = hits.select("doc", F.col("_h.field").alias("field"), _value(F.col("_h.field"), raw).alias("value"))
    same = F.when(F.col("field") == "number", texts.invoice_key(F.col("value"))).otherwise(F.col("value"))
    by_field = valued.groupBy("doc", "field").agg(F.count("*").alias("_n"), F.bool_or(F.col("value").isNull()).alias("_unsafe"), F.count_distinct(same).alias("_values"), F.max("value").alias("value"))
    fields = sizes.select("doc", "_over", F.explode(F.array(*map(F.lit, LABELS))).alias("field"))
    out = fields.join(by_field, ["doc", "field"], "left")
    several = (F.col("field") == "number") & ((F.col("_values") > 1) | ((F.col("_n") > 1) & F.col("_unsafe")))
    out = out.withColumn("_several", F.bool_or(F.coalesce(several, F.lit(False))).over(Window.partitionBy("doc")))
    verdict = F.when(F.col("_over"), "too_long").when(F.col("_several"), "several_notes").when(F.col("_n").isNull(), "absent").when(F.col("_unsafe"), "unsafe").when(F.col("_values") > 1, "conflicting").otherwise("suggested")
    return out.withColumn("verdict", verdict).select("doc", "field", F.when(F.col("verdict") == "suggested", F.col("value")).alias("value"), "verdict")
