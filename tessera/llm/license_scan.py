"""License scans: texts compared with licence templates by the Dice coefficient over word bigrams.

A text is normalised (lower case, ASCII punctuation and line breaks to blanks). A set of ``a`` distinct word bigrams is
compared with that of a template by ``2 * common / (a + b)``. A template can only reach the
threshold t beside ``a`` bigrams if its own number lies between ``a * t / (2 - t)`` and
``a * (2 - t) / t``; these size bounds choose the templates and the windows. Everything is a DataFrame
expression inside the row: no shuffle, and the templates are a fixed list in the plan. :func:`passages` finds notices
anywhere in the text, wrapped over lines or inside longer ones; :func:`scan` finds lines that are a notice as a whole.

Texts: null counts as empty. Empty texts and lines have no licence; repeated rows are scanned each by
itself; of a line's templates the highest coefficient wins, ties by the template's name. Extra columns
pass through, columns named as a result are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import inner, outer

#: The least Dice coefficient, in hundredths.
THRESHOLD = 80


@dataclass(frozen=True)
class Template:
    name: str
    text: str


#: Notices by which works are put under well-known licences.
TEMPLATES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    Template("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    Template("cc-by-4.0", "Licensed under CC BY 4.0."),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    Template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    Template("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    Template("mit", "Released under the MIT License."),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction."),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    Template("unlicense", "This is free and unencumbered software released into the public domain."),
)
_BREAK = r"[^0-9a-z\x{80}-\x{10FFFF}]+"


def bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a template."""
    words = [w for w in re.split(r"[^0-9a-z\x80-\U0010ffff]+", text.lower()) if w]
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bounds(n: int, percent: int) -> tuple[int, int]:
    """The least and largest sizes that can reach the threshold beside a set of n."""
    return -(-n * percent // (200 - percent)), n * (200 - percent) // percent


def _line_bigrams(words: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))
    return F.when(F.size(words) >= 2, F.array_distinct(pairs))


def _score(grams: Column, own: list[str], rank: int, percent: int) -> Column:
    """(thousandths, -rank) of one template, or null where the sizes or the coefficient rule it out."""
    low, high = bounds(len(own), percent)
    common = F.size(F.array_intersect(grams, F.array(*map(F.lit, own))))
    both = F.size(grams) + len(own)
    score = F.when(F.size(grams).between(low, high) & (200 * common >= percent * both), F.floor(2000 * common / both).cast("int"))
    return F.when(score.isNotNull(), F.struct(score.alias("score"), F.lit(-rank).alias("rank")))


def scan(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES, percent: int = THRESHOLD) -> DataFrame:
    """``docs`` with ``licenses``: (line number from 1, name, Dice in thousandths, rounded down) of each licence line."""
    ordered = sorted(templates, key=lambda t: t.name)
    own = [bigrams(t.text) for t in ordered]
    fewest, most = min(bounds(len(g), percent)[0] for g in own), max(bounds(len(g), percent)[1] for g in own)
    names = F.array(*(F.lit(t.name) for t in ordered))
    # The line's words, then its bigrams, then its best template; each step only for lines that may still reach it.
    words = lambda line: F.array_remove(F.split(F.lower(line), _BREAK), "")
    cut = F.transform(F.split("text", "\n"), lambda line, i: F.struct((i + 1).alias("line"), words(line).alias("words")))
    long = inner(docs, text=F.coalesce(F.col(text), F.lit(""))).withColumn("lines", F.filter(cut, lambda x: F.size(x["words"]) > fewest))
    paired = long.withColumn("lines", F.transform("lines", lambda x: F.struct(x["line"].alias("line"), _line_bigrams(x["words"]).alias("grams"))))
    sized = paired.withColumn("lines", F.filter("lines", lambda x: F.size(x["grams"]).between(fewest, most)))
    best = lambda grams: F.array_max(F.array(*(_score(grams, g, rank, percent) for rank, g in enumerate(own))))
    scored = sized.withColumn("lines", F.transform("lines", lambda x: F.struct(x["line"].alias("line"), best(x["grams"]).alias("best"))))
    found = F.transform(F.filter("lines", lambda x: x["best"].isNotNull()), lambda x: F.struct(x["line"].alias("line"), F.get(names, -x["best"]["rank"]).alias("name"), x["best"]["score"].alias("score")))
    return outer(scored.withColumn("licenses", found), docs, "licenses")


def listed(licenses: Column) -> Column:
    """Licence lines as line:name:score, comma-joined."""
    return F.array_join(F.transform(licenses, lambda x: F.concat_ws(":", x["line"].cast("string"), x["name"], x["score"].cast("string"))), ",")


def passages(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES, percent: int = THRESHOLD) -> DataFrame:
    """``docs`` with ``passages``: (first word from 0, last word, name, thousandths) of each notice anywhere in the text.

    The text is one sequence of words, so notices may be wrapped over lines or stand inside longer ones. Of a template all
    windows in its range of sizes count that begin and end with one of its bigrams (others never score higher). Of windows that
    overlap the highest coefficient wins, then the earlier, shorter one, then the template's name.
    """
    ordered = sorted(templates, key=lambda t: t.name)
    sets = [bigrams(t.text) for t in ordered]
    one = lambda rank, g: F.struct(F.lit(-rank).alias("rank"), F.lit(ordered[rank].name).alias("name"), F.array(*map(F.lit, g)).alias("own"), *(F.lit(x).alias(c) for c, x in zip(("low", "high"), bounds(len(g), percent), strict=True)))
    known, every = F.array(*(one(rank, g) for rank, g in enumerate(sets))), F.array(*(F.lit(x) for x in sorted(set().union(*sets))))
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), _BREAK), "")
    pairs = F.when(F.size("words") >= 2, F.transform(F.sequence(F.lit(0), F.size("words") - 2), lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1))))
    cut = inner(docs, words=words).withColumn("grams", F.coalesce(pairs, F.array().cast("array<string>"))).drop("words")
    near = cut.withColumn("near", F.array_intersect("grams", every))
    common = lambda grams, t: F.size(F.array_intersect(grams, t["own"]))
    # No window has more common bigrams than the text.
    likely = near.withColumn("likely", F.filter(known, lambda t: 200 * common(F.col("near"), t) >= percent * (common(F.col("near"), t) + F.size(t["own"])))).drop("near")

    def window(t: Column, start: Column, end: Column) -> Column:
        grams = F.array_distinct(F.slice("grams", start + 1, end - start + 1))
        k, both = common(grams, t), F.size(grams) + F.size(t["own"])
        return F.when(200 * k >= percent * both, F.struct(F.floor(2000 * k / both).cast("int").alias("score"), (-start).alias("start"), (-end).alias("end"), t["rank"].alias("rank"), t["name"].alias("name")))

    def windows(t: Column) -> Column:
        within = lambda i: F.array_contains(t["own"], F.get("grams", i))
        last = F.size("grams") - 1
        starts = F.filter(F.sequence(F.lit(0), last), lambda i: within(i) & (i + t["low"] - 1 <= last))
        ends = lambda i: F.filter(F.sequence(i + t["low"] - 1, F.least(i + t["high"] - 1, last)), within)
        return F.flatten(F.transform(starts, lambda i: F.array_compact(F.transform(ends(i), lambda e: window(t, i, e)))))

    best = likely.withColumn("windows", F.sort_array(F.flatten(F.transform("likely", windows)), asc=False))
    # The last word of a window is that of its last bigram.
    overlap = lambda a, b: (-a["start"] <= 1 - b["end"]) & (-b["start"] <= 1 - a["end"])
    kept = F.aggregate("windows", F.filter("windows", lambda _: F.lit(False)), lambda acc, x: F.when(F.exists(acc, lambda a: overlap(a, x)), acc).otherwise(F.concat(acc, F.array(x))))
    shown = F.transform(kept, lambda x: F.struct((-x["start"]).alias("first"), (1 - x["end"]).alias("last"), x["name"].alias("name"), x["score"].alias("score")))
    return outer(best.withColumn("passages", F.array_sort(shown)), docs, "passages")


def listed_passages(passages: Column) -> Column:
    """Passages as first-last:name:score, comma-joined."""
    return F.array_join(F.transform(passages, lambda x: F.concat_ws(":", F.concat_ws("-", x["first"].cast("string"), x["last"].cast("string")), x["name"], x["score"].cast("string"))), ",")


ORACLE = rf"""
WITH RECURSIVE t(name, rank, low, high, grams) AS (VALUES {", ".join(f"('{t.name}', {i}, {bounds(len(bigrams(t.text)), THRESHOLD)[0]}, {bounds(len(bigrams(t.text)), THRESHOLD)[1]}, {bigrams(t.text)!r})" for i, t in enumerate(sorted(TEMPLATES, key=lambda t: t.name)))}),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^0-9a-z\x{{80}}-\x{{10FFFF}}]+'), lambda x: x <> '') AS w FROM documents),
dg AS (SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM d WHERE len(w) >= 2),
pos AS (SELECT doc_id, x.i AS i, x.gram AS gram FROM (SELECT doc_id, unnest(list_transform(range(1, len(g) + 1), lambda i: {{'i': i, 'gram': g[i]}})) AS x FROM dg)),
own AS (SELECT name, rank, low, high, len(grams) AS n, unnest(grams) AS gram FROM t),
here AS (SELECT doc_id, i, pos.gram, name, rank, low, high, n FROM pos JOIN own USING (gram)),
able AS (SELECT doc_id, rank FROM here GROUP BY doc_id, rank, n HAVING 200 * count(DISTINCT gram) >= {THRESHOLD} * (count(DISTINCT gram) + n)),
sure AS (SELECT * FROM here JOIN able USING (doc_id, rank)),
pair AS (SELECT a.doc_id, a.name, a.rank, a.i AS s, b.i AS e FROM sure a JOIN sure b ON a.doc_id = b.doc_id AND a.rank = b.rank AND b.i - a.i + 1 BETWEEN a.low AND a.high),
scored AS (SELECT doc_id, pair.name, rank, s, e, len(list_intersect(list_distinct(g[s:e]), grams)) AS k, len(list_distinct(g[s:e])) + len(grams) AS n FROM pair JOIN dg USING (doc_id) JOIN t USING (rank)),
won AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY 2000 * k // n DESC, s, e, rank) AS r FROM scored WHERE 200 * k >= {THRESHOLD} * n),
kept AS (
  SELECT doc_id, r, [{{'s': s, 'e': e, 'v': name || ':' || (2000 * k // n)}}] AS l FROM won WHERE r = 1
  UNION ALL
  SELECT won.doc_id, won.r, CASE WHEN len(list_filter(l, lambda x: x.s <= won.e + 1 AND won.s <= x.e + 1)) > 0 THEN l ELSE list_append(l, {{'s': s, 'e': e, 'v': name || ':' || (2000 * k // n)}}) END
  FROM kept JOIN won ON won.doc_id = kept.doc_id AND won.r = kept.r + 1
),
p AS (SELECT doc_id, list_sort(arg_max(l, r)) AS l FROM kept GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS t FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
w AS (SELECT doc_id, line, list_filter(regexp_split_to_array(lower(t), '[^0-9a-z\x{{80}}-\x{{10FFFF}}]+'), lambda x: x <> '') AS w FROM ln),
g AS (SELECT doc_id, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) >= 2),
s AS (SELECT doc_id, line, name, rank, len(list_intersect(g, grams)) AS k, len(g) + len(grams) AS n FROM g, t),
b AS (SELECT doc_id, line, arg_max(name, (2000 * k // n, -rank)) AS name, max(2000 * k // n) AS score FROM s WHERE 200 * k >= {THRESHOLD} * n GROUP BY doc_id, line)
SELECT doc_id, count(line) AS n_lines, coalesce(string_agg(line || ':' || name || ':' || score, ',' ORDER BY line), '') AS licenses,
  CAST(coalesce(any_value(len(p.l)), 0) AS BIGINT) AS n_passages, coalesce(any_value(array_to_string(list_transform(p.l, lambda x: (x.s - 1) || '-' || x.e || ':' || x.v), ',')), '') AS passages
FROM documents LEFT JOIN b USING (doc_id) LEFT JOIN p USING (doc_id) GROUP BY doc_id
"""
