"""Licence scans: lines, paragraphs and word windows against licence templates by Dice over
word bigrams.

A unit of text is a line, or a paragraph of several lines (a whole notice). It is
normalised to lower-case words. With ``a`` and ``b`` different bigrams, Dice is at most
``2 min(a, b) / (a + b)``, so a template is a candidate only for units of a size near its
own, and units near no template's size are left before their bigrams are made. A match
also shares so many bigrams with its template that it must have one of any few too many
to miss; a pattern of a long word from each of those sorts out texts and units without
any, and loses no match. The best template of each unit counts.

A notice may share its line or paragraph with other words. The words outside of matching
units, over the whole text, are therefore compared window by window: from each shared
bigram to each later one, within the template's size bounds. A window that is cut where
the words begin to differ counts as many bigrams as its template at least, as if the words
that stand in place of the template's were in it; so a window and a line with the same
words reach the same Dice, and one threshold holds for both. Of windows that overlap the
best counts. All of it is one projection over the scan: nothing is shuffled, grouped or
collected.

A line without a letter or digit (comment marks, ``\\r``) ends a paragraph.

Defined cases: null and empty texts, and units of fewer than two words, match nothing; of
templates with equal Dice the first by name and text is the best; repeated rows give
repeated results; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least Dice coefficient of a match.
THRESHOLD = 0.7

# The wording of public licence notices.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
            "permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
                "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD", "Released under the BSD License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

_NO_WORD = r"[^\p{L}\p{N}]+"
_BLANK_LINE = r"\n[^\n\p{L}\p{N}]*\n"
_MATCHES = "array<struct<less:double,order:int,license:string,start:int,stop:int>>"


def template_bigrams(text: str) -> list[str]:
    words = re.findall(r"[^\W_]+", text.lower())
    return list(dict.fromkeys(map(" ".join, zip(words, words[1:]))))


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """The sizes that can reach ``threshold`` against a template of ``size`` bigrams."""
    return math.ceil(threshold * size / (2 - threshold) - 1e-9), math.floor((2 - threshold) * size / threshold + 1e-9)


def _templates(templates, threshold: float) -> list[tuple[str, list[str], int, int]]:
    rows = [(name, bigrams) for name, text in sorted(templates) if (bigrams := template_bigrams(text))]
    return [(name, bigrams, *size_bounds(len(bigrams), threshold)) for name, bigrams in rows]


def anchor_words(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[str]:
    """Words of which every unit that matches a template has at least one: a match shares
    ``need`` of its ``b`` bigrams or more, so one of any ``b - need + 1``; those with the
    longest words are taken, and of each its longest word."""
    words = set()
    for _, bigrams, low, _ in _templates(templates, threshold):
        need = math.ceil(threshold * (low + len(bigrams)) / 2 - 1e-9)
        longest = sorted((max(b.split(), key=len) for b in bigrams), key=len, reverse=True)
        words.update(longest[:len(bigrams) - need + 1])
    return sorted(words)


def _anchor_pattern(templates, threshold: float) -> str:
    """One alternative for each first letter; tried after a character that is no letter."""
    by_first: dict[str, list[str]] = {}
    for word in anchor_words(templates, threshold):
        by_first.setdefault(word[0], []).append(word[1:])
    return "(?:^|[^a-z0-9])(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by_first.items()) + ")"


def _with(value: Column, function: Callable[[Column], Column]) -> Column:
    """``function`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), function), 1)


def _pairs(words: Column) -> Column:
    return F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))


def _clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _NO_WORD, " "))


def _less(bigrams: Column, template: Column, size: Column | None = None) -> Column:
    size = F.size(bigrams) if size is None else size
    return -(2.0 * F.size(F.array_intersect(bigrams, template["bigrams"])) / (size + F.size(template["bigrams"])))


def _window_matches(bigrams: Column, listed: Column, every: Column, threshold: float) -> Column:
    """The best windows, none over another, of a text's bigrams in order. A window starts and
    stops with a shared bigram, as its Dice only falls when others are added at its ends."""
    def windows(t: Column) -> Column:
        places = F.filter(F.transform(bigrams, lambda b, i: F.when(F.array_contains(t["bigrams"], b), i)), lambda i: i.isNotNull())

        def from_start(hits: Column, start: Column) -> Column:
            stops = F.filter(hits, lambda stop: (stop - start).between(t["need"] - 1, t["span"] - 1))
            return F.transform(stops, lambda stop: F.struct(
                _with(F.array_distinct(F.slice(bigrams, start + 1, stop - start + 1)), lambda w: _less(w, t, F.greatest(F.size(w), F.size(t["bigrams"])))).alias("less"),
                t["order"].alias("order"), t["license"].alias("license"), start.alias("start"), stop.alias("stop")))

        def found(hits: Column) -> Column:
            starts = F.filter(hits, lambda start, k: F.coalesce(F.get(hits, k + t["need"] - 1) - start < t["span"], F.lit(False)))
            return F.filter(F.flatten(F.transform(starts, lambda start: from_start(hits, start))), lambda m: m["less"] <= -threshold)

        return _with(places, found)

    def apart(kept: Column, m: Column) -> Column:
        over = F.exists(kept, lambda k: (k["start"] <= m["stop"] + 1) & (m["start"] <= k["stop"] + 1))
        return F.when(over, kept).otherwise(F.concat(kept, F.array(m)))

    def near(present: Column) -> Column:
        return F.filter(listed, lambda t: F.size(F.array_intersect(t["bigrams"], present)) >= t["need"])

    candidates = F.flatten(F.transform(_with(F.array_intersect(bigrams, every), near), windows)).cast(_MATCHES)
    kept = F.aggregate(F.array_sort(candidates), F.array().cast(_MATCHES), apart)
    return F.transform(kept, lambda m: F.struct(m["less"].alias("less"), m["order"].alias("order"), m["license"].alias("license")))


def license_matches(lowered: Column, templates=TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """The best match of each unit of a text in lower case, and of the windows outside of
    those: an array of ``less`` (the negated Dice coefficient), ``order`` and ``license``."""
    known = _templates(templates, threshold)
    ends = [words for _, text in sorted(templates) if len(words := re.findall(r"[^\W_]+", text.lower())) > 1]
    listed = F.array(*(F.struct(
        F.lit(order).alias("order"), F.lit(name).alias("license"), F.array(*map(F.lit, bigrams)).alias("bigrams"), F.lit(low).alias("low"),
        F.lit(high).alias("high"), F.lit(max(1, math.ceil(threshold * (low + len(bigrams)) / 2 - 1e-9))).alias("need"),
        F.lit(high + len(words) - 1 - len(bigrams)).alias("span"))
        for order, ((name, bigrams, low, high), words) in enumerate(zip(known, ends))))
    every = F.array(*map(F.lit, dict.fromkeys(b for _, bigrams, *_ in known for b in bigrams)))
    most = max(high for *_, high in known)
    least = min(low for *_, low, _ in known)
    anchors = _anchor_pattern(templates, threshold)
    nothing = F.array().cast("array<struct<less:double,order:int,license:string>>")

    def against(bigrams: Column) -> Column:
        near = F.filter(listed, lambda t: F.size(bigrams).between(t["low"], t["high"]))
        scored = F.transform(near, lambda t: F.struct(_less(bigrams, t).alias("less"), t["order"].alias("order"), t["license"].alias("license")))
        return F.slice(F.array_sort(F.filter(scored, lambda m: m["less"] <= -threshold)), 1, 1)

    def of_words(clean: Column) -> Column:
        # A unit has as many bigrams as spaces, fewer different ones.
        spaces = F.length(clean) - F.length(F.replace(clean, F.lit(" "), F.lit("")))
        pairs = F.when(spaces >= max(least, 1), F.array_distinct(_pairs(F.split(clean, " "))))
        return _with(pairs, lambda b: F.when(F.size(b).between(least, most), against(b)).otherwise(nothing))

    def of_unit(unit: Column) -> Column:
        return F.when(unit.rlike(anchors), _with(_clean(unit), of_words)).otherwise(nothing)

    def of_paragraph(paragraph: Column) -> Column:
        lines = F.transform(F.split(paragraph, "\n", -1), lambda u: F.struct(u.alias("text"), of_unit(u).alias("found")))
        return F.struct(lines.alias("lines"), F.when(paragraph.contains("\n"), of_unit(paragraph)).otherwise(nothing).alias("found"))

    def outside(paragraph: Column) -> Column:
        # Normalised words hold no "|", so it marks where a matching unit stood.
        lines = F.transform(paragraph["lines"], lambda u: F.when(F.size(u["found"]) > 0, "|").otherwise(_clean(u["text"])))
        return F.when(F.size(paragraph["found"]) > 0, "|").otherwise(F.array_join(lines, " "))

    def of_rest(rest: Column) -> Column:
        words = F.split(F.trim(F.regexp_replace(rest, " +", " ")), " ")
        return F.when(rest.rlike(anchors), _with(_pairs(words), lambda b: _window_matches(b, listed, every, threshold))).otherwise(nothing)

    def of_text(paragraphs: Column) -> Column:
        units = F.transform(paragraphs, lambda p: F.concat(F.flatten(p["lines"]["found"]), p["found"]))
        return F.concat(F.flatten(units), _with(F.array_join(F.transform(paragraphs, outside), " "), of_rest))

    return F.when(lowered != "", _with(F.transform(F.split(lowered, _BLANK_LINE, -1), of_paragraph), of_text)).otherwise(nothing)


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``license`` (the best), ``dice``, ``licenses`` (of all units, by
    name) and ``n_units`` (matching lines and paragraphs, and windows outside of those) for
    every row."""
    lowered = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("low"))
    worth = lowered.withColumn("low", F.when(F.col("low").rlike(_anchor_pattern(templates, threshold)), F.col("low")).otherwise(""))
    found = worth.select("doc_id", license_matches(F.col("low"), templates, threshold).alias("found"))
    return found.withColumn("best", F.try_element_at(F.array_sort("found"), F.lit(1))).select(
        "doc_id", F.col("best.license").alias("license"), (-F.col("best.less")).alias("dice"),
        F.concat_ws(",", F.array_sort(F.array_distinct("found.license"))).alias("licenses"), F.size("found").cast("long").alias("n_units"))


def oracle_sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    known = _templates(templates, threshold)
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",\n".join(f"({i}, {quote(name)}, [{', '.join(map(quote, bigrams))}])" for i, (name, bigrams, *_) in enumerate(known))
    return f"""
WITH templates(o, license, bigrams) AS (VALUES {values}),
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
units AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS u, 0 AS kind FROM docs
  UNION ALL
  SELECT doc_id, u, 1 FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n[ \\t]*\\n')) AS u FROM docs) WHERE contains(u, chr(10))),
clean AS (SELECT row_number() OVER () AS id, doc_id, string_split(trim(regexp_replace(lower(u), '{_NO_WORD}', ' ', 'g')), ' ') AS w FROM units),
pairs AS (SELECT id, doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM clean WHERE len(w) > 1),
scored AS (
  SELECT id, doc_id, o, license, 2.0::DOUBLE * len(list_intersect(b, bigrams)) / (len(b) + len(bigrams)) AS dice
  FROM pairs, templates WHERE len(b) <= 4 * len(bigrams) + 4),
found AS (
  SELECT * FROM scored WHERE dice >= {threshold}
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY dice DESC, o) = 1),
per AS (
  SELECT doc_id, arg_min(license, (-dice, o)) AS license, max(dice) AS dice, count(*) AS n_units,
    array_to_string(list_sort(list_distinct(list(license))), ',') AS licenses
  FROM found GROUP BY doc_id)
SELECT doc_id, license, dice, coalesce(licenses, '') AS licenses, coalesce(n_units, 0) AS n_units FROM docs LEFT JOIN per USING (doc_id)"""
