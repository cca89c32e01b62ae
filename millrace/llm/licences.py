"""Licence scan with DataFrame functions only: normalised text against licence
templates by the Dice coefficient over word bigrams.

A document's units are its lines, its paragraphs of several lines and, if it
has several paragraphs, the whole text.  A unit is lower-cased and reduced to
letters and digits; its distinct word bigrams A are compared with a template's
B by 2|A∩B| / (|A|+|B|).  That can reach a threshold t only if
|B| t/(2-t) <= |A| <= |B| (2-t)/t, so templates outside these bounds are
pruned before any bigram is compared, and units that fit no template earlier still.

Everything happens within a row and its exploded units: no shuffle.  Defined
results: null and empty texts have no match; repeated rows match each; ties
between templates give a row each; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Public licence notices and texts that documents are compared with.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "bsd-3-clause": "Released under the BSD 3-Clause License.",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-4.0-name": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-4.0-name": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-4.0-name": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

_APART = r"[^\p{L}\p{N}]+"
_PARAGRAPH = r"\n[ \t\r]*\n"


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), _APART, " ")), " ")


def _bigrams(words: Column) -> Column:
    """Distinct neighbouring word pairs of at least two words."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1))))


def template_sizes(templates: dict[str, str]) -> dict[str, list[str]]:
    """Distinct bigrams of each template, by the rule that texts follow."""
    out = {}
    for name, text in templates.items():
        words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
        out[name] = list(dict.fromkeys(" ".join(p) for p in zip(words, words[1:])))
    return out


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(key, scope, position, licence, dice) of every unit and template whose Dice coefficient reaches the threshold."""
    least, most = threshold / (2 - threshold), (2 - threshold) / threshold
    pairs = template_sizes(templates)
    fewest = math.ceil(min(len(b) * least for b in pairs.values()))
    highest = math.floor(max(len(b) * most for b in pairs.values()))
    table = F.array(*[F.struct(F.lit(name).alias("licence"), F.array(*map(F.lit, b)).alias("pairs"), F.lit(len(b)).alias("n")) for name, b in pairs.items()])
    whole = F.col("t")
    lines, paragraphs = F.split(whole, "\n"), F.split(whole, _PARAGRAPH)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(whole.isNotNull())

    def units(scope: str, parts: Column, of: DataFrame) -> DataFrame:
        return of.select("k", F.lit(scope).alias("scope"), F.posexplode(parts).alias("position", "unit"))

    several = rows.where(F.contains(whole, F.lit("\n")))
    found = units("line", lines, rows).unionByName(units("paragraph", paragraphs, several).where(F.contains("unit", F.lit("\n"))))
    found = found.unionByName(units("document", F.array(whole), several.where(F.size(paragraphs) > 1)))
    # a text of d different words has d - 1 different bigrams or more
    found = found.withColumn("words", _words(F.col("unit"))).where((F.size("words") > max(fewest, 1)) & (F.size(F.array_distinct("words")) - 1 <= highest)).drop("unit")
    found = found.withColumn("pairs", _bigrams(F.col("words"))).withColumn("n", F.size("pairs")).drop("words")
    fits = F.filter(table, lambda t: (F.col("n") >= t["n"] * least) & (F.col("n") <= t["n"] * most))
    found = found.select("k", "scope", "position", "pairs", "n", F.explode(fits).alias("template"))
    dice = 2.0 * F.size(F.array_intersect("pairs", F.col("template.pairs"))) / (F.col("n") + F.col("template.n"))
    found = found.select(F.col("k").alias(key), "scope", "position", F.col("template.licence").alias("licence"), F.round(dice, 6).alias("dice"))
    return found.where(F.col("dice") >= threshold)


def op10_licence_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


_ROWS = ", ".join("('%s', '%s')" % (n, t.replace("'", "''")) for n, t in TEMPLATES.items())
OP10_SQL = rf"""
WITH templates AS (
  SELECT licence, string_split(trim(regexp_replace(lower(body), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM (VALUES {_ROWS}) AS v(licence, body)
), t AS (
  SELECT licence, list_distinct(list_transform(range(0, len(w) - 1), lambda i: w[i + 1] || ' ' || w[i + 2])) AS pairs FROM templates
), units AS (
  SELECT doc_id, 'line' AS scope, unnest(string_split(text, chr(10))) AS unit, unnest(range(0, len(string_split(text, chr(10))))) AS position FROM documents
  UNION ALL
  SELECT doc_id, 'paragraph', unnest(string_split_regex(text, '\n[ \t\r]*\n')), unnest(range(0, len(string_split_regex(text, '\n[ \t\r]*\n')))) FROM documents
  UNION ALL
  SELECT doc_id, 'document', text, 0 FROM documents WHERE len(string_split_regex(text, '\n[ \t\r]*\n')) > 1
), words AS (
  SELECT doc_id, scope, position, string_split(trim(regexp_replace(lower(unit), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w
  FROM units WHERE scope <> 'paragraph' OR contains(unit, chr(10))
), u AS (
  SELECT doc_id, scope, position, list_distinct(list_transform(range(0, len(w) - 1), lambda i: w[i + 1] || ' ' || w[i + 2])) AS pairs
  FROM words WHERE len(w) >= 2
), d AS (
  SELECT doc_id, scope, position, licence, round(2.0 * len(list_intersect(u.pairs, t.pairs)) / (len(u.pairs) + len(t.pairs)), 6) AS dice
  FROM u JOIN t ON len(u.pairs) BETWEEN len(t.pairs) * 0.8 / 1.2 AND len(t.pairs) * 1.2 / 0.8
)
SELECT doc_id, scope, CAST(position AS INTEGER) AS position, licence, CAST(dice AS DOUBLE) AS dice FROM d WHERE dice >= 0.8
"""
