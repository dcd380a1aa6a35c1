"""Licence scans: Dice coefficient over word bigrams against licence templates, with DataFrame functions only.

The whole text, its paragraphs, its lines and its sentences are the units; line breaks may have a carriage return. A unit
and a template are sets of word bigrams (words are runs of a-z and 0-9 of the lower-cased text); their Dice coefficient
is 2 * common / (size + size). A coefficient of d or more needs a unit of between d / (2 - d) and (2 - d) / d times the
template's size, so other templates are pruned by size before anything is intersected, and a unit with more distinct words
than the largest template allows bigrams is dropped before its bigrams are made, as long texts and paragraphs are.

Scale: one projection of each row, without a shuffle, a join or Python; the templates are a fixed literal.

Defined cases: a null, empty or blank text has no match (null licence, dice null, 0 hits); ties go to the licence that
sorts first; a very long text is read whole; rows are independent, so repeats and order do not matter; an empty table
gives an empty result; a column of the input named licence, dice, licences or n_hits gives way, others stay, whatever
their names; the query ignores them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DICE = 0.8
#: Well-known public licence notices, by name.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def bigrams(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _literal(templates: dict[str, str], dice: float) -> str:
    rows = []
    for name, text in sorted(templates.items()):
        grams = bigrams(text)
        rows.append(f"named_struct('name', '{name}', 'n', {len(grams)}, 'low', {len(grams) * dice / (2 - dice)}D, 'high', {len(grams) * (2 - dice) / dice}D, 'grams', array({', '.join(repr(g) for g in grams)}))")
    return f"array({', '.join(rows)})"


#: Where a text is split into units, beside the whole of it: paragraphs, lines, sentences.
SPLITS = (r"\r?\n[ \t]*\r?\n", r"\r?\n", r"[.!?][\x22\x27)]*[ \t\r\n]+")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, dice: float = DICE) -> DataFrame:
    """``docs`` with licence (the best), dice, licences (all, joined by commas) and n_hits (units and templates that match)."""
    templates = TEMPLATES if templates is None else templates
    chosen, most = _literal(templates, dice), max([0, *(len(bigrams(t)) for t in templates.values())]) * (2 - dice) / dice
    text, own = "coalesce(text, '')", ["licence", "dice", "licences", "n_hits"]
    splits = ", ".join(f"split({text}, r'{x}')" for x in SPLITS)
    units = common.packed(docs.drop(*own), "text").withColumn("_units", F.expr(f"array_distinct(concat(array({text}), {splits}))"))
    words = units.withColumn("_words", F.expr(f"filter(transform(_units, u -> regexp_extract_all(lower(u), '[a-z0-9]+', 0)), w -> size(w) > 1 and size(array_distinct(w)) <= {most + 1}D)"))
    grams = words.withColumn("_grams", F.expr("transform(_words, w -> array_distinct(zip_with(slice(w, 1, size(w) - 1), slice(w, 2, size(w) - 1), (a, b) -> concat(a, ' ', b))))"))
    pairs = f"""flatten(transform(_grams, g -> transform(filter({chosen}, t -> size(g) >= t.low and size(g) <= t.high),
        t -> named_struct('less', -2D * size(array_intersect(g, t.grams)) / (size(g) + t.n), 'name', t.name))))"""
    hits = grams.withColumn("_hits", F.expr(f"filter({pairs}, h -> h.less <= -{dice}D)"))
    return hits.select(
        *[F.col(f"_row.`{c}`") for c in docs.columns if c not in own],
        F.expr("array_min(_hits).name").alias("licence"),
        F.expr("-array_min(_hits).less").alias("dice"),
        F.expr("array_join(array_sort(array_distinct(transform(_hits, h -> h.name))), ',')").alias("licences"),
        F.expr("cast(size(_hits) as long)").alias("n_hits"),
    )


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def _sql() -> str:
    values = ", ".join(f"('{name}', '{gram}')" for name, text in sorted(TEMPLATES.items()) for gram in bigrams(text))
    splits = ", ".join(f"regexp_split_to_array(coalesce(text, ''), '{x}')" for x in SPLITS)
    return f"""
WITH t(name, gram) AS (VALUES {values}),
sizes AS (SELECT name, count(*) AS n FROM t GROUP BY name),
units AS (
  SELECT DISTINCT doc_id, unnest(list_concat([coalesce(text, '')], {splits})) AS unit
  FROM documents
),
words AS (SELECT doc_id, unit, regexp_extract_all(lower(unit), '[a-z0-9]+') AS w FROM units),
grams AS (SELECT DISTINCT doc_id, unit, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM words WHERE len(w) > 1),
unit_sizes AS (SELECT doc_id, unit, count(*) AS n FROM grams GROUP BY doc_id, unit),
common AS (SELECT g.doc_id, g.unit, t.name, count(*) AS c FROM grams g JOIN t ON t.gram = g.gram GROUP BY g.doc_id, g.unit, t.name),
hits AS (
  SELECT c.doc_id, c.name, 2.0::DOUBLE * c.c / (u.n + s.n) AS dice
  FROM common c JOIN unit_sizes u ON u.doc_id = c.doc_id AND u.unit = c.unit JOIN sizes s ON s.name = c.name
  WHERE 2.0::DOUBLE * c.c / (u.n + s.n) >= {DICE}::DOUBLE
),
best AS (
  SELECT doc_id, arg_min(name, (-dice, name)) AS licence, max(dice) AS dice, string_agg(DISTINCT name, ',' ORDER BY name) AS licences, count(*) AS n_hits
  FROM hits GROUP BY doc_id
)
SELECT d.doc_id, b.licence, b.dice, coalesce(b.licences, '') AS licences, coalesce(b.n_hits, 0)::BIGINT AS n_hits
FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id
"""


SQL = _sql()
