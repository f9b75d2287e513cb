"""Licence scans with built-in functions only: Dice coefficient over word bigrams against templates.

Comment marks at the start of lines are taken off, then a text is compared in units: each line, each paragraph
(between empty lines) of more than one line, each run of up to RUN sentences, and the whole text; so a notice is met
within a longer line, hard-wrapped, in a comment, or next to code. Units of a template's own are the windows of its number
of words that start with one of its bigrams, so its notice is also met amid a sentence or a line of code. A template's
result is that of its best unit.

Prunes, none of which loses a match. With a and b distinct bigrams a unit and a template reach a coefficient
of at most 2 min(a, b) / (a + b), so a threshold t leaves only templates with t / (2 - t) <= a / b <= (2 - t) / t.
And a match has more than b t / (2 - t) bigrams of the template, so a text without any of the ``anchor_words``, which
touch all but fewer than that, is not looked at. Of the windows only those are compared in which so many places hold a
bigram of the template, which sorted places tell without counting: that so many places on is still within the window.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F, types as T

from evalkiln.llm.common import small_batches
from evalkiln.llm.spans import let

#: Notices and grant paragraphs of public licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
)
THRESHOLD = 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Regular expressions that Java, RE2 and Python read alike: comment marks, empty lines, ends of sentences.
MARKS = r"(^|\n)[ \t]*(?:/\*+|\*+/|\*+|#+|//+|--+|;+|%+|<!--|>+|\|)[ \t]*"
EMPTY_LINE = r"\n[ \t\r]*\n"
SENTENCE_END = r"[.;:!?][ \t\r\n]+|\n[ \t\r]*\n"
#: Words that say little about a text; anchors are other words where they suffice.
COMMON = frozenset("a an and any are as at be by can do either file following for found free from he if in into is it its may must name no not of on one or other public so source that the this to under use used was when with without work you your".split())


def bigrams(text: str) -> list[str]:
    """Bigrams of the normalised text: ASCII words in lower case, all else separates."""
    words = re.findall("[a-z0-9]+", text.translate(str.maketrans(_UPPER, _LOWER)))
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def _bound(n: int, threshold: float) -> tuple[int, int]:
    """Fewest and most bigrams of a unit that can reach the threshold with a template of n."""
    low, high = n * threshold / (2 - threshold), n * (2 - threshold) / threshold
    return math.ceil(low - 1e-9), math.floor(high + 1e-9)


def template_table(templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> list[dict]:
    """Per template: licence, words, distinct bigrams, and the fewest and most distinct bigrams of a unit that can match it."""
    out = []
    for licence, text in templates:
        found = sorted(set(bigrams(text)))
        least, most = _bound(len(found), threshold)
        out.append({"licence": licence, "least": least, "most": most, "words": len(re.findall("[a-z0-9]+", text.lower())), "grams": found})
    return out


def anchor_words(templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> list[str]:
    """Words of which every unit that matches a template has at least one; chosen by how many bigrams they touch."""
    left = [(set(bigrams(t)), len(set(bigrams(t))) * threshold / (2 - threshold)) for _, t in templates]
    chosen: list[str] = []
    while open_ := [(g, least) for g, least in left if len(g) >= least - 1e-9]:
        touched = Counter(w for g, _ in open_ for x in g for w in set(x.split()))
        chosen.append(max(touched, key=lambda w: (w not in COMMON and not w.isdigit(), touched[w], w)))
        left = [({x for x in g if chosen[-1] not in x.split()}, least) for g, least in left]
    return sorted(chosen)


def one_pattern(words: list[str]) -> str:
    """A regular expression of the words in which common starts are written once, so that few are tried at a place."""
    by: dict[str, list[str]] = {}
    for w in filter(None, words):
        by.setdefault(w[0], []).append(w[1:])
    if not by:
        return ""
    parts = "|".join(c + one_pattern(rest) for c, rest in sorted(by.items()))
    return f"(?:{parts})?" if "" in words else f"(?:{parts})"


def sentences_in_a_template(templates: tuple = TEMPLATES) -> int:
    return max(len([x for x in re.split(SENTENCE_END, t) if re.search("[A-Za-z0-9]", x)]) for _, t in templates)


def _units(text: Column, run: int) -> Column:
    """Lines, paragraphs, runs of sentences and the whole of a text without comment marks."""
    paragraphs = F.filter(F.split(text, EMPTY_LINE), lambda p: p.contains("\n") & (F.length(p) < F.length(text)))
    whole = F.when(text.contains("\n"), F.array(text)).otherwise(F.array().cast("array<string>"))
    sentences = F.filter(F.split(text, SENTENCE_END), lambda x: x.rlike("[A-Za-z0-9]"))
    runs = lambda s: F.flatten(F.transform(s, lambda _, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(run), F.size(s) - i)), lambda k: F.array_join(F.slice(s, i + 1, k), " "))))
    return F.concat(F.split(text, "\n"), paragraphs, let(sentences, runs), whole)


def scan_licences(docs: DataFrame, text_col: str = "text", templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with licence_matches: array of (dice, licence), one for each template at or above the threshold.

    The coefficient is that of the template's best unit; they are sorted by falling coefficient, then by licence. Size
    and coefficient are those of the sets of bigrams, so repeated wording changes nothing. Null and empty texts match
    nothing; repeated rows agree; a column of that name is replaced, other columns may have any name. Texts are read
    whole. Templates are a fixed table, the literal in the plan has its size.
    """
    small_batches(docs.sparkSession)
    rows = [{"i": i, **r} for i, r in enumerate(template_table(templates, threshold))]
    kind = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("licence", T.StringType()), T.StructField("least", T.IntegerType()), T.StructField("most", T.IntegerType()), T.StructField("words", T.IntegerType()), T.StructField("grams", T.ArrayType(T.StringType()))]))
    least = min(r["least"] for r in rows)
    words = lambda u: F.regexp_extract_all(F.translate(u, _UPPER, _LOWER), F.lit("[a-z0-9]+"), F.lit(0))

    def in_order(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))

    def dice(grams: Column, t: Column) -> Column:
        return F.struct((2.0 * F.size(F.array_intersect(grams, t["grams"])) / (F.size(grams) + F.size(t["grams"]))).alias("dice"), t["i"].alias("i"))

    def compare(w: Column, table: Column) -> Column:
        n, pairs = F.size(w) - 1, F.array_distinct(in_order(w))
        none = F.array().cast("array<struct<dice:double,i:int>>")
        by_size = lambda grams: F.filter(table, lambda t: F.size(grams).between(t["least"], t["most"]))
        scored = lambda grams: F.transform(by_size(grams), lambda t: dice(grams, t))
        return F.when(n >= least, let(pairs, lambda g: F.filter(scored(g), lambda s: s["dice"] >= threshold))).otherwise(none)

    def windows(w: Column, table: Column) -> Column:
        every = F.from_json(F.lit(json.dumps(sorted({g for r in rows for g in r["grams"]}))), T.ArrayType(T.StringType()))

        def of_template(placed: Column, t: Column) -> Column:
            at = F.transform(F.filter(placed, lambda x: F.array_contains(t["grams"], x["g"])), lambda x: x["at"])
            enough = lambda p: F.filter(p, lambda x, j: F.get(p, j + t["least"] - 1) - x <= t["words"] - 2)
            return F.transform(let(at, enough), lambda x: let(F.array_distinct(in_order(F.slice(w, x + 1, t["words"]))), lambda g: dice(g, t)))

        places = lambda grams, common: F.filter(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("at"))), lambda x: F.array_contains(common, x["g"]))
        placed = let(in_order(w), lambda grams: let(F.array_intersect(grams, every), lambda common: places(grams, common)))
        found = let(placed, lambda p: F.flatten(F.transform(table, lambda t: of_template(p, t))))
        return F.filter(found, lambda s: s["dice"] >= threshold)

    def best(hits: Column, table: Column) -> Column:
        of = lambda t: F.array_max(F.transform(F.filter(hits, lambda h: h["i"] == t["i"]), lambda h: h["dice"]))
        return F.filter(F.transform(table, lambda t: F.struct((-of(t)).alias("d"), t["licence"].alias("licence"))), lambda x: x["d"].isNotNull())

    plain = F.regexp_replace(F.col(text_col), MARKS, "$1")
    of_units = lambda table: F.flatten(F.transform(_units(plain, sentences_in_a_template(templates)), lambda u: let(words(u), lambda w: compare(w, table))))
    table = F.from_json(F.lit(json.dumps(rows)), kind)
    found = let(table, lambda t: let(F.concat(of_units(t), let(words(plain), lambda w: windows(w, t))), lambda hits: best(hits, t)))
    anchors = rf"(?i)(?<![A-Za-z0-9]){one_pattern(anchor_words(templates, threshold))}(?![A-Za-z0-9])"
    order = F.when(F.col(text_col).rlike(anchors), found).otherwise(F.array().cast("array<struct<d:double,licence:string>>"))
    return docs.withColumn("licence_matches", F.transform(F.array_sort(order), lambda s: F.struct((-s["d"]).alias("dice"), s["licence"].alias("licence"))))


def op2_licence_scans(spark, sf_dir: str) -> DataFrame:
    found = scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    best = F.get("licence_matches", F.lit(0))
    return found.select(
        "doc_id", F.size("licence_matches").cast("bigint").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.transform("licence_matches", lambda s: s["licence"]))), ",").alias("licences"),
        best["licence"].alias("best_licence"), F.round(best["dice"], 6).alias("best_dice"),
    )


def op2_sql() -> str:
    """The same rows without any pruning: bigrams of all units are joined to those of the templates and counted."""
    templates = ", ".join(f"({r}, '{t['licence']}', {t['words']}, [{', '.join(map(repr, t['grams']))}])" for r, t in enumerate(template_table()))
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return f"""
with templates(tid, licence, size, grams) as (values {templates}),
wanted as (select tid, unnest(grams) as gram from templates),
texts as materialized (select row_number() over () as rid, doc_id, regexp_replace(text, {quoted(MARKS)}, '\\1', 'g') as text from documents),
sentences as (select rid, list_filter(regexp_split_to_array(text, {quoted(SENTENCE_END)}), lambda x: regexp_matches(x, '[A-Za-z0-9]')) as s from texts where text is not null),
starts as (select rid, s, unnest(range(1, len(s) + 1)) as i from sentences),
pieces as (
  select rid, unnest(string_split(text, chr(10))) as unit from texts where text is not null
  union all
  select rid, unit from (select rid, text, unnest(regexp_split_to_array(text, {quoted(EMPTY_LINE)})) as unit from texts where text is not null)
  where contains(unit, chr(10)) and length(unit) < length(text)
  union all
  select rid, array_to_string(s[i:i + k - 1], ' ') from starts, range(1, {sentences_in_a_template() + 1}) r(k) where i + k - 1 <= len(s)
  union all
  select rid, text from texts where contains(text, chr(10))),
worded as (select row_number() over () as uid, rid, regexp_extract_all(translate(unit, '{_UPPER}', '{_LOWER}'), '[a-z0-9]+') as w from pieces),
paired as materialized (select uid, rid, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from worded where len(w) > 1),
shared as (select uid, tid, count(*) as c from (select uid, unnest(g) as gram from paired) join wanted using (gram) group by uid, tid),
scored as (select rid, tid, licence, 2.0::double * c / (len(g) + len(grams)) as dice from shared join paired using (uid) join templates using (tid)),
seq as materialized (select rid, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-z0-9]+') as w from texts where text is not null),
placed as (select rid, i, w[i] || ' ' || w[i + 1] as gram from (select rid, w, unnest(range(1, len(w))) as i from seq)),
cut as (select rid, tid, licence, grams, w[i:i + size - 1] as w from placed join wanted using (gram) join templates using (tid) join seq using (rid)),
windows as (select rid, tid, licence, grams, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from cut),
every as (select * from scored union all select rid, tid, licence, 2.0::double * len(list_intersect(g, grams)) / (len(g) + len(grams)) as dice from windows),
hits as (select rid, tid, any_value(licence) as licence, max(dice) as dice from every where dice >= {THRESHOLD} group by rid, tid),
by_doc as (
  select rid, count(*) as n_matches, string_agg(distinct licence, ',' order by licence) as licences,
         first(licence order by dice desc, licence) as best_licence, round(max(dice), 6) as best_dice
  from hits group by rid)
select d.doc_id, coalesce(n_matches, 0)::bigint as n_matches, coalesce(licences, '') as licences, best_licence, best_dice
from texts d left join by_doc b on d.rid = b.rid"""
