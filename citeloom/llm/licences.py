"""Licence scans: normalised passages against licence templates.

A passage is a line, a paragraph of several lines, or a whole text of several
paragraphs. Passages and templates are reduced to lower-case words and compared
by the Dice coefficient of their word bigrams, counted with repeats:
``2 * common / (of passage + of template)``. A coefficient of t bounds the
sizes: a template of b bigrams can only match passages of ``b * t / (2 - t)``
to ``b * (2 - t) / t``. Passages outside all bounds are dropped before their
bigrams are made, and a template only meets passages inside its own.

The templates are a fixed list, so their bigrams go to every task; documents
are never shuffled, only the few bigrams that a template shares.

Defined cases: a null text is an empty one and matches nothing, as do passages
of fewer than two words; of templates with the same coefficient the first by
name counts; repeated rows are matched each on its own; an empty table gives no
rows; other columns are not read.
"""

from math import ceil, floor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.registry import query, table

LEAST = 0.8
PASSAGES = "array<struct<kind:string,place:int,words:string,n:int>>"
#: Notices and texts by which works name their licence.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "Released under the GNU Affero General Public License v3.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License.",
    ),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    (
        "BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    (
        "CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GNU General Public License v3.0."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def plain(text: Column) -> Column:
    """Lower-case words of letters and digits, one space apart."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def with_bigrams(rows: DataFrame, words: Column) -> DataFrame:
    """``rows`` with ``pairs``: two words that follow each other; empty below two words.

    The words are a column of their own, so they are split once a row.
    """
    rows = rows.withColumn("split", F.split(words, " "))
    last = F.size("split") - 1
    pairs = F.zip_with(F.slice("split", F.lit(1), last), F.slice("split", F.lit(2), last), lambda a, b: F.concat_ws(" ", a, b))
    return rows.withColumn("pairs", pairs).drop("split")


def bounds(size: int, least: float = LEAST) -> tuple[int, int]:
    """Fewest and most bigrams of a passage that can match a template of ``size``."""
    return ceil(size * least / (2 - least) - 1e-9), floor(size * (2 - least) / least + 1e-9)


def template_bigrams(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(template, licence, size, fewest, most, bigram, repeats), and all bounds."""
    rows = spark.createDataFrame([(k, *t) for k, t in enumerate(templates)], "template int, licence string, text string")
    sized = with_bigrams(rows, plain(F.col("text"))).collect()
    flat, all_bounds = [], []
    for t in sized:
        fewest, most = bounds(len(t["pairs"]))
        all_bounds.append((fewest, most))
        flat += [
            (t["template"], t["licence"], len(t["pairs"]), fewest, most, b, t["pairs"].count(b)) for b in sorted(set(t["pairs"]))
        ]
    schema = "template int, licence string, size int, fewest int, most int, bigram string, repeats int"
    return spark.createDataFrame(flat, schema), all_bounds


def passages(rows: DataFrame) -> DataFrame:
    """(row, doc_id, passages) from (row, doc_id, text): an array<struct<kind, place, words, n>>.

    Lines come first, then paragraphs of several lines, then the whole text if
    it has several paragraphs; n counts bigrams.
    """

    def passage(kind: str, place: Column, words: Column) -> Column:
        n = F.length(words) - F.length(F.replace(words, F.lit(" ")))
        return F.struct(F.lit(kind).alias("kind"), place.alias("place"), words.alias("words"), n.cast("int").alias("n"))

    lined = rows.withColumn("lines", F.transform(F.split("text", "\n"), plain)).drop("text")
    parted = lined.withColumn("paragraphs", F.split(F.array_join("lines", "\n"), "\n\n+"))
    numbered = F.transform("paragraphs", lambda p, i: F.struct(i.alias("place"), p.alias("body")))
    several = F.filter(numbered, lambda p: p["body"].contains("\n"))
    joined = F.transform(several, lambda p: F.struct(p["place"], F.trim(F.translate(p["body"], "\n", " ")).alias("words")))
    whole = F.when(F.size("paragraphs") > 1, F.array(F.array_join(F.filter("lines", lambda w: w != ""), " ")))
    held = parted.select("row", "doc_id", "lines", joined.alias("joined"), whole.alias("whole"))
    return held.select(
        "row",
        "doc_id",
        F.concat(
            F.transform("lines", lambda w, i: passage("line", i, w)),
            F.transform("joined", lambda p: passage("paragraph", p["place"], p["words"])),
            F.coalesce(F.transform("whole", lambda w: passage("text", F.lit(0), w)), F.array().cast(PASSAGES)),
        ).alias("passages"),
    )


def licence_passages(
    docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST
) -> DataFrame:
    """(doc_id, kind, place, licence, dice): the best licence of every passage that matches one."""
    known, all_bounds = template_bigrams(docs.sparkSession, templates)
    spans: list[list[int]] = []
    for low, high in sorted(all_bounds):
        if spans and low <= spans[-1][1] + 1:
            spans[-1][1] = max(spans[-1][1], high)
        else:
            spans.append([low, high])

    def of_some_size(p: Column) -> Column:
        fits = F.lit(False)
        for low, high in spans:
            fits = fits | p["n"].between(max(low, 1), high)
        return fits

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    found = passages(rows).select("row", "doc_id", F.explode(F.filter("passages", of_some_size)).alias("p"))
    pairs = with_bigrams(found.select("row", "doc_id", "p.*"), F.col("words"))
    pairs = pairs.select("row", "doc_id", "kind", "place", "n", F.explode("pairs").alias("bigram"))
    # A fixed list: its size has nothing to do with the documents.
    shared = pairs.join(F.broadcast(known), "bigram").filter(F.col("n").between(F.col("fewest"), F.col("most")))
    passage = ["row", "doc_id", "kind", "place", "n", "template", "licence", "size"]
    common = (
        shared.groupBy(*passage, "bigram", "repeats")
        .agg(F.count(F.lit(1)).alias("here"))
        .groupBy(*passage)
        .agg(F.sum(F.least("here", "repeats")).alias("common"))
        .withColumn("dice", 2.0 * F.col("common") / (F.col("n") + F.col("size")))
        .filter(F.col("dice") >= least)
    )
    best = F.min(F.struct(-F.col("dice"), "licence"))
    return common.groupBy("row", "doc_id", "kind", "place").agg(best.alias("best")).select(
        "doc_id", "kind", "place", "best.licence", (-F.col("best.col1")).alias("dice")
    )


def _oracle() -> str:
    values = ",\n".join(f"({k}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for k, (name, text) in enumerate(TEMPLATES))
    plain_sql = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    return rf"""
WITH templates(template, licence, text) AS (VALUES {values}),
known AS (
  SELECT template, licence, len(w) - 1 AS size, w[i] || ' ' || w[i + 1] AS bigram FROM (
    SELECT template, licence, w, unnest(range(1, len(w))) AS i FROM (
      SELECT template, licence, str_split({plain_sql.format("text")}, ' ') AS w FROM templates))
), counted AS (SELECT template, licence, size, bigram, count(*) AS repeats FROM known GROUP BY ALL),
lined AS (
  SELECT row_number() OVER () AS r, doc_id, [{plain_sql.format("x")} FOR x IN str_split(coalesce(text, ''), chr(10))] AS lines FROM documents
), parted AS (SELECT *, regexp_split_to_array(array_to_string(lines, chr(10)), '\n\n+') AS paragraphs FROM lined),
passages AS (
  SELECT r, doc_id, 'line' AS kind, unnest(range(len(lines))) AS place, unnest(lines) AS words FROM parted
  UNION ALL SELECT * FROM (
    SELECT r, doc_id, 'paragraph', unnest(range(len(paragraphs))), trim(replace(unnest(paragraphs), chr(10), ' ')) AS words FROM parted)
  UNION ALL SELECT r, doc_id, 'text', 0, trim(regexp_replace(array_to_string(lines, ' '), ' +', ' ', 'g')) FROM parted WHERE len(paragraphs) > 1
), several AS (
  SELECT p.* FROM passages p LEFT JOIN (
    SELECT r, unnest(range(len(paragraphs))) AS place, unnest(paragraphs) AS body FROM parted) b ON p.kind = 'paragraph' AND b.r = p.r AND b.place = p.place
  WHERE p.kind <> 'paragraph' OR contains(b.body, chr(10))
), worded AS (SELECT r, doc_id, kind, place, str_split(words, ' ') AS w FROM several),
paired AS (
  SELECT r, doc_id, kind, place, len(w) - 1 AS n, w[i] || ' ' || w[i + 1] AS bigram FROM (
    SELECT *, unnest(range(1, len(w))) AS i FROM worded WHERE len(w) > 1)
), here AS (SELECT r, doc_id, kind, place, n, bigram, count(*) AS here FROM paired GROUP BY ALL),
scored AS (
  SELECT r, doc_id, kind, place, template, licence, 2.0::DOUBLE * sum(least(here, repeats)) / (n + size) AS dice
  FROM here JOIN counted USING (bigram) GROUP BY r, doc_id, kind, place, n, template, licence, size
)
SELECT doc_id, kind, place::INTEGER AS place, arg_min(licence, (-dice, licence)) AS licence, max(dice)::DOUBLE AS dice
FROM scored WHERE dice >= 0.8 GROUP BY r, doc_id, kind, place
"""


@query("op1_licence_scan", _oracle())
def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_passages(table(spark, sf_dir, "documents"))
