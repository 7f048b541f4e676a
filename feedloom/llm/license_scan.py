"""License scans by an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A block of a template is a run of consecutive words, 1 + SLACK times as long as the template (cut at the end of the
text), wherever lines end. Words that templates use are counted over the whole corpus and put in that order, rarest
first. A block that has ceil(t * n) of a template's n distinct words has one of its n - ceil(t * n) + 1 rarest ones
(prefix filter): these are the index, and a join on the word finds the candidates. A segment of a text meets a template
at the first of these words that both have; from there on they must share enough words (length and positional filter).
Then each block that starts with a word of the template is compared with the template's whole set: any other block can
be moved on to the next such word without a loss.

Segments are SEGMENT words, each with as many more as the longest block needs, so no row grows with its text after the
first step. An index of at most MAX_TERMS rows and MAX_BYTES bytes is broadcast, and its words choose the segments
before the join; a larger one is joined by a shuffle of each segment's distinct words.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.words import BETWEEN, LOWER, UPPER, word_count, word_line, word_list
from feedloom.plans.persist import materialize

MAX_TERMS = 5000
MAX_BYTES = 8 << 20
CONTAINMENT = 0.9
#: Share of a template's length that a block may have in other words.
SLACK = 0.25
SEGMENT = 1024

#: Phrases whose places are counted, and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Notices by label, in the words of the licenses themselves.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2.0",
    "apache-2.0-header": "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "apache-2.0-grant": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-4.0": "licensed under the creative commons attribution 4.0 international license",
    "cc-by-nc-4.0": "licensed under cc by nc 4.0",
    "cc-by-sa-4.0": "licensed under cc by sa 4.0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "gpl-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2.0",
}


def split_words(text: str) -> list[str]:
    return [w for w in re.split(BETWEEN, text.translate(str.maketrans(UPPER, LOWER))) if w]


def block_length(words: int, slack: float = SLACK) -> int:
    return math.ceil(words * (1 + slack) - 1e-9)


def template_index(docs: DataFrame, templates: dict[str, str], containment: float, slack: float, text_col: str) -> DataFrame:
    """One row for each of a template's prefix words: w, place (how many of its words are rarer), label, terms (its words,
    rarest first), n, need, width. Templates without words have none."""
    split = [(label, split_words(text)) for label, text in templates.items()]
    spark = docs.sparkSession
    own = spark.createDataFrame(
        [(label, sorted(set(words)), block_length(len(words), slack)) for label, words in split if words], "label string, words array<string>, width int"
    )
    vocabulary = sorted({w for _, words in split for w in words})
    corpus = docs.select(F.explode(word_list(F.col(text_col))).alias("w"))
    if len(vocabulary) <= MAX_TERMS:
        corpus = corpus.filter(F.col("w").isin(vocabulary))
    counts = corpus.groupBy("w").agg(F.count("*").alias("c"))
    terms = own.select("label", "width", F.explode("words").alias("w")).join(counts, "w", "left")
    ordered = terms.groupBy("label", "width").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "w"))).getField("w").alias("terms"))
    ordered = ordered.withColumn("n", F.size("terms")).withColumn("need", F.ceil(F.col("n") * F.lit(containment) - 1e-9).cast("int"))
    prefix = F.slice("terms", F.lit(1), F.col("n") - F.col("need") + 1)
    return ordered.select("*", F.posexplode(prefix).alias("place", "w"))


def literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def block_matches(segments: DataFrame, index: DataFrame, rare: list[str] | None, segment: int) -> DataFrame:
    """row, blocks (array<struct<label, start, share>>) of the rows of segments (row, base, words) that have any."""
    words = F.col("words")
    keys = F.array_distinct(words) if rare is None else F.array_intersect(literal(rare), words)
    met = segments.select("row", "base", "words", F.explode(keys).alias("w")).join(index, "w")
    # the segment's first prefix word of this template only, so that each pair is compared once
    met = met.filter((F.col("place") == 0) | ~F.arrays_overlap(F.slice("terms", F.lit(1), F.greatest(F.col("place"), F.lit(1))), words))
    met = met.filter(F.size(F.array_intersect("terms", "words")) >= F.col("need"))
    starts = F.filter(F.sequence(F.lit(1), F.least(F.lit(segment), F.size(words))), lambda i: F.array_contains(F.col("terms"), F.get(words, i - 1)))
    shared = F.transform(starts, lambda i: F.struct(i.alias("i"), F.size(F.array_intersect(F.col("terms"), F.slice(words, i, F.col("width")))).alias("k")))
    hits = F.transform(
        F.filter(shared, lambda x: x["k"] >= F.col("need")),
        lambda x: F.struct(F.col("label").alias("label"), (F.col("base") + x["i"] - 1).cast("long").alias("start"), (x["k"] / F.col("n").cast("double")).alias("share")),
    )
    hits = met.select("row", hits.alias("hits")).filter(F.size("hits") > 0)
    return hits.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("blocks"))


def license_scan(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    phrases: dict[str, str] | None = None,
    containment: float = CONTAINMENT,
    slack: float = SLACK,
    segment: int = SEGMENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    n_base counts the places of the phrases, also those that overlap; first_word and last_word are their smallest and
    largest starts (null without any). blocks lists each block that starts with a template's word and has at least the
    share `containment` of its distinct words, by label and first word. labels are those of the phrases and of the
    templates, sorted. score is the greatest share of a template found in a block, 1 where a phrase stands, else 0.
    Null and empty texts have no words and no labels; repeated rows have a row each, null ids and ties need no order; an
    empty table gives an empty result; other columns are not looked at.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    index = materialize(template_index(docs, templates, containment, slack, text_col), "license-index")
    size = index.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.array_join("terms", " "))).alias("b"), F.max("width").alias("width")).first()
    bounded = size["n"] <= MAX_TERMS and (size["b"] or 0) <= MAX_BYTES
    rare = sorted(r["w"] for r in index.select("w").distinct().collect()) if bounded else None

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), word_line(text).alias("line"))
    rows = rows.select("doc_id", "line", F.concat(F.lit(" "), "line", F.lit(" ")).alias("spaced"))
    some = F.lit(False)
    for phrase in phrases:
        some = some | F.contains(F.col("spaced"), F.lit(f" {phrase} "))
    # the prefix filter once for the whole text: no rare word, no template
    maybe = F.rlike("spaced", F.lit(" (?:" + "|".join(re.escape(w) for w in rare) + ") ")) if rare else F.lit(rare is None)
    words = F.when(F.col("line") != "", F.split("line", " ")).otherwise(F.array().cast("array<string>"))
    rows = rows.select("doc_id", "line", some.alias("some"), maybe.alias("maybe"), "spaced").withColumn("words", F.when(F.col("some") | F.col("maybe"), words))

    def places(phrase: str) -> Column:
        """Where the phrase's words stand one after the other."""
        own = phrase.split(" ")

        def here(i: Column) -> Column:
            same = F.get("words", i) == own[0]
            for k, w in enumerate(own[1:], 1):
                same = same & (F.get("words", i + k) == w)
            return same

        return F.when(F.contains("spaced", F.lit(f" {phrase} ")), F.filter(F.sequence(F.lit(0), F.size("words") - len(own)), here)).otherwise(F.array().cast("array<int>"))

    more = (size["width"] or 1) - 1
    cut = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(segment)),
        lambda at: F.struct(at.cast("long").alias("base"), F.slice("words", at + 1, F.lit(segment + more)).alias("words")),
    )
    if rare:
        cut = F.filter(cut, lambda x: F.arrays_overlap(literal(rare), x["words"]))
    rows = rows.select(
        "doc_id",
        word_count(F.col("line")).alias("n_words"),
        F.array(*[F.struct(F.lit(label).alias("label"), places(p).alias("at")) for p, label in phrases.items()]).cast("array<struct<label:string,at:array<int>>>").alias("found"),
        F.when(F.col("maybe"), cut).alias("segments"),
    )
    # numbers given once: they stand in the table that is written here
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "license-rows")
    segments = rows.filter(F.size("segments") > 0).select("row", F.explode("segments").alias("s")).select("row", "s.base", "s.words")
    blocks = block_matches(segments, F.broadcast(index) if bounded else index, rare, segment)
    at = F.flatten("found.at")
    rows = rows.select("row", "doc_id", "n_words", F.size(at).cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
                       F.array_sort(F.array_distinct(F.filter("found", lambda x: F.size(x["at"]) > 0)["label"])).alias("base_labels"))
    rows = rows.join(blocks, "row", "left")
    return rows.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        "base_labels",
        F.array_sort(F.array_distinct(F.concat("base_labels", F.coalesce("blocks.label", F.array().cast("array<string>"))))).alias("labels"),
        F.greatest(F.coalesce(F.array_max("blocks.share"), F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
        F.coalesce("blocks", F.array().cast("array<struct<label:string,start:bigint,share:double>>")).alias("blocks"),
    )


def _values(templates: dict[str, str]) -> str:
    split = {label: split_words(text) for label, text in templates.items()}
    return ", ".join(f"('{label}', {sorted(set(w))!r}, {block_length(len(w))})" for label, w in split.items())


#: Oracle of op10_license_scan: words and phrase places by lists, every window of a template's width by set intersection.
OP10_SQL = rf"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '{BETWEEN}'), lambda x: x <> '') AS w FROM documents
), p(phrase, label) AS (
  VALUES {', '.join(f"({p.split(' ')!r}, '{label}')" for p, label in PHRASES.items())}
), starts AS (
  SELECT doc_id, label, i - 1 AS i
  FROM (SELECT doc_id, w, label, phrase, unnest(range(1, len(w) - len(phrase) + 2)) AS i FROM d, p WHERE len(w) >= len(phrase))
  WHERE w[i:i + len(phrase) - 1] = phrase
), base AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS ls FROM starts GROUP BY doc_id
), t(label, words, width) AS (
  VALUES {_values(TEMPLATES)}
), windows AS (
  SELECT doc_id, label, words, list_distinct(w[i:i + width - 1]) AS b
  FROM (SELECT doc_id, w, label, words, width, unnest(range(1, len(w) + 1)) AS i FROM d, t WHERE len(list_intersect(list_distinct(w), words)) >= ceil({CONTAINMENT}::DOUBLE * len(words) - 1e-9))
), hits AS (
  SELECT doc_id, label, len(list_intersect(b, words)) / len(words)::DOUBLE AS share FROM windows
  WHERE len(list_intersect(b, words)) >= ceil({CONTAINMENT}::DOUBLE * len(words) - 1e-9)
), own AS (
  SELECT doc_id, list(DISTINCT label) AS ls, max(share) AS share FROM hits GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base.ls), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(own.ls, [])))), ','), '') AS labels,
  greatest(coalesce(own.share, 0), CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id)
"""
