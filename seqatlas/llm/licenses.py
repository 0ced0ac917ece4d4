"""License scan: phrases, and an exact set-similarity join of text blocks with license templates.

A block matches a template when it has at least ``threshold`` of the template's distinct words.
Blocks are the lines of a text and, for templates wrapped over several lines, the words around
each line end: as many on either side as the longest template has. A copy of a template crosses no
line end and lies in a line, or crosses one and lies in the words around it. The join finds every such pair without comparing all pairs. Words
that occur in templates are ordered by their document frequency over the whole corpus, rarest
first; a block that reaches the threshold must share one of the template's first (rare) words,
so blocks and templates meet by an equi-join on these (prefix filter), a block with too few
template words is left out (length filter), and so is a meeting after which too few words remain
on either side (positional filter). What is left is verified by the full intersection.

Only DataFrame functions are used. The template table is fixed, so everything sent to the
driver or broadcast (its word frequencies, at most one row for each template word) has a fixed size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from seqatlas.llm.common import WORD_CLASS, stage

# Base phrases and labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Template texts and labels.
TEMPLATES = [
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this is free and unencumbered software released into the public domain", "public-domain"),
    ("copyright all rights reserved", "reserved"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({WORD_CLASS})"), F.lit(1))


def template_words(templates=TEMPLATES) -> list[str]:
    return sorted({w for text, _ in templates for w in text.split()})


def word_order(docs: DataFrame, templates=TEMPLATES) -> list[str]:
    """Template words from rarest to most frequent, by the number of documents that have them."""
    vocabulary = template_words(templates)
    known = F.array(*[F.lit(w) for w in vocabulary])
    found = docs.select(F.explode(F.array_intersect(known, words(F.col("text")))).alias("word"))
    # One row for each template word at most.
    counts = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def needed(size: int, threshold: float) -> int:
    """Words of a template of ``size`` words that a block must have."""
    return max(math.ceil(round(threshold * size, 9)), 1)


def around_line_ends(lines: Column, reach: int) -> Column:
    """For each end of a line with words but the last: the ``reach`` words before it and those after it.

    ``lines`` has the words of each line; fewer words stand at the ends of the text.
    """
    filled = F.filter(lines, lambda x: F.size(x) > 0)
    last = lambda x: F.slice(x, F.greatest(F.size(x) - reach, F.lit(0)) + 1, reach)
    # A line with words has one at least, so ``reach`` lines hold ``reach`` words.
    ends, starts = F.transform(filled, last), F.transform(filled, lambda x: F.slice(x, 1, reach))
    around = lambda i: F.concat(
        last(F.flatten(F.slice(ends, F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach))))),
        F.slice(F.flatten(F.slice(starts, i + 1, reach)), 1, reach),
    )
    none = F.array().cast("array<array<string>>")
    return F.when(F.size(filled) > 1, F.transform(F.sequence(F.lit(1), F.size(filled) - 1), around)).otherwise(none)


def matching_blocks(blocks: DataFrame, order: list[str], threshold: float = 0.8, templates=TEMPLATES) -> DataFrame:
    """All (block, template) with enough words: the columns of ``blocks`` but ``words``, label, template, containment.

    ``blocks`` has an array column ``words``. Blocks without words match nothing.
    """
    rank = {w: i for i, w in enumerate(order)}
    prefixes, whole = [], []
    for number, (text, label) in enumerate(templates):
        own = sorted(set(text.split()), key=rank.__getitem__)
        least = needed(len(own), threshold)
        whole.append((number, label, own, len(own), least))
        prefixes += [(w, number, i, len(own), least) for i, w in enumerate(own[: len(own) - least + 1])]
    spark = blocks.sparkSession
    index = F.broadcast(spark.createDataFrame(prefixes, "_word string, template int, _i int, _size int, _least int"))
    full = F.broadcast(spark.createDataFrame(whole, "template int, label string, _own array<string>, _whole int, _need int"))
    # Template words of the block in the global order: an intersection keeps the order of its first side.
    ordered = F.array(*[F.lit(w) for w in order])
    fewest = min((least for *_, least in whole), default=1)
    relevant = blocks.withColumn("_mine", F.array_intersect(ordered, F.col("words"))).where(F.size("_mine") >= fewest)
    probes = relevant.withColumn("_m", F.size("_mine")).select("*", F.posexplode("_mine").alias("_j", "_word"))
    met = probes.join(index, "_word").where((F.col("_m") >= F.col("_least")) & (1 + F.least(F.col("_size") - F.col("_i"), F.col("_m") - F.col("_j")) - 1 >= F.col("_least")))
    names = [c for c in blocks.columns if c != "words"]
    # A pair may meet at several words; the array of words is the same for all of them.
    pairs = met.select(*names, "template", "_mine").dropDuplicates([*names, "template"])
    common = F.size(F.array_intersect("_own", "_mine"))
    found = pairs.join(full, "template").withColumn("_common", common).where(F.col("_common") >= F.col("_need"))
    return found.select(*names, "template", "label", (F.col("_common") / F.col("_whole")).alias("containment"))


def _starts(words_column: str, n_words: Column, phrase: str) -> Column:
    """Word numbers where a phrase stands."""
    parts = phrase.split()
    here = lambda i: [F.get(F.col(words_column), i.cast("int") + k) == F.lit(w) for k, w in enumerate(parts)]

    def stands(i: Column) -> Column:
        tests = here(i)
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    none = F.array().cast("array<int>")
    possible = (n_words >= len(parts)) & F.arrays_overlap(F.col(words_column), F.array(F.lit(parts[0])))
    return F.when(possible, F.filter(F.sequence(F.lit(0), (n_words - len(parts)).cast("int")), stands)).otherwise(none)


def scan_licenses(docs: DataFrame, threshold: float = 0.8, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """One row per document: phrase places, labels of phrases and of matching blocks, and a score.

    score: the largest containment of a matching block, 1 where a phrase stands, 0 without labels.
    Null texts count as empty: no words, no labels (empty strings), null places. Repeated rows
    give repeated rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = word_order(texts, templates)
    rows = texts.withColumn("_hash", F.xxhash64("text")).withColumn("_words", words(F.col("text"))).withColumn("n_words", F.size("_words").cast("long"))
    names = [f"_p{i}" for i in range(len(phrases))]
    for name, phrase in zip(names, phrases):
        rows = rows.withColumn(name, _starts("_words", F.col("n_words"), phrase))
    places = F.flatten(F.array(*names))
    labels = F.filter(F.array(*[F.when(F.size(n) > 0, F.lit(label)) for n, label in zip(names, phrases.values())]), lambda x: x.isNotNull())
    # A document that has none of the rare words of any template has no matching block.
    rank = {w: i for i, w in enumerate(order)}
    rare = set()
    for text, _ in templates:
        own = sorted(set(text.split()), key=rank.__getitem__)
        rare.update(own[: len(own) - needed(len(own), threshold) + 1])
    lines = F.when(F.arrays_overlap("_words", F.array(*[F.lit(w) for w in sorted(rare)])), F.split("text", "\n"))
    scanned = rows.select(
        "doc_id", "_hash", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"), F.array_sort(F.array_distinct(labels)).alias("_base"), lines.alias("_lines"),
    )
    scanned = stage(scanned, "scanned")
    reach = max((len(text.split()) for text, _ in templates), default=1)
    split = scanned.where("_lines is not null").select("doc_id", "_hash", F.transform("_lines", words).alias("_lines"))
    blocks = split.select("doc_id", "_hash", F.posexplode(F.concat("_lines", around_line_ends(F.col("_lines"), reach))).alias("block", "words"))
    matches = matching_blocks(blocks, order, threshold, templates)
    found = matches.groupBy("doc_id", "_hash").agg(F.collect_set("label").alias("_more"), F.max("containment").alias("_best"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_h"), "_more", "_best")
    joined = scanned.drop("_lines").join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", F.coalesce("_more", none))), ",").alias("labels"),
        F.greatest(F.coalesce("_best", F.lit(0.0)), F.when(F.size("_base") > 0, F.lit(1.0)).otherwise(F.lit(0.0))).alias("score"),
    )


def scan_sql(threshold: float = 0.8, templates=TEMPLATES, phrases=PHRASES) -> str:
    """The same rows in DuckDB SQL, by comparing every line with every template."""
    cls = WORD_CLASS
    w = lambda t: f"regexp_extract_all(translate({t}, '{UPPER}', '{LOWER}'), '{cls}')"
    values = ", ".join(f"({i}, '{label}', {sorted(set(text.split()))!r}, {len(set(text.split()))}, {needed(len(set(text.split())), threshold)})" for i, (text, label) in enumerate(templates))
    tests = []
    for phrase, label in phrases.items():
        parts = phrase.split()
        test = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts))
        tests.append(f"SELECT r, i - 1 AS start, '{label}' AS label FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE {test}")
    return f"""
WITH t(n, label, own, size, least) AS (VALUES {values}),
d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r, {w("coalesce(text, '')")} AS w FROM documents),
p AS ({" UNION ALL ".join(tests)}),
b AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list_sort(list_distinct(list(label))) AS base FROM p GROUP BY r),
l AS (SELECT r, {w("line")} AS w FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)),
m AS (SELECT r, list_distinct(list(label)) AS more, max(common / size) AS best
      FROM (SELECT r, label, size, least, len(list_intersect(own, w)) AS common FROM l, t) WHERE common >= least GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(array_to_string(base, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels,
  greatest(coalesce(CAST(best AS DOUBLE), 0.0), CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END) AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN m USING (r)"""
