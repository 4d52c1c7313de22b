"""License notices in texts, by diagonal voting, with DataFrame operations only.

Texts and templates are cut into words; a template's rolling k-grams of words are a table of (hash of its first two
words, words, template, position). All k-grams of all texts are joined with it by hash and compared word by word. A match at
position p of a text and t of a template is a vote for the diagonal p - t: the votes of a diagonal are the template's
words that stand in the text at one offset. Short templates must stand there whole. In long ones words may be missing or
put in between: neighbouring diagonals are taken together, and the words that they cover are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The phrases and labels that every scan has.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Names of single licenses and of their versions, and the sentences by which notices begin. Label by template.
NOTICES = {
    "apache license version 2 0": "apache-2.0",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu affero general public license": "agpl",
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "cc by 4 0": "cc-by",
    "cc by sa 4 0": "cc-by-sa",
    "cc by nc 4 0": "cc-by-nc",
    "cc by nd 4 0": "cc-by-nd",
    "cc by nc sa 4 0": "cc-by-nc-sa",
    "cc by nc nd 4 0": "cc-by-nc-nd",
    "cc0 1 0": "cc0",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: Words of a k-gram; words from which a template is long; diagonals on either side that a long one's words may be on; the share of its words that must be there.
GRAM, LONG, BAND, SHARE = 3, 12, 3, 0.75
#: Words of all templates together: what is broadcast stays below some megabytes.
MOST = 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN, _WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower(text: str = "text") -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def templates(base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> list[tuple[int, str, bool, list[str]]]:
    """(number, label, base, words) of all templates."""
    found = [(k, label, k < len(base), phrase.split(" ")) for k, (phrase, label) in enumerate([*base.items(), *notices.items()])]
    if any(len(words) < 2 for *_, words in found) or sum(len(words) for *_, words in found) > MOST:
        raise ValueError(f"templates have two words or more, and {MOST} at most together")
    return found


def _grams(spark: SparkSession, of: list[tuple[int, str, bool, list[str]]]) -> DataFrame:
    """A row for each k-gram of each template: shorter templates are one k-gram."""
    rows = []
    for k, label, base, words in of:
        width = min(GRAM, len(words))
        for t in range(len(words) - width + 1):
            rows.append((k, label, base, len(words), t, width, words[t : t + width]))
    d = spark.createDataFrame(rows, "template int, label string, base boolean, size int, t int, width int, gram array<string>")
    return d.withColumn("hash", F.xxhash64(F.col("gram")[0], F.col("gram")[1]))


def votes(documents: DataFrame, of: list[tuple[int, str, bool, list[str]]]) -> DataFrame:
    """A row for each text, template and diagonal: the template's words that are covered, where they begin and end in the text.

    `copy` tells texts of one doc_id apart; equal rows are one here.
    """
    words = documents.select("doc_id", F.xxhash64("text").alias("copy"), F.array_remove(F.split(_lower(), _BETWEEN), "").alias("w"))
    zipped = F.arrays_zip(*(F.slice("w", 1 + i, F.greatest(F.size("w") - i, F.lit(0))).alias(f"w{i}") if i else F.col("w").alias("w0") for i in range(GRAM)))
    grams = words.select("doc_id", "copy", F.posexplode(zipped).alias("p", "g")).select("doc_id", "copy", "p", *(f"g.w{i}" for i in range(GRAM)))
    table = F.broadcast(_grams(documents.sparkSession, of))
    same = F.xxhash64("w0", "w1") == F.col("hash")
    for i in range(GRAM):
        same = same & ((F.col("width") <= i) | (F.col(f"w{i}") == F.get("gram", F.lit(i))))
    met = grams.join(table, same).select("doc_id", "copy", "template", "label", "base", "size", (F.col("p") - F.col("t")).alias("diagonal"), "p", "t", "width")
    met = met.groupBy("doc_id", "copy", "template", "label", "base", "size", "diagonal").agg(F.min("p").alias("begin"), F.max(F.col("p") + F.col("width")).alias("end"), F.collect_set(F.struct("t", "width")).alias("met"))
    return met.withColumn("covered", F.array_distinct(F.flatten(F.transform("met", lambda m: F.sequence(m["t"], m["t"] + m["width"] - 1))))).drop("met")


def license_spans(documents: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """Rows (doc_id, copy, template, label, base, start, end, share, found): where a template's words stand, which share of them, and whether that is enough.

    Of neighbouring diagonals of a long template the one with most words stands for all, of equals the first.
    """
    d = votes(documents, templates(base, notices))
    short = d.where(F.col("size") < LONG).select("*", F.size("covered").alias("own"), F.size("covered").alias("words"))
    by = Window.partitionBy("doc_id", "copy", "template").orderBy("diagonal")
    near = by.rangeBetween(-BAND, BAND)
    long = d.where(F.col("size") >= LONG).withColumn("own", F.size("covered"))
    long = long.select(
        *(c for c in long.columns if c not in ("begin", "end")), F.min("begin").over(near).alias("begin"), F.max("end").over(near).alias("end"),
        F.size(F.array_distinct(F.flatten(F.collect_list("covered").over(near)))).alias("words"), F.max(F.struct("own", -F.col("diagonal"))).over(near).alias("_top"),
    ).where(F.col("_top") == F.struct("own", -F.col("diagonal"))).drop("_top")
    share = F.col("words") / F.col("size")
    found = F.when(F.col("size") < LONG, F.col("words") == F.col("size")).otherwise(share >= SHARE)
    return short.unionByName(long).select("doc_id", "copy", "template", "label", "base", F.col("begin").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), share.alias("share"), found.alias("found"))


def license_scan(documents: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """A row for each row of documents: n_words, places of base phrases (n_base, first_word, last_word), base_labels, labels, and as score the largest share of a template's words that stand together.

    A null or empty text has no words: no places, no labels (empty strings), score 0. Repeated rows are rows of their
    own, and a null doc_id is like any other. Columns besides doc_id and text are ignored.
    """
    spans = license_spans(documents, base, notices)
    hit = F.col("base") & F.col("found")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    found = spans.groupBy(F.col("doc_id").alias("_doc"), F.col("copy").alias("_copy")).agg(
        F.count(F.when(hit, 1)).alias("n_base"), F.min(F.when(hit, F.col("start"))).alias("first_word"), F.max(F.when(hit, F.col("start"))).alias("last_word"),
        joined(hit).alias("base_labels"), joined(F.col("found")).alias("labels"), F.max("share").alias("score"),
    )
    every = documents.select("doc_id", F.xxhash64("text").alias("copy"), F.regexp_count(_lower(), F.lit(_WORD)).cast("bigint").alias("n_words"))
    out = every.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("copy") == F.col("_copy")), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("bigint")).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


_VALUES = ", ".join(f"({k}, '{label}', {base}, string_split('{' '.join(words)}', ' '))" for k, label, base, words in templates())
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
texts AS (SELECT r, unnest(range(0, len(w))) AS p, unnest(list_transform(range(1, len(w) + 1), lambda i: concat_ws(' ', w[i], w[i + 1]))) AS two, unnest(list_transform(range(1, len(w) + 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))) AS three FROM d),
tem AS (SELECT * FROM (VALUES {_VALUES}) AS v(template, label, base, tw)),
grams AS (SELECT template, label, base, len(tw) AS size, i AS t, least({GRAM}, len(tw)) AS width, array_to_string(tw[i + 1 : i + least({GRAM}, len(tw))], ' ') AS gram FROM (SELECT *, unnest(range(0, len(tw) - least({GRAM}, len(tw)) + 1)) AS i FROM tem)),
met AS (SELECT r, template, label, base, size, p, t, width FROM texts JOIN grams ON three = gram AND width = 3 UNION ALL SELECT r, template, label, base, size, p, t, width FROM texts JOIN grams ON two = gram AND width = 2),
covered AS (SELECT r, template, label, base, size, p - t AS diagonal, min(p) AS start, list_distinct(flatten(list(range(t, t + width)))) AS words FROM met GROUP BY r, template, label, base, size, p - t),
spans AS (SELECT r, label, base, start, len(words) / size AS share, len(words) = size AS found FROM covered WHERE size < {LONG}
    UNION ALL SELECT a.r, a.label, a.base, min(b.start), len(list_distinct(flatten(list(b.words)))) / a.size, len(list_distinct(flatten(list(b.words)))) / a.size >= {SHARE}
        FROM covered a JOIN covered b ON a.r = b.r AND a.template = b.template AND b.diagonal BETWEEN a.diagonal - {BAND} AND a.diagonal + {BAND} WHERE a.size >= {LONG}
        GROUP BY a.r, a.template, a.label, a.base, a.size, a.diagonal, a.words HAVING bool_and(len(b.words) < len(a.words) OR len(b.words) = len(a.words) AND b.diagonal >= a.diagonal)),
found AS (SELECT r, count(*) FILTER (WHERE base AND found) AS n_base, min(start) FILTER (WHERE base AND found) AS first_word, max(start) FILTER (WHERE base AND found) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base AND found) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE found) AS labels, max(share) AS score FROM spans GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN found USING (r)
"""
