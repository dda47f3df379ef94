"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame operations alone.

For a template of n words, blocks are 2 n consecutive words of a text, one from every n-th word on and across line ends,
so every stretch of n words lies inside a block. A block meets a template if it holds at least ``threshold`` of the
template's distinct tokens. Tokens are ordered from the rarest to the
most frequent over the whole corpus. A block that meets the threshold holds one of the first |T| - c + 1 tokens of the
template (c: tokens that must be shared), has at least c tokens, and from its first shared prefix token on both sides
still have c tokens to share. Only blocks around prefix tokens are formed; what passes the filters is verified, and every
block that meets a template counts. Labels that rest only on blocks without the words that tell the license apart are named
beside the others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegrid.llm._tables import apart

THRESHOLD = 0.8

#: Phrases whose words stand consecutively, and the label of each.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Templates of license statements: label, text, and the words without which it may be another license's.
TEMPLATES = (
    ("apache-2", "Licensed under the Apache License, Version 2.0", "apache"),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted", "redistribution"),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "endorse"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc nc"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", "cc sa"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3", "gnu general 3"),
    ("isc", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted", "fee granted"),
    ("mit", "Released under the MIT License", "mit"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "granted charge obtaining"),
    ("mpl-2", "Subject to the terms of the Mozilla Public License, version 2.0", "mozilla"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered"),
)

#: Names of columns that are no one else's.
_OWN = ("__text", "__row", "__size", "__words", "__low", "__base", "__met", "__sure", "__score")

_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced(text: Column) -> Column:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (once A-Z are lower-cased) with one space around each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, _GAPS, " ")), F.lit(" "))


def lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _spaces(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def template_tokens(templates=TEMPLATES) -> list[tuple[str, list[str], int, list[str]]]:
    """Label, distinct tokens, number of words and distinguishing tokens of each template."""
    out = []
    for label, text, marks in templates:
        words = "".join(c if ord(c) > 127 or c.isalnum() else " " for c in text.translate(str.maketrans(_UPPER, _LOWER))).split()
        out.append((label, list(dict.fromkeys(words)), len(words), marks.split()))
    return out


def scan_licenses(docs: DataFrame, keep: list[str], templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep`` of ``docs`` (doc_id, text: string) with n_words, n_base, first_word, last_word, base_labels,
    labels, doubtful_labels and score.

    n_base counts the places where a phrase's words stand consecutively, first_word and last_word are the smallest and
    largest start (null if none), base_labels their labels; labels adds those of templates that a block meets,
    doubtful_labels are those of them that no phrase and no block with the template's telling words has; score is 1 with a phrase, else the largest share of a template's tokens in a block that meets it, else 0. A null text is
    empty. Repeated rows are scanned alike. Clashing names: the added columns win.
    """
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "doubtful_labels", "score"]
    docs, keep, back = apart(docs, [c for c in keep if c not in added], _OWN)
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text"), F.xxhash64("doc_id", "text").alias("__row"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("__size"))

    found = rows.select(*keep, "__row", "__size", spaced(F.col("__text")).alias("__words"))
    any_phrase = "(?i) (?:" + "|".join(p for p, _ in phrases) + ") "
    found = found.withColumn("__low", F.when(F.col("__words").rlike(any_phrase), lowered(F.col("__words"))))
    n_words = F.when(F.octet_length("__words") <= 2, F.lit(0)).otherwise(_spaces(F.col("__words")) - 1).cast("long")
    count, first, last, labels = [], [], [], []
    for phrase, label in phrases:
        low, mark = F.col("__low"), f" {phrase} "
        here = low.contains(mark)
        count.append(F.coalesce(F.regexp_count(low, F.lit(f" {phrase}(?= )")), F.lit(0)))
        first.append(F.when(here, _spaces(F.substring_index(low, mark, 1))))
        last.append(F.when(here, n_words - _spaces(F.substring_index(low, mark, -1)) - len(phrase.split())))
        labels.append(F.when(here, F.lit(label)))
    base = found.select(
        *keep, "__row", "__size", n_words.alias("n_words"), sum(count[1:], count[0]).cast("long").alias("n_base"), F.least(*first).cast("long").alias("first_word"),
        F.greatest(*last).cast("long").alias("last_word"), F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("__base"),
    )

    met = _met(rows.select("__row", "__size", "__text"), template_tokens(templates), threshold)
    both = base.join(met, ["__row", "__size"], "left")
    none = F.array().cast("array<string>")
    every = F.array_sort(F.array_union("__base", F.coalesce("__met", none)))
    doubtful = F.array_except(F.array_except(F.coalesce("__met", none), F.coalesce("__sure", none)), "__base")
    score = F.when(F.size("__base") > 0, F.lit(1.0)).otherwise(F.coalesce("__score", F.lit(0.0)))
    return both.select(*keep, "n_words", "n_base", "first_word", "last_word", F.array_join("__base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), F.array_join(doubtful, ",").alias("doubtful_labels"), score.alias("score")).withColumnsRenamed(back)


def _met(rows: DataFrame, templates: list[tuple[str, list[str], int, list[str]]], threshold: float) -> DataFrame:
    """(__row, __size, __met: labels, __sure: those that blocks with all telling words have, __score) of rows with a block that meets a template."""
    spark = rows.sparkSession
    vocabulary = sorted({t for _, tokens, *_ in templates for t in tokens})
    words = rows.select(F.explode(F.split(F.trim(lowered(F.regexp_replace("__text", _GAPS, " "))), " ")).alias("token"))
    counts = dict(tuple(r) for r in words.where(F.col("token").isin(vocabulary)).groupBy("token").count().collect())  # a row for each template token
    ranks = {t: i for i, t in enumerate(sorted(vocabulary, key=lambda t: (counts.get(t, 0), t)))}
    rank_of = F.create_map(*(F.lit(x) for t, r in ranks.items() for x in (t, r)))
    shapes, prefixes = [], []
    for n, (label, tokens, length, marks) in enumerate(templates):
        need = math.ceil(threshold * len(tokens) - 1e-9)
        order = sorted(ranks[t] for t in tokens)
        prefixes.append((length, order[: len(order) - need + 1]))
        shapes.append((n, label, len(order), need, order, order[: len(order) - need + 1], sorted(ranks[t] for t in marks)))
    rare = {r for _, prefix in prefixes for r in prefix}
    any_rare = "|".join(t for t in vocabulary if ranks[t] in rare)
    holds = F.col("__text").rlike(f"(?i)(?<![A-Za-z0-9\\x{{80}}-\\x{{10FFFF}}])(?:{any_rare})(?![A-Za-z0-9\\x{{80}}-\\x{{10FFFF}}])")
    ranked = F.transform(F.split(F.trim(lowered(F.regexp_replace("__text", _GAPS, " "))), " "), lambda w: F.coalesce(rank_of[w], F.lit(-1)))
    texts = rows.where(holds).select("__row", "__size", ranked.alias("ranks"))
    here = F.filter(F.transform("ranks", lambda r, i: F.struct(r.alias("rank"), i.alias("place"))), lambda h: h["rank"].isin(sorted(rare)))
    texts = texts.select("__row", "__size", "ranks", here.alias("here"))

    def blocks(n: int, length: int, prefix: list[int]) -> Column:
        """The blocks around the template's prefix tokens, each with its distinct tokens of the vocabulary."""
        found = F.filter("here", lambda h: h["rank"].isin(prefix))
        number = F.array_distinct(F.flatten(F.transform(found, lambda h: F.array(F.floor(h["place"] / length), F.greatest(F.floor(h["place"] / length) - 1, F.lit(0))))))
        of = lambda b: F.array_sort(F.array_distinct(F.filter(F.slice("ranks", (b * length + 1).cast("int"), F.lit(2 * length)), lambda r: r >= 0)))
        return F.transform(number, lambda b: F.struct(F.lit(n).alias("template"), of(b).alias("held")))

    every = F.flatten(F.array(*(blocks(n, length, prefix) for n, (length, prefix) in enumerate(prefixes))))
    shape = spark.createDataFrame(shapes, "template int, label string, size int, need int, wanted array<int>, prefix array<int>, marks array<int>")
    pairs = texts.select("__row", "__size", F.explode(every).alias("b")).select("__row", "__size", "b.*").join(F.broadcast(shape), "template")  # a row for each template
    first = F.array_min(F.array_intersect("held", "prefix"))
    left = F.least(F.col("size") - F.array_position("wanted", first) + 1, F.size("held") - F.array_position("held", first) + 1)
    fit = pairs.where((F.size("held") >= F.col("need")) & (left >= F.col("need")))
    shared = F.size(F.array_intersect("held", "wanted"))
    met = fit.where(shared >= F.col("need")).withColumn("share", shared / F.col("size"))
    sure = F.when(F.size(F.array_except("marks", "held")) == 0, F.col("label"))
    return met.groupBy("__row", "__size").agg(F.array_sort(F.collect_set("label")).alias("__met"), F.collect_set(sure).alias("__sure"), F.max("share").alias("__score"))
