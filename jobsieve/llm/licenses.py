"""License scans: set-similarity join of text blocks with license templates.

Blocks are lines and, as sentences wrap, all runs of words across lines that are WINDOW times as long as
a template.  Only the runs around a template's rarest words are looked at.  A template is found in a block when the
block holds at least CONTAINED percent of the template's distinct words, and all of its telling words.  All words of the templates are put in order of their frequency in the corpus,
rarest first.  A block that holds enough of a template must hold one of the template's first
|T| - needed + 1 words (prefix filter), have at least as many words as needed (length filter), and
have enough words left behind the first common one (positional filter).  What passes is verified.
Templates are a fixed table, so their index is broadcast; no pair of blocks is ever made.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from jobsieve.llm.common import WORD, ascii_lower, stored

CONTAINED = 80  # percent of a template's distinct words
WINDOW = 1.5  # words of a run across lines, for each word of the template

# Phrases whose places are counted, with their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# License sentences, with the label of each and the words that tell it from the others.
TEMPLATES = (
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu", "3")),
    ("gpl-2.0", "This program is free software; you can redistribute it under the GNU General Public License, version 2.", ("gnu", "2")),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License.", ("gnu", "lesser")),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache", "2")),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", ("cc", "by", "nc")),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative", "commons", "attribution")),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0.", ("cc", "by", "sa")),
    ("mit", "Released under the MIT License.", ("mit", "license")),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.", ("permission", "granted", "copy")),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted.", ("redistribution", "permitted")),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla", "2")),
    ("unlicense", "This is free and unencumbered software released into the public domain.", ("unencumbered",)),
)

_IN_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # in any text


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(1))


def template_words(text: str) -> list[str]:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return list(dict.fromkeys(re.findall(WORD, lowered)))


def window(text: str) -> int:
    return math.ceil(WINDOW * len(re.findall(WORD, text.lower())))


def needed(size: int) -> int:
    return math.ceil(size * CONTAINED / 100)


def _holds(words: list[str]) -> str:
    """A pattern for texts that hold one of the words, in any case of A-Z."""
    return f"(?i)(?<!{_IN_WORD})(?:{'|'.join(sorted(words))})(?!{_IN_WORD})"


def _places(phrase: str) -> str:
    """Where the phrase's words stand consecutively in the array ``words``."""
    parts = phrase.split(" ")
    same = " and ".join(f"element_at(words, i + {k + 1}) = '{w}'" for k, w in enumerate(parts))
    last = f"size(words) - {len(parts)}"
    return f"if({last} < 0, array(), filter(sequence(0, greatest({last}, 0)), i -> {same}))"


def _order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' words, rarest in the corpus first; ties by the word."""
    own = F.array_intersect(_words(ascii_lower(F.col("text"))), F.lit(vocabulary))
    held = docs.where(F.col("text").rlike(_holds(vocabulary))).select(F.explode(own).alias("word"))
    found = {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}  # one row per template word
    return sorted(vocabulary, key=lambda w: (found.get(w, 0), w))


def scan_licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    Words are of the text with A-Z lower-cased.  n_base counts all places of the BASE phrases, which may
    span lines; first_word and last_word are the least and greatest start of one, else null.  labels adds
    the labels of the templates that a line, or WINDOW times the template's words in a row across lines, holds to
    CONTAINED percent, the telling words included.  score is the greatest containment found, 1 where a base phrase stands, else 0.

    Rows without id and repeated rows are scanned like any other.  A null text is empty: no words, no
    labels, score 0.  Lines without words match nothing.  Extra columns are ignored.  An empty table
    gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sets = [(label, template_words(text), window(text), list(telling)) for label, text, telling in templates]
    widest = max((width for _, _, width, _ in sets), default=1)
    order = _order(docs, sorted({w for _, words, _, _ in sets for w in words}))
    rank = {w: k for k, w in enumerate(order)}
    index = []
    for number, (label, words, width, telling) in enumerate(sets):
        least = needed(len(words))
        for place, word in enumerate(sorted(words, key=rank.get)[: len(words) - least + 1]):
            index.append((word, number, label, sorted(words, key=rank.get), place, least, width, telling))
    prefix = sorted({row[0] for row in index})
    base_words = sorted({phrase.split(" ")[0] for phrase in BASE})

    lowered = ascii_lower(F.col("text"))
    scanned = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        F.size(F.regexp_extract_all("text", F.lit(f"({_IN_WORD}+)"), F.lit(1))).cast("long").alias("n_words"),
        F.when(F.col("text").rlike(_holds(base_words)), _words(lowered)).otherwise(F.array().cast("array<string>")).alias("words"),
        F.when(F.col("text").rlike(_holds(prefix)), F.filter(F.split("text", "\n"), lambda b: b.rlike(_holds(prefix)))).alias("blocks"),
        F.when(F.col("text").contains("\n") & F.col("text").rlike(_holds(prefix)), _words(lowered)).alias("all_words"),
    )
    rare = ", ".join(f"'{w}'" for w in prefix)
    around = f"struct(element_at(all_words, i) as word, least(i, {widest}) as at, slice(all_words, greatest(i - {widest - 1}, 1), least(i, {widest}) + {widest - 1}) as words)"
    rare_at = f"filter(sequence(1, greatest(size(all_words), 1)), i -> get(all_words, i - 1) in ({rare}))"
    scanned = scanned.withColumn("runs", F.expr(f"if(all_words is null, null, transform({rare_at}, i -> {around}))"))
    for k, phrase in enumerate(BASE):
        scanned = scanned.withColumn(f"at{k}", F.expr(_places(phrase)))
    named = [F.when(F.size(f"at{k}") > 0, F.lit(label)) for k, label in enumerate(BASE.values())]
    starts = F.concat(*[F.col(f"at{k}") for k in range(len(BASE))])
    scanned = stored(
        scanned.select(
            "row", "doc_id", "n_words", "blocks", "runs", F.size(starts).cast("long").alias("n_base"),
            F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
            F.array_compact(F.array(*named)).alias("base"),
        ),
        "licenses",
    )

    vocabulary = F.lit(order)  # array_intersect keeps the order of its first argument: rarest first
    blocks = (
        scanned.where("blocks is not null").select("row", F.posexplode("blocks").alias("block", "line"))
        .withColumn("line_words", F.array_distinct(_words(ascii_lower(F.col("line")))))
        .select("row", "block", F.size("line_words").alias("n"), F.array_intersect(vocabulary, "line_words").alias("known"))
    )
    schema = "word string, template int, label string, words array<string>, place int, least int, width int, telling array<string>"
    lookup = docs.sparkSession.createDataFrame(index, schema)
    candidates = (
        blocks.select("row", "block", "n", "known", F.posexplode("known").alias("own_place", "word"))
        .join(F.broadcast(lookup), "word")  # the fixed templates
        .where(F.col("n") >= F.col("least"))
        .where(1 + F.least(F.size("words") - F.col("place") - 1, F.size("known") - F.col("own_place") - 1) >= F.col("least"))
    )
    held = F.size(F.array_intersect("words", "known"))
    told = F.size(F.array_except("telling", "known")) == 0
    in_lines = candidates.where((held >= F.col("least")) & told).select("row", "label", (held / F.size("words")).alias("held"))
    runs = scanned.where("runs is not null").select("row", F.explode("runs").alias("run")).selectExpr("row", "run.word", "run.at", "run.words as own")
    starts = "sequence(greatest(at - width + 1, 1), at)"  # of the runs that hold the rare word
    across = (
        runs.join(F.broadcast(lookup), "word")  # the fixed templates
        .where(F.size(F.array_intersect("words", "own")) >= F.col("least")).where(F.size(F.array_except("telling", "own")) == 0)
        .withColumn("most", F.expr(
            f"array_max(transform(transform({starts}, s -> slice(own, s, width)), r -> "
            "if(size(array_except(telling, r)) = 0, size(array_intersect(words, r)), 0)))"
        ))
        .where("most >= least").select("row", "label", (F.col("most") / F.size("words")).alias("held"))
    )
    found = (
        in_lines.unionByName(across)
        .groupBy("row").agg(F.collect_set("label").alias("more"), F.max("held").alias("held"))
    )
    none = F.array().cast("array<string>")
    labels = F.sort_array(F.array_union("base", F.coalesce("more", none)))
    return scanned.join(found, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.sort_array(F.array_distinct("base")), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("held", F.lit(0.0))).alias("score"),
    )
