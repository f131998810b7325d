"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license templates.

DataFrame functions only. A block is a line, or for long templates a paragraph; its set is its distinct words. A
template is found where a block holds at least the threshold's share of its distinct words. Tokens are ordered by their frequency over
all documents, rarest first; a block and a template that meet the threshold share a token within both prefixes, so
only those meet in the join. Lengths and the places of the first shared token drop more pairs, and the overlap of
the rest is counted in full.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonolake.llm.common import key_columns, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between words, once A-Z are lower case; the raw text has A-Z as word characters too.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
RAW_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

#: The phrases of the base scan and their labels.
PHRASES = {"the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Well-known passages of public license texts.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"),
    ("mit", "Released under the MIT License."),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC"),
    ("gpl", "This work is licensed under the GNU General Public License"),
]
#: Templates are literals of the plan and one broadcast table; this bounds both.
MOST_TOKENS = 100_000
#: A template of fewer words must occur whole.
SHORT = 8
#: A template of at least so many words is looked for in paragraphs, others in lines.
LONG = 20


def template_sets(templates: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    """Label and distinct words of each template, in the order of the text."""
    import re

    lowered = [(label, text.translate(str.maketrans(UPPER, LOWER))) for label, text in templates]
    out = [(label, list(dict.fromkeys(w for w in re.split(f"{GAP}+", text) if w))) for label, text in lowered]
    if sum(len(words) for _, words in out) > MOST_TOKENS:
        raise ValueError(f"more than {MOST_TOKENS} template tokens")
    return out


def needed(words: list[str], threshold: float) -> int:
    return len(words) if len(words) < SHORT else max(1, math.ceil(threshold * len(words) - 1e-9))


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{RAW_WORD}+")).cast("long")


def phrase_patterns(phrases: dict[str, str]) -> dict[str, str]:
    return {p: f"(?<!{RAW_WORD})" + f"{RAW_GAP}+".join(p.split()) + f"(?!{RAW_WORD})" for p in phrases}


def has_phrase(text: Column, phrases: dict[str, str]) -> Column:
    """Whether a phrase stands in the text; the pattern is tried only where all words of one occur somewhere."""
    if not phrases:
        return F.lit(False)
    low = F.lower(text)
    possible = reduce(or_, [reduce(and_, [F.contains(low, F.lit(w)) for w in sorted(set(p.split()), key=len, reverse=True)]) for p in phrases])
    return F.when(possible, text.rlike("(?i)" + "|".join(phrase_patterns(phrases).values()))).otherwise(F.lit(False))


def phrase_places(text: Column, found: Column, phrases: dict[str, str]) -> dict[str, Column]:
    """Columns of the base scan, given whether there is a phrase. Phrases must not overlap; case of A-Z does not matter."""
    patterns = phrase_patterns(phrases)
    any_phrase = "(?i)" + "|".join(patterns.values())
    parts = F.split(text, any_phrase, -1)
    last_match = F.element_at(F.regexp_extract_all(text, F.lit(f"({any_phrase})"), F.lit(1)), -1)
    words = count_words(text)
    labels = [F.when(text.rlike("(?i)" + "|".join(patterns[p] for p in phrases if phrases[p] == label)), F.lit(label)) for label in sorted(set(phrases.values()))]
    return {
        "n_words": words,
        "n_base": F.when(found, F.size(parts) - 1).otherwise(0).cast("long"),
        "first_word": F.when(found, count_words(F.element_at(parts, 1))),
        "last_word": F.when(found, words - count_words(F.element_at(parts, -1)) - count_words(last_match)),
        "base_labels": F.when(found, F.concat_ws(",", *labels)).otherwise(F.lit("")),
    }


def blocks(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """Key, kind (1: paragraph) and number of each block, and the template tokens among its words; none without any."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    cut = [F.struct(F.lit(kind).alias("kind"), F.split(text, mark).alias("bodies")) for kind, mark in enumerate((r"\n", r"\n\s*\n"))]
    rows = docs.select(*key_columns(id_col, text_col), F.explode(F.array(*cut)).alias("cut"))
    rows = rows.select("key_id", "key_hash", "cut.kind", F.posexplode("cut.bodies").alias("block", "body"))
    words = F.split(F.col("body"), f"{GAP}+")
    known = F.array(*[F.lit(w) for w in vocabulary])
    return rows.select("key_id", "key_hash", "kind", "block", F.array_intersect(words, known).alias("tokens")).where(F.size("tokens") > 0)


def template_matches(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key_id, key_hash, block, template, label and containment of every block that meets the threshold.

    Exact: every pair of a block and a template with that share of the template's distinct words is returned, once
    for each key. A template of fewer than ``SHORT`` words must occur whole; one of ``LONG`` words or more is looked
    for in paragraphs, others in lines. Runs jobs: the template tokens of each block are written to the checkpoint
    folder, and their counts over all documents (one row for each template token) are collected.
    """
    sets = template_sets(TEMPLATES if templates is None else templates)
    vocabulary = sorted({w for _, words in sets for w in words})
    schema = "key_id long, key_hash long, block int, template int, label string, containment double"
    if not vocabulary:
        return docs.sparkSession.createDataFrame([], schema)
    found = stored(blocks(docs, vocabulary, id_col, text_col), "blocks")
    frequency = {r.token: r.n for r in found.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    prefix, whole = [], []
    for number, (label, words) in enumerate(sets):
        ordered, need = sorted(rank[w] for w in words), needed(words, threshold)
        kind = int(len(words) >= LONG)
        prefix += [(token, kind, number, place, len(ordered), need) for place, token in enumerate(ordered[: len(ordered) - need + 1])]
        whole.append((number, label, ordered, len(ordered), need))
    spark = docs.sparkSession
    index = F.broadcast(spark.createDataFrame(prefix, "token int, kind int, template int, place int, size int, need int"))
    full = F.broadcast(spark.createDataFrame(whole, "template int, label string, ordered array<int>, size int, need int"))
    ranks = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    own = found.withColumn("own", F.array_sort(F.transform("tokens", lambda t: ranks[t])))
    least = min(need for *_, need in whole)
    own = own.where(F.size("own") >= least).select("key_id", "key_hash", "kind", "block", "own")
    # prefix and length filters; a pair may meet in several tokens, the first of which the positional filter looks at
    met = own.select("*", F.posexplode("own").alias("at", "token")).join(index, ["token", "kind"]).where((F.size("own") >= F.col("need")) & (F.col("at") <= F.size("own") - F.col("need")))
    # what may still be shared before and after this token
    met = met.where(F.least(F.col("size") - F.col("place"), F.size("own") - F.col("at")) + F.least("place", "at") >= F.col("need"))
    pairs = met.select("key_id", "key_hash", "block", "own", "template").join(full, "template")
    shared = F.size(F.array_intersect("own", "ordered"))
    pairs = pairs.withColumn("shared", shared).where(F.col("shared") >= F.col("need"))
    return pairs.select("key_id", "key_hash", "block", "template", "label", (F.col("shared") / F.col("size")).alias("containment")).distinct()


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts the places of the phrases, ``first_word`` and ``last_word`` are their smallest and largest
    start (words from 0, null without any), ``labels`` adds the labels of matched templates, ``score`` is 1 with a
    phrase, else the largest containment, else 0. Null and empty texts have no words; null or repeated ids keep
    their rows.
    """
    phrases = PHRASES if phrases is None else phrases
    rows = docs.select(*key_columns(id_col, text_col), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    rows = rows.withColumn("has_phrase", has_phrase(F.col("body"), phrases))
    places = phrase_places(F.col("body"), F.col("has_phrase"), phrases)
    base = rows.select("key_id", "key_hash", "doc_id", *[c.alias(n) for n, c in places.items()])
    found = template_matches(docs, templates, threshold, id_col, text_col).groupBy(F.col("key_id").alias("_id"), F.col("key_hash").alias("_hash")).agg(F.collect_set("label").alias("found"), F.max("containment").alias("most"))
    out = base.join(found.hint("merge"), (F.col("key_id") == F.col("_id")) & (F.col("key_hash") == F.col("_hash")), "left")
    none = F.array().cast("array<string>")
    base_list = F.when(F.col("base_labels") == "", none).otherwise(F.split("base_labels", ","))
    labels = F.array_join(F.array_sort(F.array_union(base_list, F.coalesce("found", none))), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"))
