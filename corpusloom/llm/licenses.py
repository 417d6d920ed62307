"""Licence scans: sparse TF-IDF cosine of lines, blocks and sentences to templates, and inheritance from licence files.

DataFrame operations only. Cost at scale: one scan of texts for units that can match at all: lines,
blocks of lines, their sentences and what these join by "or", however they are wrapped, and licence
files. A unit is scored where it stands against literal template vectors, so nothing is shuffled for
it and no line that all files have is a key; a row a matching unit goes on. Inheritance joins
directories, of which there are far fewer than files, to their ancestors by path.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Notices as they stand in headers and licence files.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This program is licensed under the GNU Affero General Public License, version 3."],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC0-1.0": ["Released under CC0 1.0, dedicated to the public domain."],
    "All-rights-reserved": ["All rights reserved."],
}
#: A line's words: runs of letters and digits.
WORD = r"[a-z0-9]+"
#: Words without weight.
STOP_WORDS = "a an and any are as at be by do for from in is it may not of on or so that the this to under use via whom with without work you your".split()
THRESHOLD = 0.8  # least cosine of a line and a template
FILE_SHARE = 0.5  # a file is a licence file if so much of its words are in matching lines
#: Lines that aren't comments, and comments without words.
NO_COMMENT = r"(?m)^(?![ \t]*(?:#|//|/?\*|--|;|%|<!--)[^\n]*[A-Za-z0-9]).+$"
#: Sentences that may name several licences, and what is between these.
CHOICE = r"(?is)licen[cs].*(?:\s(?:or|and)\s|/)"
OR = r"(?i)[,;]?\s+(?:and/or|either|or|and)\s+(?:under\s+)?|\s*/\s*"
FILE_NAME = r"(?i)^(un)?licen[cs]e|^copying"


def _words(text: str) -> list[str]:
    return [w for w in re.findall(WORD, text.lower()) if w not in STOP_WORDS]


def template_weights(templates: dict[str, list[str]]) -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """(template, licence, word, weight over the template's length) rows, IDFs, and that of other words."""
    texts = [(name, Counter(_words(t))) for name, notices in sorted(templates.items()) for t in notices]
    seen = Counter(w for _, words in texts for w in words)
    idf = {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in seen.items()}
    rows = []
    for number, (name, words) in enumerate(texts):
        length = math.sqrt(sum((n * idf[w]) ** 2 for w, n in words.items()))
        rows += [(number, name, w, n * idf[w] / length) for w, n in sorted(words.items())]
    return rows, idf, math.log(1 + len(texts)) + 1


def guard_words(rows: list[tuple[int, str, str, float]], threshold: float) -> list[str]:
    """Words of which any line that reaches the threshold has at least one.

    Without them no line can have a cosine of threshold to a template: the weight that is left is
    less. Longer words come first, which are rarer in other texts, then words of many templates.
    """
    uses = Counter(w for _, _, w, _ in rows)
    left = Counter()
    for number, _, _, weight in rows:
        left[number] += weight**2
    chosen: set[str] = set()
    for number in sorted(left):
        own = sorted(((w, x) for n, _, w, x in rows if n == number), key=lambda p: (p[0].isdigit(), len(p[0]) < 4, -uses[p[0]] * p[1], p[0]))
        for word, _ in own:
            if left[number] < threshold**2 - 1e-9:
                break
            if word not in chosen:
                chosen.add(word)
                for n, _, w, x in rows:
                    if w == word:
                        left[n] -= x**2
    return sorted(chosen)


def _unit_column(name: Column, threshold: float, templates: dict[str, list[str]]) -> tuple[Column, Column]:
    """Of a column `text`: (kind, words) of each unit that can match, and the number of words of a text that has such units.

    Units are lines; blocks of lines up to one without letters and digits, of all lines and of those
    in comments alone; sentences of blocks; what such sentences join by "or" or "and"; and the whole text if the file's name is a licence's.
    Comment marks aren't words.
    """
    guard = r"(?i)(?<![a-z0-9])(?:" + "|".join(guard_words(template_weights(templates)[0], threshold)) + r")(?![a-z0-9])"
    text, may = F.col("text"), F.col("text").rlike(guard)

    known = sorted(set(template_weights(templates)[1]) - set(STOP_WORDS))

    def fits(words: Column) -> Column:
        """Without loss: other words, of the greatest weight, may have 1 - threshold ** 2 of a unit's square at most."""
        def count(now: Column, w: Column) -> Column:
            """Squares are summed in one pass over sorted words: n words alike give 1 + 3 + ... + (2 n - 1)."""
            n = F.when(w == now["word"], now["n"] + 1).otherwise(F.lit(1.0))
            return F.struct(w.alias("word"), n.alias("n"), (now["square"] + 2 * n - 1).alias("square"))

        own = F.array_sort(F.filter(words, lambda w: w.isin(known)))
        none = F.struct(F.lit("").alias("word"), F.lit(0.0).alias("n"), F.lit(0.0).alias("square"))
        square = F.aggregate(own, none, count, lambda now: now["square"])
        other = F.size(F.array_distinct(F.filter(words, lambda w: ~w.isin(known + STOP_WORDS))))
        return other * threshold**2 <= (1 - threshold**2) * square + 1e-9

    def units(kind: str, parts: Column) -> Column:
        words = lambda part: F.regexp_extract_all(F.lower(part), F.lit(f"({WORD})"), F.lit(1))
        found = F.filter(F.transform(F.filter(parts, lambda part: part.rlike(guard)), words), fits)
        return F.transform(found, lambda words: F.struct(F.lit(kind).alias("kind"), words.alias("words")))

    plain = F.regexp_replace(text, r"\r\n?", "\n")
    blocks = F.array_distinct(
        F.concat(*[F.split(F.regexp_replace(plain, other, ""), r"\n{2,}") for other in (r"(?m)^[^A-Za-z0-9\n]+$", NO_COMMENT)])
    )
    blocks = F.filter(blocks, lambda part: part.rlike(guard))
    sentences = F.flatten(F.transform(blocks, lambda block: F.split(block, r"(?<=[.:;!?])\s+")))
    choices = F.flatten(F.transform(F.filter(sentences, lambda part: part.rlike(CHOICE)), lambda part: F.split(part, OR)))
    whole = F.when(name.rlike(FILE_NAME), F.array(text)).otherwise(F.array().cast("array<string>"))
    joined = F.array_distinct(F.concat(units("block", F.filter(blocks, lambda block: block.contains("\n"))), units("sentence", sentences), units("choice", choices), units("whole", whole)))
    # Lines stay as often as they are repeated: their words count for the file's share.
    found = F.concat(units("line", F.split(text, r"[\r\n]+")), joined)
    count = F.regexp_count(F.lower("text"), F.lit(WORD))
    return F.when(may, found), F.when(may, count)


def match_units(units: DataFrame, threshold: float, templates: dict[str, list[str]]) -> DataFrame:
    """(file_key, kind, words) -> (file_key, kind, license, cosine, n_words) of each unit that matches a template.

    Words are counted in the row as runs of the sorted array; each has its IDF and its weights in
    all templates from a literal map, so that the sparse vectors' products are one sum in the row.
    """
    rows, idf, other = template_weights(templates)
    number = 1 + max((r[0] for r in rows), default=-1)
    vectors = {w: [0.0] * number for w in idf}
    licences = [""] * number
    for template, name, word, weight in rows:
        vectors[word][template], licences[template] = weight, name
    if not vectors:
        return units.select("file_key", "kind", F.lit("").alias("license"), F.lit(0.0).alias("cosine"), F.size("words").alias("n_words")).where(F.lit(False))
    array = lambda values: f"array({', '.join(values)})"
    table = F.expr("map(" + ", ".join(f"'{w}', named_struct('idf', {idf[w]!r}D, 'weights', {array(f'{x!r}D' for x in v)})" for w, v in sorted(vectors.items())) + ")")
    names = F.expr(array("'" + name.replace("'", "\\'") + "'" for name in licences))

    has_words = F.exists("words", lambda w: ~w.isin(STOP_WORDS))
    sorted_ = units.where(has_words).withColumn("n_words", F.size("words")).withColumn("words", F.array_sort(F.filter("words", lambda w: ~w.isin(STOP_WORDS))))
    at = lambda i: F.get("words", i)
    runs = sorted_.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: (i == 0) | (at(i) != at(i - 1))))
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("words")))
    runs = runs.withColumn("runs", F.zip_with("starts", ends, lambda a, b: F.struct(F.try_element_at(table, at(a)).alias("known"), (b - a).alias("n"))))
    weighed = runs.withColumn("runs", F.transform("runs", lambda r: F.struct((r["n"] * F.coalesce(r["known"]["idf"], F.lit(other))).alias("x"), r["known"]["weights"].alias("weights"))))
    length = F.sqrt(F.aggregate("runs", F.lit(0.0), lambda total, r: total + r["x"] * r["x"]))
    zeros = F.array_repeat(F.lit(0.0), number)
    known = F.filter("runs", lambda r: r["weights"].isNotNull())
    dots = F.aggregate(known, zeros, lambda total, r: F.zip_with(total, r["weights"], lambda t, w: t + r["x"] * w))
    scored = weighed.select("file_key", "kind", "n_words", length.alias("length"), dots.alias("dots"))
    best = F.array_max(F.zip_with("dots", names, lambda dot, name: F.struct(dot.alias("dot"), name.alias("license"))))
    best = F.struct(F.round(best["dot"] / F.col("length"), 6).alias("cosine"), best["license"].alias("license"))
    # A filter on the cosine would be pushed down and work all of it out within its lambdas again.
    return scored.select("file_key", "kind", "n_words", F.inline(F.filter(F.array(best), lambda b: b["cosine"] >= threshold)))


def nearest_ancestors(directories: DataFrame, licensed: DataFrame) -> DataFrame:
    """(directory) and (directory, license) -> directory, its nearest licensed ancestor or itself, that one's license."""
    depth = F.size(F.split("directory", "/"))
    paths = directories.select("directory", F.explode(F.sequence(F.lit(0), depth)).alias("depth")).select(
        "directory", "depth", F.when(F.col("depth") == 0, "").otherwise(F.array_join(F.slice(F.split("directory", "/"), 1, F.greatest(F.col("depth"), F.lit(1))), "/")).alias("ancestor")
    )
    above = licensed.select(F.col("directory").alias("ancestor"), F.col("license").alias("inherited"))
    nearest = F.max_by(F.struct("ancestor", "inherited"), "depth")
    return paths.join(above, "ancestor").groupBy("directory").agg(nearest.alias("near")).select("directory", "near.*")


def license_scan(
    files: DataFrame,
    passed: list[str] | None = None,
    threshold: float = THRESHOLD,
    file_share: float = FILE_SHARE,
    templates: dict[str, list[str]] = TEMPLATES,
) -> DataFrame:
    """The licence of every file (path, text): its own, or that of the nearest directory above with a licence file.

    Returns the columns `passed` (path, if None), license (several: in order, joined by AND; none:
    null), cosine (the best unit's, of an own licence), origin ('header', 'file', 'ancestor' or
    'none') and license_dir. A unit (line, block, sentence, choice or licence file) matches the template of the greatest cosine, of equals the last
    licence by name. A file is a licence file if its name says so or file_share of its words are in
    matching units of a kind. Null and empty texts have no licence of their own; a null path is a file in the
    root. Repeated rows stay; rows with the same path and text count once for their directory. An
    empty table gives no rows; other columns are ignored; a passed column called like one of the
    four others is an error.
    """
    if clash := set(passed or []) & {"license", "cosine", "origin", "license_dir"}:
        raise ValueError(f"passed columns are called like the scan's own: {sorted(clash)}")
    path = F.coalesce(F.col("path"), F.lit(""))
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    units, words = _unit_column(name, threshold, templates)
    # The only scan of texts; what goes on is narrow.
    rows = cut(
        files.select(
            F.struct(*(passed or ["path"])).alias("row"),
            F.monotonically_increasing_id().alias("file_key"),
            F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("directory"),
            name.alias("name"),
            units.alias("units"),
            words.alias("words"),
        )
    )
    own = (
        match_units(rows.select("file_key", F.inline("units")), threshold, templates)
        .groupBy("file_key", "kind")
        .agg(F.collect_set("license").alias("licenses"), F.max("cosine").alias("cosine"), F.sum("n_words").alias("licence_words"))
        .groupBy("file_key")  # units of different kinds overlap, so the fullest kind's words count
        .agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("licenses")))), " AND ").alias("license"), F.max("cosine").alias("cosine"), F.max("licence_words").alias("licence_words"))
    )
    marked = cut(
        rows.drop("units").join(own, "file_key", "left").withColumn(
            "is_file", F.col("license").isNotNull() & (F.col("name").rlike(FILE_NAME) | (F.col("licence_words") >= F.col("words") * file_share))
        )
    )
    licensed = marked.where("is_file").select("directory", "license").distinct().groupBy("directory").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("license", " AND "))))), " AND ").alias("license"))
    near = nearest_ancestors(marked.where("license IS NULL").select("directory").distinct(), licensed)
    found = marked.join(near, "directory", "left")
    origin = (
        F.when(F.col("is_file"), "file").when(F.col("license").isNotNull(), "header").when(F.col("inherited").isNotNull(), "ancestor").otherwise("none")
    )
    return found.select(
        "row.*",
        F.coalesce("license", "inherited").alias("license"),
        "cosine",
        origin.alias("origin"),
        F.when(F.col("is_file"), F.col("directory")).when(F.col("license").isNull(), F.col("ancestor")).alias("license_dir"),
    )
