"""Licence notices found by Dice coefficients of word bigrams, in DataFrame expressions only.

Text is lower-cased and everything but letters and digits becomes a space. Units are the
sentences, the lines and the whole of a text, and windows: runs of words of about a template's length anywhere
in the text, so that a notice wrapped over lines or run together with other words is found. Of overlapping
windows the best counts (the shortest, then the earliest of equals), and none that overlaps the words of another
unit found for its template.

A unit of n distinct bigrams is compared only with templates whose number t of bigrams lets the coefficient reach the
threshold: 2 min(n, t) / (n + t) bounds it. So at least t threshold / (2 - threshold) bigrams are
the template's; texts that lack them for every template are left out first. Windows have from the template's own
length to t (2 - threshold) / threshold bigrams, and begin with one of the template's or are the last of the text.

Null and empty texts, and units of one word, match nothing. Rows with equal ids are one document.
Other columns than those named are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Short forms of the notices that name a licence.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Passages of the full texts of licences and of the rest of their headers, by which those texts are found wherever they stand.
PASSAGES = {
    "apache-2.0-text": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "apache-2.0-warranty": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "bsd-2-clause-text": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl-2.0-text": "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    "gpl-3.0-text": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-3.0-text": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mpl-2.0-text": '"Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.',
}
THRESHOLD = 0.8


def _template_words(text: str) -> list[str]:
    return re.sub(r"[^\w]|_", " ", text.lower()).split()


def _bigrams(text: str) -> list[str]:
    words = _template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words[:-1], words[1:], strict=True)})


def _let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def normalised(text: Column) -> Column:
    """Normalised text, with line ends kept and a mark between sentences."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])[ \t]+", "$1\u0001")
    return F.regexp_replace(F.lower(marked), r"[^\p{L}\p{N}\n\x01]+", " ")


def _words(plain: Column) -> Column:
    return F.array_remove(F.split(F.translate(plain, "\n\u0001", "  "), " ", -1), "")


def units_of(plain: Column) -> Column:
    """Sentences, lines and the whole of a normalised text, without repetition."""
    lines = F.split(F.replace(plain, F.lit("\u0001"), F.lit(" ")), "\n", -1)
    return F.array_distinct(F.concat(F.split(plain, r"[\n\x01]", -1), lines, F.array(F.translate(plain, "\n\u0001", "  "))))


def _pairs(words: Column) -> Column:
    """Distinct bigrams of an array of two words or more."""
    return F.array_distinct(F.transform(F.slice(words, 1, F.size(words) - 1), lambda w, i: F.concat_ws(" ", w, words[i + 1])))


def _dice(grams: Column, t: Column) -> Column:
    return 2.0 * F.size(F.array_intersect(grams, t["grams"])) / (F.size(grams) + t["n"])


def _span(words: Column, w: Column) -> Column:
    return F.slice(words, w["at"], w["size"] + 1)


def _windows(words: Column, hits: Column, t: Column, threshold: float) -> Column:
    """(dice, at, size) of the windows that count: size bigrams from word number at, counted from 1; at least the template's."""

    last_start = F.size(words) - t["length"]  # with fewer words the whole text is the only unit

    def best(mine, k):
        at = F.least(mine[k]["at"], last_start)
        sizes = F.sequence(t["length"], F.least(t["most"], F.size(words) - at))
        return F.array_max(F.transform(sizes, lambda n: F.struct(_dice(_pairs(F.slice(words, at, n + 1)), t).alias("dice"), (-n).alias("less"), (-at).alias("early"), at.alias("at"), n.alias("size"))))

    def found(mine):
        last = F.size(mine) - t["need"]
        starts = F.filter(F.when((last >= 0) & (last_start > 0), F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")), lambda k: mine[k + t["need"] - 1]["at"] - mine[k]["at"] < t["most"])
        return F.filter(F.transform(starts, lambda k: best(mine, k)), lambda w: w["dice"] >= threshold)

    def alone(all_found):  # starts are in order, and distinct but at the end of the text: only so many before and after can overlap
        def beaten(w, i):
            near = F.slice(all_found, F.greatest(F.lit(1), i + 1 - t["most"]), 2 * t["most"] + 1)
            return F.exists(near, lambda o: (o > w) & (o["at"] <= w["at"] + w["size"]) & (w["at"] <= o["at"] + o["size"]))

        return F.filter(all_found, lambda w, i: ~beaten(w, i))

    return _let(_let(F.filter(hits, lambda h: F.array_contains(t["grams"], h["gram"])), found), alone)


def _overlaps(words: Column, w: Column, unit: Column) -> Column:
    """Whether the unit's words stand where the window is, or partly there."""
    places = F.sequence(F.greatest(F.lit(1), w["at"] - F.size(unit) + 1), w["at"] + w["size"])
    return F.exists(places, lambda p: F.slice(words, p, F.size(unit)) == unit)


def scan(documents: DataFrame, templates: dict[str, str] = TEMPLATES | PASSAGES, threshold: float = THRESHOLD, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, n_units, dice): per document and template the distinct units at or over the threshold (above 0) and the best coefficient."""
    grams = {name: g for name, body in templates.items() if (g := _bigrams(body))}
    lengths = {name: len(_template_words(templates[name])) - 1 for name in grams}
    least, most = threshold / (2 - threshold), (2 - threshold) / threshold
    known = F.array(*(
        F.struct(F.lit(name).alias("name"), F.lit(len(g)).alias("n"), F.lit(math.ceil(len(g) * least - 1e-9)).alias("need"), F.lit(lengths[name]).alias("length"), F.lit(max(lengths[name], math.floor(len(g) * most + 1e-9))).alias("most"), F.array(*map(F.lit, g)).alias("grams"))
        for name, g in grams.items()
    ))
    every = sorted({x for g in grams.values() for x in g})
    heads = sorted({x.split(" ")[0] for x in every})
    fewest = min(map(len, grams.values()))

    def hits_of(w):
        def is_hit(i):
            return w[i - 1].isin(heads) & F.concat_ws(" ", w[i - 1], w[i]).isin(every)

        at = F.when(F.size(w) > 1, F.filter(F.sequence(F.lit(1), F.size(w) - 1), is_hit)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(i.alias("at"), F.concat_ws(" ", w[i - 1], w[i]).alias("gram")))

    def possible(row):
        seen = F.array_distinct(row["hits"]["gram"])
        return _let(seen, lambda s: F.exists(known, lambda t: F.size(F.array_intersect(s, t["grams"])) >= t["need"]))

    plain = documents.select(F.col(id_column).alias("doc_id"), F.explode(F.array(normalised(F.col(text)))).alias("plain"))
    row = _let(_words(F.col("plain")), lambda w: F.struct(w.alias("words"), hits_of(w).alias("hits")))
    rows = plain.select("doc_id", "plain", F.explode(F.filter(F.array(row), possible)).alias("row"))
    split = F.transform(units_of(F.col("plain")), lambda unit: F.array_remove(F.split(unit, " ", -1), ""))
    # n distinct bigrams reach the threshold with t only if 2 n >= threshold (n + t); n is less than the words
    enough = F.filter(split, lambda w: F.size(w) > fewest * threshold / (2 - threshold))
    units = F.transform(enough, lambda w: F.struct(w.alias("words"), _pairs(w).alias("grams")))
    words, hits = F.col("row.words"), F.col("row.hits")

    def near(g, t):
        return 2 * F.least(F.size(g), t["n"]) >= threshold * (F.size(g) + t["n"])

    def result(t, own):
        whole = F.filter(F.transform(F.filter(own, lambda u: near(u["grams"], t)), lambda u: F.struct(u["words"].alias("words"), _dice(u["grams"], t).alias("dice"))), lambda u: u["dice"] >= threshold)

        def with_windows(found):
            others = F.filter(_windows(words, hits, t, threshold), lambda w: ~F.exists(found, lambda u: _overlaps(words, w, u["words"])))
            return _let(others, lambda o: F.struct(t["name"].alias("license"), (F.size(found) + F.size(F.array_distinct(F.transform(o, lambda w: _span(words, w))))).alias("n"), F.array_max(F.concat(found["dice"], o["dice"])).alias("dice")))

        return _let(whole, with_windows)

    hit = _let(units, lambda own: F.filter(F.transform(known, lambda t: result(t, own)), lambda r: r["n"] > 0))
    scored = rows.select("doc_id", F.explode(hit).alias("hit"))
    return scored.groupBy("doc_id", "hit.license").agg(F.sum("hit.n").alias("n_units"), F.max("hit.dice").alias("dice"))
