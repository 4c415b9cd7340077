"""Licence scans by a trained paragraph classifier, in DataFrame functions only.

A sparse multinomial logistic regression over word 1- to 3-grams tells licence
families and an unknown class apart. It is fitted on variants of the notices
below and on sentences that use their words otherwise. Its temperature is that
with the least log loss on variants of whole notices and sentences that a first
fit has not seen, and a paragraph whose best family has a calibrated probability
under ``certain`` is unknown. A prediction is confirmed when enough of the
3-grams of one of the family's notices are in the paragraph.

Scanning runs inside each row; nothing is exploded or shuffled. A text is split
into paragraphs at lines without letters or digits, a paragraph's lines are
joined by blanks, and windows of its words are scored by a literal table of the
model's weights, so a notice may be wrapped at any width. A window is longer than
the longest notice by the step between windows: every notice is whole in one.
Single lines are scored as well. What can't be confirmed is not scored: the
gate's words and 3-grams (``gate``) are derived from the notices so that a text without any
of them lacks too many 3-grams of every notice.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm.common import text_or_empty

UNKNOWN = "unknown"
#: Words of a window of a paragraph, and from one window to the next.
WINDOW, STEP = 64, 16
#: Notices by family (fixed values).
NOTICES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache 2.0 license.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
        "This software is licensed under the MIT license.",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under the GPL version 3.",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "Licensed under the GPL version 2.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "agpl-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Released under the BSD License.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "SPDX-License-Identifier: ISC",
        "Released under the ISC License.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "public-domain": (
        "This work has been dedicated to the public domain under CC0 1.0.",
        "This is free and unencumbered software released into the public domain. See the Unlicense.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited.",
        "Proprietary and confidential. No license is granted. All rights reserved.",
    ),
}
#: Sentences that use the notices' words otherwise (fixed values).
OTHERWISE = (
    "He lost his driving licence and had to take the test again.",
    "The pub applied for a licence to serve beer in the garden.",
    "A fishing license is sold at the lake and costs four dollars.",
    "You need a license plate and a permit before you drive the car.",
    "The apache helicopter flew over the public square, version two of the film shows.",
    "She studied at MIT and released a paper under her own name.",
    "General elections and public works are reported in this file.",
    "The council wants to redistribute the money to poorer regions.",
    "Redistribution of land was the first reform of the new government.",
    "The documents entered public debate, and the domain was sold for a fortune.",
    "A creative mind and a common purpose helped the artists.",
    "All seats are reserved and all rights of way are open.",
    "Permission to use the hall was refused by the school.",
    "The dog was sold without warranty or papers.",
    "The version three of the song is free and lasts four minutes.",
    "Poetic license allows the author to change the dates.",
    "The bank holds a licence from the regulator since two years.",
    "Licensed premises close at ten and the bar at nine.",
    "Licensed under the table, the game went on in the back room.",
    "The licensing authority released its report on the work.",
    "Attribution of the painting to the master is not certain.",
    "A license is hereby requested by any person with a gun.",
)


CONFIRM = 0.5


def plain_words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def gate(notices: dict[str, tuple[str, ...]], confirm: float) -> list[str]:
    """Words and 3-grams such that a text without any of them is confirmed for no notice.

    For each notice they are taken until fewer than ``confirm`` of its 3-grams have
    none of them: words of six letters or more first (that in most of the 3-grams
    not yet covered), then the 3-grams themselves. A text without any has only those."""
    out: dict[str, None] = {}
    for own in notices.values():
        for notice in own:
            grams = inline_ngrams(notice)
            bare = [g for g in grams if g not in out and not set(g.split()) & out.keys()]
            while bare and len(bare) >= confirm * len(grams):
                long = {w for g in bare for w in g.split() if len(w) >= 6}
                best = max(long, key=lambda w: (sum(w in g.split() for g in bare), len(w), w)) if long else bare[0]
                out[best] = None
                bare = [g for g in bare if g != best and best not in g.split()]
    return list(out)


def words(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit("[a-z0-9]+"), F.lit(0))


def ngrams(tokens: Column) -> Column:
    """Distinct 1-, 2- and 3-grams of an array of words."""

    def of(n: int) -> Column:
        places = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat_ws(" ", *[F.get(tokens, i - 1 + k) for k in range(n)]))

    return F.array_distinct(F.concat(tokens, of(2), of(3)))


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for a row."""
    return F.get(F.transform(F.array(value), use), 0)


def constant(value, kind: str) -> Column:
    """A constant of type ``kind``. It is one expression until the optimizer folds it, where
    thousands of literals would each be analysed wherever they are used."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def inline(spark: SparkSession, rows: list[dict], kind: str) -> DataFrame:
    """A small fixed table, in one partition."""
    return spark.range(0, 1, 1, 1).select(F.inline(constant(rows, f"array<struct<{kind}>>")))


@dataclass
class LicenceModel:
    classes: list[str]
    intercepts: list[float]
    weights: dict[str, list[float]] = field(repr=False)
    temperature: float = 1.0

    def logits(self, grams: Column) -> Column:
        """Of an array of n-grams: a number for each class."""
        zero = F.array(*[F.lit(x) for x in self.intercepts])
        if not self.weights:
            return zero
        table = constant({g: [float(x) for x in w] for g, w in self.weights.items()}, "map<string,array<double>>")
        known = F.array_intersect(grams, constant(list(self.weights), "array<string>"))
        return F.aggregate(known, zero, lambda sums, g: F.zip_with(sums, F.element_at(table, g), lambda a, b: a + b))

    def probabilities(self, logits: Column) -> Column:
        t = F.lit(float(self.temperature))

        def soft(x: Column) -> Column:
            e = F.transform(x, lambda v: F.exp((v - F.array_max(x)) / t))
            return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))

        return bind(logits, soft)


def variants(spark: SparkSession) -> DataFrame:
    """Training rows ``label, words, held``: each notice whole, cut at either end,
    with every n-th word left out, and with other words around it. Held are all
    variants of every third notice of a family, and of every third sentence."""
    rows = [{"label": f, "line": n, "held": i % 3 == 1} for f, notices in (NOTICES | {UNKNOWN: OTHERWISE}).items() for i, n in enumerate(notices)]
    base = inline(spark, rows, "label:string,line:string,held:boolean").select("label", "held", words(F.col("line")).alias("w"))
    n = F.size("w")
    plain = [F.col("w")]
    cut = [F.slice("w", 1, F.greatest(F.lit(3), (n * x).cast("int"))) for x in (0.6, 0.75, 0.9)]
    cut += [F.slice("w", F.greatest(F.lit(1), (n * x).cast("int") + 1), n) for x in (0.1, 0.25)]
    hole = lambda k: F.filter("w", lambda x, i: (i + k) % 7 != 3)
    holes = [F.when(n >= 8, hole(k)).otherwise(F.col("w")) for k in (0, 2, 4)]
    around = [F.concat(F.array(*map(F.lit, a.split())), F.col("w"), F.array(*map(F.lit, b.split()))) for a, b in (("copyright 2019 the authors", "see the file for details"), ("this page and its text", "thank you for reading"), ("note", "2021"))]
    made = base.select("label", "held", F.explode(F.array(*plain, *cut, *holes, *around)).alias("words"))
    # A part of a notice that no scan would score teaches nothing.
    line = F.array_join("words", " ")
    cue = F.exists(constant(gate(NOTICES, CONFIRM), "array<string>"), lambda c: F.contains(line, c))
    return made.where(cue | (F.col("label") == UNKNOWN))


#: Models fitted by this process, by their strength: the training set is fixed, so a second fit would give the same.
_fitted: dict[float, LicenceModel] = {}


def fit_licences(spark: SparkSession, strength: float = 0.002) -> LicenceModel:
    """Fit on the variants. The training set is fixed and has a few hundred rows, in one
    partition; a model is fitted once a process."""
    if strength not in _fitted:
        _fitted[strength] = _fit(spark, strength)
    return _fitted[strength]


def _fit(spark: SparkSession, strength: float) -> LicenceModel:
    data = variants(spark).withColumn("grams", ngrams(F.col("words"))).select("label", "held", "grams").cache()
    classes = sorted([*NOTICES, UNKNOWN])
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1
    data = data.withColumn("class", number.cast("double"))

    def fitted(rows: DataFrame) -> LicenceModel:
        counter = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2.0, vocabSize=1 << 14).fit(rows)
        regression = LogisticRegression(labelCol="class", family="multinomial", regParam=strength, elasticNetParam=1.0, maxIter=40)
        found = regression.fit(counter.transform(rows).select("class", "features"))
        matrix = found.coefficientMatrix.toArray()
        vocabulary = counter.vocabulary  # each call copies all of it from the JVM
        used = (abs(matrix) > 1e-6).any(axis=0).nonzero()[0]
        return LicenceModel(classes, [float(x) for x in found.interceptVector], {vocabulary[i]: [round(float(x), 5) for x in matrix[:, i]] for i in used})

    # The temperature with the least log loss on notices and sentences that the first fit has not seen.
    first = fitted(data.where("NOT held"))
    grid = [0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8]
    own = data.where("held").select("class", first.logits(F.col("grams")).alias("z"))
    loss = [F.avg(-F.log(F.get(LicenceModel(classes, [], {}, t).probabilities(F.col("z")), F.col("class").cast("int")) + 1e-12)).alias(str(i)) for i, t in enumerate(grid)]
    losses = list(own.agg(*loss).first())
    model = fitted(data)
    model.temperature = grid[min(range(len(grid)), key=lambda i: losses[i] if losses[i] is not None else 9e9)]
    data.unpersist()
    return model


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", certain: float = 0.5, confirm: float = CONFIRM, model: LicenceModel | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_lines, n_notices, families, score, notices``.

    * ``notices``: an array of (line, family, probability, overlap) of the
      confirmed notices, lines counted from 0: single lines, and windows of
      paragraphs at the line of their first word. Windows of one family that
      overlap are one notice, and a window that holds a confirmed line of its
      family is that line's notice. ``families`` their distinct
      families in order, joined by commas; ``score`` the largest probability (0 without any).
    * Texts are scanned whole. Null text counts as empty; blank lines are no
      lines. Null identifiers stay null, repeated rows are rows like any other,
      an empty table gives an empty result, and other columns are not read. A very
      long text is held whole in a row.
    """
    spark = docs.sparkSession
    model = model or fit_licences(spark)
    unknown = model.classes.index(UNKNOWN)
    shapes = {f: [inline_ngrams(n) for n in NOTICES.get(f, ())] for f in model.classes}
    templates = constant([shapes[f] for f in model.classes], "array<array<array<string>>>")
    names = constant(model.classes, "array<string>")
    cues = gate({f: NOTICES[f] for f in model.classes if f in NOTICES}, confirm)

    def judge(w: Column, place: Column) -> Column:
        def best(p: Column, grams: Column) -> Column:
            top = (F.array_position(p, F.array_max(p)) - 1).cast("int")
            overlap = F.coalesce(F.array_max(F.transform(F.get(templates, top), lambda t: F.size(F.array_intersect(t, grams)) / F.size(t))), F.lit(0.0))
            return F.struct(place.alias("line"), F.get(names, top).alias("family"), F.array_max(p).alias("probability"), overlap.alias("overlap"), top.alias("top"))

        return bind(ngrams(w), lambda g: bind(model.probabilities(model.logits(g)), lambda p: best(p, g)))

    sure = lambda j: (j["top"] != unknown) & (j["probability"] >= certain) & (j["overlap"] >= confirm)
    lines = F.split("text", "\n")
    has = lambda low: F.reduce(constant(cues, "array<string>"), F.lit(False), lambda a, c: a | F.contains(low, c))
    numbered = F.transform(F.col("lines"), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    wanted = F.filter(numbered, lambda s: bind(F.array_join(F.get("tokens", s["i"]), " "), has))
    by_line = F.filter(F.transform(wanted, lambda s: judge(words(s["x"]), s["i"])), sure)

    # Paragraphs: runs of lines with words, as (first line, end).
    count = lambda i: F.coalesce(F.size(F.get("tokens", i)), F.lit(0))
    some = lambda i: F.when(F.get("tokens", i).isNotNull(), count(i)).otherwise(F.lit(0)) > 0
    each = F.sequence(F.lit(0), F.size("tokens") - 1)
    firsts = F.filter(each, lambda i: some(i) & ~some(i - 1))
    lasts = F.filter(each, lambda i: some(i) & ~some(i + 1))

    def windows(first: Column, last: Column) -> Column:
        """Confirmed windows of a paragraph: judgements with the window's last line and number."""
        own = F.slice("tokens", first + 1, last - first + 1)

        def scan(w: Column, line: Column) -> Column:
            starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size(w) - WINDOW) / STEP).cast("int")))
            cut = F.transform(starts, lambda k: F.struct(k.alias("k"), F.slice(w, k * STEP + 1, WINDOW).alias("w")))
            cued = F.filter(cut, lambda s: bind(F.array_join(s["w"], " "), has))
            judged = F.transform(cued, lambda s: F.struct(judge(s["w"], F.get(line, s["k"] * STEP)).alias("j"), F.get(line, F.least(s["k"] * STEP + WINDOW, F.size(w)) - 1).alias("end"), s["k"].alias("k")))
            # The first of windows of one family that overlap.
            near = (WINDOW - 1) // STEP
            once = lambda all_: F.filter(all_, lambda x: ~F.exists(all_, lambda y: (y["j"]["family"] == x["j"]["family"]) & (y["k"] < x["k"]) & (y["k"] >= x["k"] - near)))
            return bind(F.filter(judged, lambda x: sure(x["j"])), once)

        numbers = F.flatten(F.transform(own, lambda t, i: F.array_repeat(first + i, F.size(t))))
        return bind(F.flatten(own), lambda w: bind(numbers, lambda line: scan(w, line)))

    # A paragraph of one line that fits a window is scored as a line already.
    paragraphs = F.filter(F.arrays_zip(firsts.alias("first"), lasts.alias("last")), lambda p: (p["first"] < p["last"]) | (count(p["first"]) > WINDOW))
    by_window = F.flatten(F.transform(paragraphs, lambda p: windows(p["first"], p["last"])))
    fresh = lambda x, own: ~F.exists(own, lambda y: (y["family"] == x["j"]["family"]) & y["line"].between(x["j"]["line"], x["end"]))
    added = F.transform(F.filter("by_window", lambda x: fresh(x, F.col("by_line"))), lambda x: x["j"])
    any_cue = F.lower("text").rlike("|".join(c.replace(" ", "[^a-z0-9]+") for c in cues))
    none = "array<struct<line:int,family:string,probability:double,overlap:double,top:int>>"
    ranged = "array<struct<j:struct<line:int,family:string,probability:double,overlap:double,top:int>,end:int,k:int>>"
    return (
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
        .withColumn("lines", lines)
        .withColumn("n_lines", F.size(F.filter("lines", lambda x: F.length(F.trim(x)) > 0)).cast("bigint"))
        .withColumn("cued", any_cue)
        .withColumn("tokens", F.when(F.col("cued"), F.transform("lines", words)))
        .withColumn("by_line", F.when(F.col("cued"), by_line).otherwise(F.array().cast(none)))
        .withColumn("by_window", F.when(F.col("cued"), by_window).otherwise(F.array().cast(ranged)))
        .withColumn("found", F.array_sort(F.concat("by_line", added)))
        .select(
            "doc_id",
            "n_lines",
            F.size("found").cast("bigint").alias("n_notices"),
            F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda j: j["family"]))), ",").alias("families"),
            F.coalesce(F.array_max(F.transform("found", lambda j: j["probability"])), F.lit(0.0)).alias("score"),
            F.transform("found", lambda j: F.struct(j["line"].alias("line"), j["family"].alias("family"), j["probability"].alias("probability"), j["overlap"].alias("overlap"))).alias("notices"),
        )
    )


def inline_ngrams(notice: str) -> list[str]:
    """The 3-grams of a fixed notice (its words where it has fewer)."""
    w = plain_words(notice)
    return list(dict.fromkeys(" ".join(w[i : i + 3]) for i in range(len(w) - 2))) or list(dict.fromkeys(w))
