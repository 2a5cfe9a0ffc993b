"""Licence families of paragraphs, in DataFrame expressions only.

A paragraph is a run of lines between lines without a letter or digit. Notices are wrapped at any width and stand
beside other text, so a paragraph is scored in windows: from each line on, one line, two and so on, until the lines
after the first hold as many words as the longest template needs. A multinomial logistic regression over hashed word
1- to 3-grams, with a class for unknown text, is fitted here on sentences varied from the templates below and on prose
that only mentions licences; a temperature fitted on windows cut from wrapped notices and on other prose calibrates it.
A prediction holds if it is likely enough and a template of its family confirms it: enough of the template's 3-grams
are in the window. Only windows with a word of ``stems()`` are scored: a template without enough of the 3-grams that
hold one can't be confirmed, so no verdict is lost.
"""

from __future__ import annotations

import functools
import json
import random
import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import SPACES, let

BUCKETS, SEED = 1 << 12, 42
WORD = r"[a-z0-9+]+(?:[.-][a-z0-9]+)*"
#: The notices' own words, by family; what stands on either side of a bar may stand apart.
TEMPLATES = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    "mit": ("Released under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3.", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "gpl-2.0": ("This work is licensed under the GNU General Public License, version 2.", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License, version 2.1.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "agpl": ("This program is licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-only"),
    "bsd": ("Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "isc": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice", "SPDX-License-Identifier: ISC"),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "cc0": ("Dedicated to the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights under CC0", "SPDX-License-Identifier: CC0-1.0"),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Released under the Unlicense license.", "SPDX-License-Identifier: Unlicense"),
    "epl-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0"),
    "artistic-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.", "Licensed under the Artistic License 2.0.", "SPDX-License-Identifier: Artistic-2.0"),
    "zlib": ("This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Released under the zlib License.", "SPDX-License-Identifier: Zlib"),
    "bsl-1.0": ("Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"),
    "proprietary": ("Copyright | All rights reserved.", "Copyright. All rights reserved.", "All rights reserved. No part of this publication may be reproduced without the prior written permission of the copyright holder."),
}
FAMILIES = tuple(TEMPLATES)
#: Prose that mentions such words and is no notice.
PROSE = (
    "she lost her driving licence on the way home", "the license plate of the car was covered in mud", "he has a licence to teach and a warrant for his arrest was never issued", "copyright law is a difficult subject for most students", "the shop sells licensed toys and books",
    "a licensed plumber came to fix the pipe", "the public domain is a topic of the second lecture", "there is no warranty on used cars in this town", "they redistributed the land among the farmers", "the license fee rose again last year", "the judge signed the search warrant", "the version 2 of the plan was better than version 3",
    "poetic license allows the writer much", "the city issued a new liquor license to the bar", "general public opinion about the free software foundation changed", "the copyright office closed at noon", "software and documentation files were lost", "which license should one choose for a library", "the apache helicopter and the mit campus",
)
#: Other prose of this kind, for the calibration alone.
OTHER_PROSE = (
    "the hunting licence must be renewed each autumn", "without a warranty the phone is worth little", "the film is in the public domain by now", "the terms of the treaty were never published", "this software is slow and the documentation is thin",
    "they asked for permission to use the hall", "a general license to sell fireworks", "the foundation is free to publish what it likes", "no part of the house was spared", "the boost in sales was artistic luck", "the eclipse was seen by the public at noon", "any person may obtain a copy of the map at the desk", "all rights of way stay open", "the version of the story that he told",
)
LIMITS = {"likely": 0.5, "confirmed": 0.6}
#: Words that are common in other text, so no stems where others will do.
PLAIN = frozenset("under without public provided published subject general free version terms this with work person notice purpose conditions materials".split())
#: What stands around a line's words where a notice is a comment.
MARGIN = " \t\r\x0b\x0c*#/;>|%-"


def tokens(line: str) -> list[str]:
    return re.findall(WORD, line.lower())


#: Words after a window's first line: the longest template and some that a notice adds to it, as (the "Software").
REACH = max(len(tokens(t)) for ts in TEMPLATES.values() for t in ts) + 8


@functools.lru_cache(maxsize=4)
def stems(confirmed: float = LIMITS["confirmed"]) -> tuple[str, ...]:
    """Words of which every window that confirms a template holds one.

    Of each template so many 3-grams hold a stem that those without one are fewer than ``confirmed`` asks. Words are
    taken one after the other, the one that the most open templates' 3-grams still lack first; long words before
    short ones, as they are rarer in other text.
    """
    open_ = [[g.split() for g in template_grams(t)] for ts in TEMPLATES.values() for t in ts]
    out: list[str] = []
    bare = lambda t: [g for g in t if not any(s in w for w in g for s in out)]
    while left := [bare(t) for t in open_ if len(bare(t)) >= confirmed * len(t)]:
        words = sorted({w for t in left for g in t for w in g})
        gain = {w: sum(any(w in x for x in g) / len(t) for t in left for g in t) * min(len(w), 9) ** 5 * (0.2 if w in PLAIN else 1) for w in words}
        out.append(max(words, key=lambda w: (gain[w], w)))
    return tuple(out)


def hashed(gram: str) -> int:
    h = xxhash.xxh64_intdigest(gram.encode(), SEED)
    return h - (1 << 64) if h >> 63 else h


def grams(words: list[str], n: int) -> list[str]:
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def template_grams(template: str) -> list[str]:
    """Distinct 3-grams of a template's parts, or the whole of a shorter part."""
    return sorted({g for part in template.split("|") for w in [tokens(part)] for g in (grams(w, 3) if len(w) >= 3 else [" ".join(w)])})


def shingles(template: str) -> list[int]:
    """A template's grams as Spark's xxhash64 gives them."""
    return sorted(map(hashed, template_grams(template)))


def buckets(words: list[str]) -> list[int]:
    return sorted({hashed(g) & (BUCKETS - 1) for n in (1, 2, 3) for g in grams(words, n)})


def sentences(n: int, seed: int) -> tuple[list[list[int]], np.ndarray]:
    """Varied templates and prose: words dropped, added and prefixed; class 0 is unknown."""
    r = random.Random(seed)
    filler = "the of and to in a is that it for on was with as by this from be are or at project code work author team 2019 2021 inc ltd copyright file section general license licence version software terms public".split()
    noise = lambda: "".join(r.choice("abcdeghilmnorstu") for _ in range(r.randint(2, 8)))
    x, y = [], []
    for _ in range(n):
        if r.random() < 0.5:
            k = r.randrange(len(FAMILIES))
            words = tokens(r.choice(TEMPLATES[FAMILIES[k]]))
            words = [w for w in words if r.random() > 0.06]
            label = k + 1
        else:
            label, words = 0, tokens(r.choice(PROSE)) if r.random() < 0.7 else [r.choice(filler) for _ in range(r.randint(3, 14))]
        extra = [r.choice([noise(), r.choice(filler)]) for _ in range(r.randint(0, 6))]
        cut = r.randint(0, len(extra))
        x.append(buckets(extra[:cut] + words + extra[cut:]))
        y.append(label)
    return x, np.array(y)


def cut_windows(n: int, seed: int) -> tuple[list[list[int]], np.ndarray]:
    """Windows of wrapped notices between other lines, and other prose: a source of its own. Class 0 is unknown."""
    r = random.Random(seed)
    x, y = [], []
    while len(x) < n:
        if r.random() < 0.5:
            k = r.randrange(len(FAMILIES))
            notice = tokens(r.choice(TEMPLATES[FAMILIES[k]]))
            lead, rest = tokens(r.choice(OTHER_PROSE))[-r.randint(0, 5) :], tokens(r.choice(OTHER_PROSE))[: r.randint(0, 8)]
            keep = max(1, round(r.uniform(0.7, 1.0) * len(notice)))
            at = r.randint(0, len(notice) - keep)
            words, label = lead + notice[at : at + keep] + rest, k + 1
        else:
            words, label = tokens(" ".join(r.sample(OTHER_PROSE, r.randint(1, 2)))), 0
        x.append(buckets(words))
        y.append(label)
    return x, np.array(y)


@functools.lru_cache(maxsize=2)
def fitted(n: int = 2400, steps: int = 120, rate: float = 0.2, l2: float = 1e-4, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Weights (buckets x classes) and biases, divided by the calibrating temperature."""
    classes = len(FAMILIES) + 1

    def flat(x):
        return np.concatenate([np.array(a, np.int64) for a in x]), np.repeat(np.arange(len(x)), [len(a) for a in x])

    def logits(at, of, size):
        return bias + np.stack([np.bincount(of, weights=w[at, k], minlength=size) for k in range(classes)], 1)

    def soft(z):
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    x, y = sentences(n, seed)
    at, of = flat(x)
    target = np.eye(classes)[y]
    w, bias = np.zeros((BUCKETS, classes)), np.zeros(classes)
    state = [np.zeros_like(a) for a in (w, w, bias, bias)]
    for step in range(1, steps + 1):
        err = (target - soft(logits(at, of, n))) / n
        g = np.stack([np.bincount(at, weights=err[of, k], minlength=BUCKETS) for k in range(classes)], 1) - l2 * w
        for k, (p, d) in enumerate(((w, g), (bias, err.sum(0)))):
            m, v = state[2 * k], state[2 * k + 1]
            m *= 0.9
            m += 0.1 * d
            v *= 0.99
            v += 0.01 * d * d
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    x, y = cut_windows(n // 2, seed + 1)
    z = logits(*flat(x), len(x))
    loss = {t: -np.log(np.maximum(soft(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)}
    best = min(loss, key=loss.get)
    return np.round(w / best, 5), np.round(bias / best, 5)


def _constant(value, kind: str) -> Column:
    """A literal of nested arrays, as one constant expression."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _joined(words: Column, n: int) -> Column:
    places = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.concat_ws(" ", *(F.get(words, i + k) for k in range(n)))))


def paragraph_verdict(line: Column, limits: dict) -> Column:
    """Struct of the likeliest class (0: unknown), its probability, and the best template share of that family."""
    weights, bias = fitted()
    # rows of zeros are kept short: an absent row weighs nothing
    rows = _constant([r.tolist() if r.any() else [] for r in weights], "array<array<double>>")
    base = _constant(bias.tolist(), "array<double>")
    known = _constant([[], *([shingles(t) for t in TEMPLATES[f]] for f in FAMILIES)], "array<array<array<bigint>>>")

    def of_words(words: Column) -> Column:
        all_grams = F.array_distinct(F.transform(F.concat(_joined(words, 1), _joined(words, 2), _joined(words, 3)), lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")))
        add = lambda z, b: F.when(F.size(F.get(rows, b)) == 0, z).otherwise(F.zip_with(z, F.get(rows, b), lambda p, q: p + q))
        mine = F.array_distinct(F.concat(_joined(words, 3), _joined(words, 2), _joined(words, 1)))  # shorter ones for short templates

        def of_logits(z: Column) -> Column:
            most = F.array_max(z)
            total = F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - most))
            kind = (F.array_position(z, most) - 1).cast("int")
            shares = F.transform(F.get(known, kind), lambda t: F.size(F.array_intersect(t, mine)) / F.greatest(F.size(t), F.lit(1)))
            return F.struct(kind.alias("kind"), (1 / total).alias("p"), F.coalesce(F.array_max(shares), F.lit(0.0)).alias("share"))

        return let(F.aggregate(all_grams, base, add), of_logits)

    return let(F.regexp_extract_all(F.lower(line), F.lit(f"({WORD})"), F.lit(1)), of_words)


def windows_from(lines: Column) -> Column:
    """The first line, the first two and so on, joined by blanks, until the lines after the first hold REACH words."""
    none = F.struct(F.lit("").alias("text"), F.lit(-1).alias("n"), F.array().cast("array<string>").alias("out"))

    def grow(held: Column, line: Column) -> Column:
        text = F.when(held["n"] < 0, line).otherwise(F.concat(held["text"], F.lit(" "), line))
        n = F.when(held["n"] < 0, 0).otherwise(held["n"] + F.size(F.split(line, SPACES)))
        longer = F.struct(text.alias("text"), n.alias("n"), F.concat(held["out"], F.array(text)).alias("out"))
        return F.when(held["n"] >= REACH, held).otherwise(longer)

    return F.aggregate(lines, none, grow, lambda held: held["out"])


def scan_licences(docs: DataFrame, limits: dict | None = None) -> DataFrame:
    """One row per document: doc_id, n_paragraphs (with a word), n_candidates (with a word of ``stems``), n_licensed
    (with a window predicted and confirmed), families (distinct, sorted, comma-joined), licence (family of the likeliest
    confirmed window, the first of equals, "proprietary" only where no other is confirmed; "unknown" without one),
    probability (of it; 0 without one).

    A null text counts as empty: no paragraphs, unknown. Rows are scanned one by one, so repeated rows stay
    repeated and nothing is shuffled; whole texts are read; other columns are not.
    """
    lim = LIMITS | (limits or {})
    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    empty = F.array().cast("array<struct<kind:int,p:double,share:double>>")

    def has_stem(s: Column) -> Column:
        out = F.lit(False)
        for stem in stems(lim["confirmed"]):
            out = out | F.contains(s, F.lit(stem))
        return out

    def of_paragraph(lines: Column) -> Column:
        """Whether a stem is in the paragraph, and its confirmed windows."""
        near = F.transform(lines, has_stem)

        def of_near(flags: Column) -> Column:
            starts = F.filter(F.transform(flags, lambda _, i: i), lambda i: F.exists(F.slice(flags, i + 1, REACH + 1), lambda x: x))
            windows = F.flatten(F.transform(starts, lambda i: windows_from(F.slice(lines, i + 1, REACH + 1))))
            found = F.transform(F.filter(windows, has_stem), lambda s: paragraph_verdict(s, lim))
            sure = F.filter(found, lambda v: (v["kind"] > 0) & (v["p"] >= lim["likely"]) & (v["share"] >= lim["confirmed"]))
            return F.struct(F.exists(flags, lambda x: x).alias("c"), F.when(F.exists(flags, lambda x: x), sure).otherwise(empty).alias("sure"))

        return let(near, of_near)

    def of_text(t: Column) -> Column:
        # the class takes in line ends, so one match is a whole run of lines without a letter or digit
        paragraphs = F.filter(F.split(t, r"\n[^\p{L}\p{N}]*\n"), lambda s: F.rlike(s, F.lit(r"[^\x20\x09-\x0D]")))

        def of_paragraphs(some: Column) -> Column:
            lines = F.transform(some, lambda s: F.filter(F.transform(F.split(s, "\n"), lambda x: F.btrim(x, F.lit(MARGIN))), lambda x: x != ""))

            def of_found(found: Column) -> Column:
                return F.struct(
                    F.size(some).cast("long").alias("n"),
                    F.size(F.filter(found, lambda v: v["c"])).cast("long").alias("c"),
                    F.size(F.filter(found, lambda v: F.size(v["sure"]) > 0)).cast("long").alias("licensed"),
                    F.flatten(F.transform(found, lambda v: v["sure"])).alias("sure"),
                )

            first = F.rlike(t, F.lit("|".join(re.escape(s) for s in stems(lim["confirmed"]))))  # one look at the text spares most
            return let(F.when(first, F.transform(lines, of_paragraph)).otherwise(F.array().cast("array<struct<c:boolean,sure:array<struct<kind:int,p:double,share:double>>>>")), of_found)

        return let(paragraphs, of_paragraphs)

    names = F.array(*(F.lit(f) for f in ("unknown", *FAMILIES)))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), let(text, of_text).alias("v"))
    other = F.filter(F.col("v.sure"), lambda s: s["kind"] != 1 + FAMILIES.index("proprietary"))
    pool = F.when(F.size(other) > 0, other).otherwise(F.col("v.sure"))
    first = let(pool, lambda x: F.get(F.filter(x, lambda s: s["p"] == F.array_max(F.transform(x, lambda q: q["p"]))), F.lit(0)))
    out = out.select("doc_id", F.col("v.n").alias("n_paragraphs"), F.col("v.c").alias("n_candidates"), F.col("v.licensed").alias("n_licensed"), F.col("v.sure").alias("sure"), first.alias("first"))
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("sure", lambda s: F.get(names, s["kind"])))), ",")
    return out.select("doc_id", "n_paragraphs", "n_candidates", "n_licensed", families.alias("families"), F.coalesce(F.get(names, F.col("first.kind")), F.lit("unknown")).alias("licence"), F.coalesce(F.col("first.p"), F.lit(0.0)).alias("probability"))
