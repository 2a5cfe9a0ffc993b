"""Quality rules, order fingerprints and licence scans: DataFrame expressions against plain Python."""

import hashlib
import random
import re
import struct
from collections import Counter

import duckdb
import numpy as np
import xxhash
from pyspark.sql import functions as F

from siftline.llm import licence_scan as L
from siftline.llm import order_minhash as O
from siftline.llm import quality_rules as Q
from tests.conftest import SF
from tests.llm.conftest import odd_rows
from tests.oracle import same, tables

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_rules_equal_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    same(Q.quality_rules(docs).select("doc_id", *NAMES), tables(SF), Q.oracle_sql())


def test_rules_odd_documents(spark, odd, empty):
    got = Q.quality_rules(odd)
    assert set(odd.columns) <= set(got.columns)
    for r in got.collect():
        text = r.text or ""
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        places = {i + k for i, g in enumerate(grams) for k in range(5) if len(grams) < 4000 and grams.count(g) > 1}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)))
        if len(grams) < 4000:
            assert r.n_repeat_words == len(places)
        assert r.base_failed == (len(w) < 10 or 100 * r.n_repeat_words > 20 * len(w))
        assert not (r.kept and r.base_failed)
    assert Q.quality_rules(empty).collect() == []
    good = Q.keep_good(odd)
    assert good.dtypes == odd.dtypes
    rest = [c for c in odd.columns if c not in ("text", "n_chars")]
    assert {tuple(r) for r in good.select(rest).collect()} <= {tuple(r) for r in odd.select(rest).collect()}
    assert all(r.n_chars == len(r.text) for r in good.collect())


def test_rules_keep_columns_of_any_name(spark):
    body = "Plain prose of a calm kind goes on and on here, and it ends.\n\nhome | about | login | help\nMore of it comes here."
    docs = spark.createDataFrame([(1, body, "k", "v", "w", "l", 7)], "doc_id long, text string, kept string, verdict string, words string, lines string, `n.chars` int")
    (row,) = Q.keep_good(docs).collect()
    assert tuple(row) == (1, "Plain prose of a calm kind goes on and on here, and it ends.\n\nMore of it comes here.", "k", "v", "w", "l", 7)


def test_rules_read_long_texts_whole(spark):
    """Repeats of a text of many windows, counted by a dictionary."""
    r = random.Random(9)
    w = [r.choice("abcdefghij") * r.randint(1, 3) for _ in range(40_000)]
    grams = Counter(zip(*(w[i:] for i in range(5)), strict=False))
    places = {i + k for i, g in enumerate(zip(*(w[i:] for i in range(5)), strict=False)) if grams[g] > 1 for k in range(5)}
    (row,) = Q.quality_rules(spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")).collect()
    assert row.n_repeat_words == len(places)


def test_rules_reject_what_loses_its_lines(spark):
    good = "Plain prose of a calm kind goes on and on here, and it ends.\n" * 1 + "Another sentence that says something else altogether ends too."
    bad = "home | about | login | help | news\n" * 1 + "one | two | three | four | five six seven\n" + "Short good line ends here."
    shout = "THIS WHOLE LINE IS SHOUTED AT ALL OF US FOREVER AND EVER!!\nQuiet end of it."
    got = {r.doc_id: r for r in Q.quality_rules(spark.createDataFrame([(1, good), (2, bad), (3, shout)], "doc_id long, text string")).collect()}
    assert got[1].kept and not got[2].kept and not got[3].kept
    assert got[2].clean_text == "Short good line ends here."


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def xx(values: list, seed: int = 42) -> int:
    """Spark's xxhash64 of longs, ints (as 32 bits) and strings, chained."""
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(data, seed & (1 << 64) - 1)
    return signed(seed)


def slow_sketch(text: str, k: int = O.K, size: int = O.TUPLE_SIZE) -> list[int]:
    h = [xx([w]) for w in WORD.findall(text)]
    if not h:
        return []
    if len(h) >= k:
        kmers = [xx(h[i : i + k]) for i in range(len(h) - k + 1)]
    else:
        a = k
        for x in h:
            a = xx([a, x])
        kmers = [a]
    seen: dict = {}
    entries = []
    for i, m in enumerate(kmers):
        n = seen[m] = seen.get(m, -1) + 1
        entries.append(((xx([m, (n,)]) & (1 << 64) - 1) >> 29, i))
    bins: dict = {}
    for e in sorted(entries):
        bins.setdefault(e[0] >> 30, []).append(e)
    out = []
    for b, mine in sorted(bins.items()):
        a = 0
        for place in sorted(p for _, p in mine[:size]):
            a = xx([a, kmers[place]])
        out.append(b << 27 | (a & (1 << 64) - 1) >> 37)
    return out


def check_fingerprints(docs):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    named = sorted((r for r in rows if r[0] is not None), key=lambda r: (-r[0], r[1].encode()))
    want = []
    for i, (doc, text) in enumerate(named + [r for r in rows if r[0] is None]):
        after = named[(i + 1) % len(named)][1] if doc is not None else ""
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        a, b, c = slow_sketch(text), slow_sketch(edited), slow_sketch(after)
        like = lambda x, y: len(set(x) & set(y)) / len({v >> 27 for v in x + y}) if x or y else 1.0
        spell = lambda x: "".join(f"{v:08x}" for v in x)
        want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), spell(a), spell(b), like(a, b), like(a, c)))
    got = O.order_minhash_report(docs).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_fingerprints_of_documents(spark):
    check_fingerprints(spark.read.parquet(f"{SF}/documents.parquet"))


def test_fingerprints_of_odd_documents(spark, odd, empty):
    check_fingerprints(odd)
    assert O.order_minhash_report(empty).collect() == []
    check_fingerprints(odd.filter("doc_id = 0"))


def test_fingerprints_feel_order(spark):
    words = [f"w{i}" for i in range(400)]
    swapped = words[200:] + words[:200]
    rows = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(swapped)), (3, " ".join(words[:390] + ["x"] * 10))], "id long, t string").select("id", O.sketch(F.col("t")).alias("s")).collect()
    s = {r.id: set(r.s) for r in rows}
    assert len(s[1] & s[3]) > len(s[1] & s[2])


def test_likeness_falls_with_edit_distance(spark):
    """Mean likeness of texts to their edits (words replaced, dropped or put in), and to their shuffled blocks."""
    r = random.Random(11)
    texts, edits = [], [0, 4, 16, 64, 256]
    for _ in range(12):
        words = [f"w{r.randint(0, 2000)}" for _ in range(500)]
        for n in edits:
            other = list(words)
            for _ in range(n):
                i, kind = r.randrange(len(other)), r.randrange(3)
                other[i : i + (kind < 2)] = ["x%d" % r.randint(0, 10**6)] * (kind != 1)
            texts.append((n, " ".join(words), " ".join(other)))
        blocks = [words[i : i + 25] for i in range(0, 500, 25)]
        r.shuffle(blocks)
        texts.append((-1, " ".join(words), " ".join(w for b in blocks for w in b)))
    rows = spark.createDataFrame(texts, "n int, a string, b string").select("n", O.sketch(F.col("a")).alias("a"), O.sketch(F.col("b")).alias("b")).collect()
    like = {n: np.mean([len(set(r.a) & set(r.b)) / len({v >> 27 for v in (*r.a, *r.b)}) for r in rows if r.n == n]) for n in (*edits, -1)}
    assert like[0] == 1
    assert all(like[a] > like[b] for a, b in zip(edits, edits[1:], strict=False)), like
    kept = lambda r: len({*zip(*(r.split()[i:] for i in range(3)), strict=False)})
    sets = np.mean([len({*zip(*(a.split()[i:] for i in range(3)), strict=False)} & {*zip(*(b.split()[i:] for i in range(3)), strict=False)}) / kept(a) for n, a, b in texts if n == -1])
    assert sets > 0.85 and like[-1] < 0.75 * sets  # most 3-word runs are still there, in another order


def test_licences_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in L.scan_licences(docs).collect()}
    assert len(got) == docs.count()
    pattern = {"apache-2.0": "Apache License, Version 2.0", "mit": "MIT License", "gpl-3.0": "GNU General Public License, version 3", "cc-by-nc": "CC BY-NC 4.0"}
    for r in docs.collect():
        want = sorted(f for f, p in pattern.items() if p in r.text)
        assert got[r.doc_id].families == ",".join(want)
        assert (got[r.doc_id].licence == "unknown") == (not want)


def slow_verdict(line: str) -> tuple[int, float, float]:
    w, bias = L.fitted()
    words = L.tokens(line)
    z = bias + w[L.buckets(words)].sum(0)
    z = np.exp(z - z.max())
    k = int(z.argmax())
    mine = {L.hashed(g) for n in (1, 2, 3) for g in L.grams(words, n)}
    shares = [len(mine & set(t)) / len(t) for t in ([L.shingles(t) for t in L.TEMPLATES[L.FAMILIES[k - 1]]] if k else [])]
    return k, float(z.max() / z.sum()), max(shares, default=0.0)


def test_licence_classifier_equals_plain_python(spark):
    lines = ["Released under the MIT License. Thanks!", "the license plate of the car", "x Licensed under CC BY-SA 4.0. y", "copyright", "Redistribution and use in source and binary forms, with or without modification, are permitted", "SPDX-License-Identifier: GPL-2.0-only", "GPL"]
    got = spark.createDataFrame([(x,) for x in lines], "s string").select("s", L.paragraph_verdict(F.col("s"), L.LIMITS).alias("v")).collect()
    for r in got:
        k, p, share = slow_verdict(r.s)
        assert r.v.kind == k
        assert abs(r.v.p - p) < 1e-9
        assert abs(r.v.share - share) < 1e-12


def test_licence_classifier_held_out():
    x, y = L.sentences(600, 77)
    w, bias = L.fitted()
    guess = np.array([(bias + w[b].sum(0)).argmax() for b in x])
    assert (guess == y).mean() > 0.95


WRAPPED = {
    "mit": "The software\n\n * Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the \"Software\"), to deal\n * in the Software without restriction, including without limitation the rights\n * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice\n",
    "gpl-3.0": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n",
    "zlib": "This software is provided 'as-is', without any express or implied\nwarranty.  In no event will the authors be held liable for any damages\narising from the use of this software.\n",
    "epl-2.0": "/*\n * This program and the accompanying materials are made\n * available under the terms of the Eclipse Public License 2.0\n * which is available at https://www.eclipse.org/legal/epl-2.0/\n */\n",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n",
}


def test_no_template_is_confirmed_without_a_stem():
    """However a window is made up: the 3-grams without a stem are too few in every template."""
    for ts in L.TEMPLATES.values():
        for t in ts:
            g = L.template_grams(t)
            bare = [x for x in g if not any(s in w for w in x.split() for s in L.stems())]
            assert len(bare) < L.LIMITS["confirmed"] * len(g)
    assert all(" " not in s for s in L.stems())


def test_stems_change_no_verdict(spark, monkeypatch):
    """Against the same scan with every window scored."""
    rows = [*WRAPPED.values(), *L.PROSE, *L.OTHER_PROSE, "plain words of no note", *(" ".join(L.tokens(t)[: 3 * len(L.tokens(t)) // 4]) for ts in L.TEMPLATES.values() for t in ts)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    names = ["doc_id", "n_licensed", "families", "licence", "probability"]
    got = sorted(map(tuple, L.scan_licences(docs).select(names).collect()))
    monkeypatch.setattr(L, "stems", lambda confirmed=0: ("",))
    assert got == sorted(map(tuple, L.scan_licences(docs).select(names).collect()))


def test_recall_and_false_alarms(spark):
    """Windows of notices of another source, and prose that mentions licences."""
    texts = [(t, f) for f, ts in L.TEMPLATES.items() for t in ts] + [("Copyright 2020 Foo Inc. All rights reserved.", "proprietary"), ("// SPDX-License-Identifier: MIT OR Apache-2.0", "mit"), ("/* Distributed under the Boost Software License, Version 1.0.\n   (See accompanying file LICENSE_1_0.txt) */", "bsl-1.0")]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate((*L.PROSE, *L.OTHER_PROSE))], "doc_id long, text string")
    got = {r.doc_id: r.licence for r in L.scan_licences(docs).collect()}
    missed = [(t, f, got[i]) for i, (t, f) in enumerate(texts) if got[i] != f]
    assert len(missed) <= 0.05 * len(texts), missed
    assert all(v == "unknown" for i, v in got.items() if i >= 1000)


def test_licences_of_wrapped_notices(spark):
    narrow = {f: "\n".join(re.sub(r"((?:\S+ ){4})", r"\1\n", line) for line in t.split("\n")) for f, t in WRAPPED.items()}
    rows = [(f, k, t) for k, texts in enumerate((WRAPPED, narrow, {f: "before it\n" + t + "after it" for f, t in WRAPPED.items()})) for f, t in texts.items()]
    got = L.scan_licences(spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(rows)], "doc_id long, text string")).collect()
    assert {(rows[r.doc_id][:2], r.licence) for r in got} == {((f, k), f) for f, k, _ in rows}
    assert all(r.n_licensed == 1 for r in got)


def test_licences_of_odd_documents(spark, odd, empty):
    got = L.scan_licences(odd).collect()
    assert len(got) == len(odd_rows())
    assert {r.doc_id: r.licence for r in got if r.licence != "unknown"} == {13: "apache-2.0"}
    assert L.scan_licences(empty).collect() == []


def test_sql_text_runs():
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    assert con.execute(Q.oracle_sql()).fetchall() == []


def test_native_plans_have_no_python(spark, odd):
    for df in (Q.quality_rules(odd), O.order_minhash_report(odd), L.scan_licences(odd)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
