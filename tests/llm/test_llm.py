"""The training-data operators against brute force, on a small scale and on awkward rows."""

import hashlib
import random
import re
import textwrap

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from corpusmill.llm import golay, op1_sharding, op2_lines, op3_mixing, op4_licenses, op5_passages, op6_simhash, op7_warc, op8_quality, op9_suffix_dedup, op10_decontaminate
from corpusmill.llm.common import components
from corpusmill.llm.suffixes import byte_order, front_code, merge_runs
from tests.conftest import SMALL
from tests.test_queries import agree

AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, component_id string, size string, shard string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing column names."""
    texts = [(1, None, "en", None), (2, "", None, "b"), (3, " \t\n", "en", "b"), (4, "a", "en", "b"), (5, "a", "en", "b"), (6, LONG, "en", "é"), (7, LONG, "de", "é"), (7, LONG, "de", "é"), (None, "some text without an id", "en", "z"), (8, "İß x\u0000y " * 30, "fr", "z")]
    return spark.createDataFrame([(i, t, lang, s, None, "x", "y", "z") for i, t, lang, s in texts], AWKWARD)


def empty(spark):
    return spark.createDataFrame([], AWKWARD)


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.mark.parametrize("module,name", [(op1_sharding, "op1_sharding"), (op3_mixing, "op3_mixing"), (op4_licenses, "op4_licenses"), (op7_warc, "op7_warc"), (op8_quality, "op8_quality")])
def test_query_agrees_with_sql(spark, module, name):
    agree(spark, module.QUERIES[name], module.ORACLES[name])


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute_components({x for e in edges for x in e}, edges)
    assert got == {n: c for n, c in want.items() if n in got}
    assert {n for n in want if n not in got} == {n for n in want if all(a == b for a, b in edges if n in (a, b))}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lookup_table():
    names = op1_sharding.shard_names(7)
    owners = op1_sharding.lookup_table(names, 101)
    # brute force: the same turns over explicit preference lists
    lists = []
    for n in names:
        offset, stride = op1_sharding.preference(n, 101)
        lists.append([(offset + j * stride) % 101 for j in range(101)])
        assert sorted(lists[-1]) == list(range(101))
    want, left = {}, [iter(x) for x in lists]
    while len(want) < 101:
        for i, it in enumerate(left):
            if len(want) < 101:
                want[next(s for s in it if s not in want)] = i
    assert [want[s] for s in range(101)] == owners
    fewer = op1_sharding.lookup_table(names[:-1], 101)
    assert sum(a != b for a, b in zip(owners, fewer) if a != 6) < 30
    with pytest.raises(ValueError):
        op1_sharding.lookup_table(names, 100)


def test_sharding_awkward(spark):
    got = op1_sharding.assign_shards(awkward(spark), op1_sharding.shard_names(4), 101)
    rows = got.collect()
    assert len(rows) == 10 and {r.shard for r in rows} <= set(range(4)) and len({r.shard for r in rows if r.doc_id == 7}) == 1
    assert op1_sharding.assign_shards(empty(spark), ["a"], 101).count() == 0


def normal(line):
    return regex.sub(r"[^\p{L}\p{N}]+", " ", line.lower()).strip(" ")


def line_blocks(norm):
    """[(SimHash, number of words)] of the 5 blocks of distinct words: a block is named by where the signed hash lies in the range of longs."""
    own = [[] for _ in range(op2_lines.BLOCKS)]
    for w in set(norm.split(" ")):
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        own[((h + (1 << 63)) % (1 << 64)) * op2_lines.BLOCKS >> 64].append(h)
    at = [op2_lines.LANE_BITS * i + j for i in range(op2_lines.LANES) for j in range(op2_lines.ROUNDS)]
    return [(tuple(2 * sum(h >> j & 1 for h in x) > len(x) for j in at), len(x)) for x in own]


def lines_meet(x, y):
    same = [n for (b, n), other in zip(x, y) if (b, n) == other]
    same.sort(reverse=True)
    return len(same) >= 2 and sum(same[:2]) >= 8 or len(same) >= 3 and sum(same[:3]) >= 3


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def alike(a, b):
    if max(a.count(" "), b.count(" ")) >= 9:
        a, b = a.split(" "), b.split(" ")
    most = 0.2 * max(len(a), len(b)) + 1e-9
    return abs(len(a) - len(b)) <= most and edits(a, b) <= most


def brute_lines(texts):
    """{(doc, line): (first doc, first line, kept)} and the number of links."""
    places = {}
    for d, t in texts:
        for i, line in enumerate(t.split("\n")):
            if normal(line):
                places.setdefault(normal(line), []).append((d, i))
    names = list(places)
    links = [(min(places[a]), min(places[b])) for i, a in enumerate(names) for b in names[:i] if alike(a, b)]
    group = brute_components({min(p) for p in places.values()}, links)
    return {p: (*group[min(ps)], group[min(ps)] == p) for ps in places.values() for p in ps}, len(links)


def found_lines(spark, texts):
    rows = op2_lines.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string").repartition(5)).collect()
    return {(r.doc_id, r.line_no): (r.first_id, r.first_line, r.kept) for r in rows}


BASES = [s.split() for s in (
    "the quick brown fox jumps over the lazy dog while forty seven other animals look on from the shade of an old oak tree near the river bank",
    "user 17 logged in at noon from the north gate",
    "in the year of the cat we went to the sea and to the hills and to the old town by the lake where the fair was held for three days and nights",
)]


def test_lines_against_brute_force(spark):
    rng, texts = random.Random(3), []
    for i in range(90):
        words = list(BASES[i % 3])
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = rng.sample(["cat", "mouse", "river", "12", "of", words[at] + "s"], rng.randrange(3))
        texts.append((i, "\n".join([" ".join(words).capitalize() + ".", "Short.", "unique line number %d of them" % i, "", "SHORT!"])))
    want, links = brute_lines(texts)
    assert links > 100 and found_lines(spark, texts) == want
    kept = {r.doc_id: r.text for r in op2_lines.without_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert kept[5].split("\n")[-1] == "" and "unique line number 0 of them" in kept[0]


def test_lines_of_many_words(spark, monkeypatch):
    rng = random.Random(8)
    base, texts = [f"w{rng.randrange(9000)}" for _ in range(1700)], []
    for i, n in enumerate((130, 260, 700, 1270, 1400, 1700)):  # the last ones' blocks have more words than fit a narrow counter
        for k in range(3):
            words = base[:n]
            for _ in range(k):
                words[rng.randrange(n)] = f"new{rng.randrange(100)}"
            texts.append((10 * i + k, " ".join(words)))
    want, links = brute_lines(texts)
    monkeypatch.setattr(op2_lines, "BROADCAST_ROWS", 0)  # candidates' texts by a shuffle
    assert links >= 4 and found_lines(spark, texts) == want


def test_lines_of_large_groups_that_meet(spark):
    """Groups of near copies whose lines share blocks, some of them alike and some not."""
    rng, texts = random.Random(9), []
    common = [f"c{i}" for i in range(14)]
    tails = [[f"{name}{'x' * 6}{i}" for i in range(6)] for name in "abc"] + [[f"d{i}" for i in range(2)]]
    for i in range(160):
        words = common + tails[i % 4]
        words[rng.randrange(14, len(words))] = f"n{rng.randrange(60)}"
        texts.append((i, " ".join(words)))
    want, links = brute_lines(texts)
    assert links > 1000 and len({w[0] for w in want.values()}) > 1 and found_lines(spark, texts) == want


def test_lines_recall(spark):
    """Of lines with edits, how many are joined with their original: no loss for one word, and stated shares for more."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9)))
    texts, want = [], {}
    for i in range(900):
        n, k = (10, 20, 40)[i % 3], i // 3 % 3 + 1
        line = [word() for _ in range(n)]
        edited = list(line)
        for at in rng.sample(range(n), k):
            edited[at] = word()
        if alike(" ".join(line), " ".join(edited)):
            texts += [(2 * i, " ".join(line)), (2 * i + 1, " ".join(edited))]
            want.setdefault((n, k), []).append(i)
    got = found_lines(spark, texts)
    recall = {key: sum(not got[2 * i + 1, 0][2] for i in own) / len(own) for key, own in want.items()}
    assert all(recall[n, 1] == 1 for n in (10, 20, 40)) and recall[40, 2] > 0.7 and recall[40, 3] > 0.3, recall


def test_no_similar_lines_are_left_out(spark):
    """Against edit similarity alone, whatever blocks lines share: 1 to 40 words, edits of words and of characters up to the threshold."""
    rng, texts = random.Random(11), []
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    for i in range(130):
        words = [word() for _ in range((1, 2, 3, 5, 8, 9, 10, 11, 15, 40)[i % 10])]
        for _ in range(2):
            edited = list(words)
            if i % 3:
                for _ in range(rng.randrange(1 + max(1, len(words) // 5))):
                    at = rng.randrange(len(edited))
                    edited[at : at + rng.randrange(2)] = [word() for _ in range(rng.randrange(2))]
            line = list(" ".join(edited))
            for _ in range(rng.randrange(1 + len(line) // 5) if i % 3 != 1 and len(words) < 10 else 0):
                at = rng.randrange(len(line))
                line[at : at + rng.randrange(2)] = rng.choice(["", "e", " ", "ab"])
            texts.append((len(texts), "".join(line)))
    # one common word, which comes last in the order or first
    texts += [(1000 + i, "é " * 11 + f"x{i} y{i % 7} z{i % 5}") for i in range(30)]
    names = sorted({normal(t) for _, t in texts} - {""})
    near = [(a, b) for i, a in enumerate(names) for b in names[:i] if alike(a, b)]
    missed = [(a, b) for a, b in near if not lines_meet(line_blocks(a), line_blocks(b))]
    first = {}
    for i, t in texts:
        first.setdefault(normal(t), i)
    group = brute_components({i for n, i in first.items() if n}, [(first[a], first[b]) for a, b in near])
    assert len(missed) > 50
    got = found_lines(spark, texts)
    assert {i: x[0] for (i, _), x in got.items()} == {i: group[first[normal(t)]] for i, t in texts if normal(t)}


def test_short_lines_meet_only_if_similar(spark):
    """Pairs of short lines are compared where they meet: none that is unlike goes on to a shuffle, and none that is similar is missing."""
    rng = random.Random(12)
    texts = [(i, " ".join(rng.choice(["the", "then", "other", "there", "hen"]) for _ in range(rng.randrange(2, 9)))) for i in range(150)]
    rows = op2_lines.lines(spark.createDataFrame(texts, "doc_id long, text string")).withColumn("all_words", F.size("hashes"))
    pairs = op2_lines.short_pairs(rows, spark.createDataFrame([], "node string, component string")).collect()
    line = {r.h: r.line for r in rows.collect()}
    names = sorted(set(line.values()))
    want = {(a, b) for i, b in enumerate(names) for a in names[:i] if alike(a, b)}
    assert len(want) > 20 and {tuple(sorted((line[r.a], line[r.b]))) for r in pairs} == want


def test_lines_awkward(spark):
    rows = op2_lines.dedup_lines(awkward(spark)).collect()
    assert sorted((r.doc_id or 0, r.kept) for r in rows) == [(0, True), (4, True), (5, False), (6, True), (7, False), (7, False), (8, True)]
    assert op2_lines.dedup_lines(empty(spark)).count() == 0


def test_mixing_awkward(spark):
    rows = op3_mixing.mix(awkward(spark), op3_mixing.weights(), op3_mixing.slopes()).collect()
    assert len(rows) == 10
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and r.positions == sorted(r.positions)
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1 and sum(r.size for r in own) == own[0].source_size
    assert op3_mixing.mix(empty(spark), op3_mixing.weights(), op3_mixing.slopes()).count() == 0


def test_mixing_targets_against_iterated_sharing(spark):
    sizes = {"a": 1000, "b": 10, "c": 10, "d": 5, "e": 400, None: 3}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in op3_mixing.source_targets(df, op3_mixing.weights()).collect()}
    order = sorted((s for s in sizes if s), key=str) + [None]
    weight, target, total = {s: i % 3 + 1 for i, s in enumerate(order)}, {}, sum(sizes.values())
    left = set(order)
    while left:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * sizes[s]]
        target |= {s: 3.0 * sizes[s] for s in over} if over else share
        left -= set(over) if over else left
    assert all(abs(got[s] - target[s]) < 1e-6 for s in order)


def test_licences(spark):
    texts = ["Foo bar.\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "Licensed under the Apache License, Version 2.0. And: released under the MIT license", "nothing"]
    rows = op4_licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert rows[0].licence_sentences == ["mit_grant", "mit_notice"] and rows[0].licences == []  # the third sentence of the rule is missing
    assert rows[1].licences == ["Apache-2.0", "MIT"] and rows[2].licences == []
    assert op4_licenses.scan(awkward(spark)).where(F.size("licences") > 0).count() == 0
    assert op4_licenses.scan(empty(spark)).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE."""
BSD = """Copyright (c) 2001, Somebody
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."""
GPL2 = GPL.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")


@pytest.mark.parametrize("end", ["\n", "\r\n", "\n * "])
@pytest.mark.parametrize("width", [40, 78, 10_000])
def test_licences_in_wrapped_texts(spark, width, end):
    wrapped = [end.join(line for part in text.split("\n") for line in textwrap.wrap(part, width) or [""]) for text in (MIT, BSD, GPL, GPL2)]
    rows = op4_licenses.scan(spark.createDataFrame(list(enumerate(wrapped)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [r.licence_sentences for r in rows] == [
        ["mit_grant", "mit_notice", "as_is"], ["reserved", "bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"],
        ["gpl_free_software", "gpl_warranty"], ["gpl2_free_software", "gpl_warranty"],
    ]
    assert [r.licences for r in rows] == [["MIT"], ["BSD-3-Clause", "LicenseRef-Reserved"], ["GPL-3.0-or-later"], ["GPL-2.0-or-later"]]


def test_licence_sentences_end_at_blank_lines(spark):
    texts = ["released under\n\nthe MIT license", "released under\nthe MIT license", "we released under\nthe MIT license", "All rights reserved\nand more", "x\n\n\nall\nrights\nreserved\nall rights reserved"]
    rows = op4_licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [r.licence_sentences for r in rows] == [[], ["mit_release"], [], ["reserved"], ["reserved", "reserved"]]


ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
AGPL = GPL.replace("GNU General Public License as", "GNU Affero General Public License as")
LGPL = GPL.replace("This program", "This library").replace("GNU General Public License as", "GNU Lesser General Public License as").replace("version 3", "version 2.1")
TEXTS = {
    "MIT": MIT, "BSD-3-Clause LicenseRef-Reserved": BSD, "GPL-3.0-or-later": GPL, "GPL-2.0-or-later": GPL2, "ISC": ISC, "Zlib": ZLIB, "MPL-2.0": MPL, "AGPL-3.0-or-later": AGPL, "LGPL-2.1-or-later": LGPL,
    "Apache-2.0": "// SPDX-License-Identifier: Apache-2.0", "CC0-1.0": "x\n# SPDX-License-Identifier: CC0-1.0\ny",
}


@pytest.mark.parametrize("end", ["\n", "\n// ", " "])
def test_licence_sql_follows_the_same_rule(spark, end):
    """Wrapped, commented and flat forms: all licences are named, and the SQL has the same rows."""
    import duckdb
    import pandas as pd

    texts = [end.join(line for part in text.split("\n") for line in textwrap.wrap(part, 60) or [""]) for text in TEXTS.values()]
    texts += ["all rights reserved. all rights reserved; all\n\nrights reserved", "released under\n\nthe MIT license", " ".join(texts), "\n\n".join(texts), "", None, "No. All rights reserved "]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    scanned = op4_licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).where(F.size("licence_sentences") > 0)
    got = {r.doc_id: (len(r.licence_sentences), " ".join(r.licence_sentences), " ".join(r.licences)) for r in scanned.collect()}
    with duckdb.connect() as con:
        con.register("documents", docs)
        want = {r[0]: r[1:] for r in con.execute(op4_licenses.ORACLES["op4_licenses"]).fetchall()}
    assert got == want
    # run together with other words, a tag line or a notice after a name is no sentence
    names = [n if end != " " else n.removesuffix(" LicenseRef-Reserved").replace("CC0-1.0", "") for n in TEXTS]
    assert [got.get(i, (0, "", ""))[2] for i in range(len(TEXTS))] == names


def test_passages(spark):
    rng = random.Random(5)
    words = lambda n: [f"t{rng.randrange(10**6)}" for _ in range(n)]
    shared, docs = words(90), []
    for i in range(80):
        part = list(shared)
        for _ in range(i % 4):
            part[rng.randrange(len(part))] = "edited"
        docs.append((i, " ".join(words(40) + part + words(40))))
    docs += [(100 + i, " ".join(words(200))) for i in range(5)]
    rows = op5_passages.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = {r.doc_id for r in rows} | {r.other_id for r in rows}
    assert found == set(range(80))
    assert all(r.start <= 41 and r.end >= 128 and r.similarity >= 0.8 for r in rows) and len(rows) <= 80 * 79 // 2
    assert op5_passages.passages(empty(spark)).count() == 0
    pairs = {(r.other_id, r.doc_id) for r in op5_passages.passages(awkward(spark)).collect()}
    assert {(6, 7), (6, 6), (7, 7)} == pairs  # the long text repeats its own words too


def test_passages_between_partial_copies(spark):
    rng = random.Random(14)
    words = lambda n: [f"t{rng.randrange(10**6)}" for _ in range(n)]
    whole = words(60)
    parts = [whole, whole[:38], whole[22:], whole]
    rows = op5_passages.passages(spark.createDataFrame([(i, " ".join(words(30) + p + words(30))) for i, p in enumerate(parts)], "doc_id long, text string")).collect()
    assert {(r.other_id, r.doc_id) for r in rows} == {(0, 3)} and [r.n_matches for r in rows] == [60]
    # two places in one document, and a stray occurrence of some words before both
    rows = op5_passages.passages(spark.createDataFrame([(1, " ".join(whole[10:20] + words(50) + whole + words(50) + whole))], "doc_id long, text string")).collect()
    assert [(r.other_start, r.other_end, r.start, r.end) for r in rows] == [(60, 120, 170, 230)]


def changed(rng, words, how):
    if how == "indels":
        return [x for w in words for x in ([] if rng.random() < 0.04 else [w, "more"] if rng.random() < 0.04 else [w])]
    if isinstance(how, int):
        return [f"x{rng.randrange(10**6)}" if i % how == how - 1 else w for i, w in enumerate(words)]
    return [f"x{rng.randrange(10**6)}" if rng.random() < how else w for w in words]


def test_passages_recall(spark):
    """Passages with every n-th word, or random ones, replaced; those that brute force finds to be similar enough are found."""
    rng, docs, cases = random.Random(13), [], {}
    common = ["the", "of", "and", "to", "in", "a", "is", "that"]
    words = lambda n: [rng.choice(common) if rng.random() < 0.4 else f"t{rng.randrange(10**5)}" for _ in range(n)]
    for how in (5, 6, 8, 10, 12, 16, 0.05, 0.1, 0.15, 0.18, "indels"):
        for n in (50, 120):
            for _ in range(25):
                passage, i = words(n), len(docs)
                docs += [(i, " ".join(words(60) + passage + words(60))), (i + 1, " ".join(words(30) + changed(rng, passage, how) + words(30)))]
                cases.setdefault((how, n), []).append(i)
    rows = op5_passages.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    texts = {i: t.split() for i, t in docs}
    for r in rows:
        if r.end - r.start == r.other_end - r.other_start and r.similarity == 1:
            assert texts[r.doc_id][r.start : r.end] == texts[r.other_id][r.other_start : r.other_end]
    found = {(r.other_id, r.doc_id) for r in rows}
    recall = {}
    for case, own in cases.items():
        real = own if case[0] == "indels" else [i for i in own if (best := brute_overlap(texts[i], texts[i + 1])) and -best[1] >= op5_passages.MIN_WORDS]
        recall[case] = (round(sum((i, i + 1) in found for i in real) / max(1, len(real)), 2), len(real))
    # at the limit of similarity itself (every fifth word) short passages have few seeds in common
    assert all(share >= (0.75 if case == (5, 50) else 0.9) for case, (share, n) in recall.items() if n), recall
    # nothing else is reported but pairs that are similar enough by chance
    assert len(found - {(i, i + 1) for own in cases.values() for i in own}) <= 3


def test_chains_find_the_best_score():
    rng = random.Random(2)
    for _ in range(30):
        points = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(12)})
        a, b = [p[0] for p in points], [p[1] for p in points]
        best = [float(op5_passages.WORDS)] * len(points)
        for i in range(len(points)):
            for j in range(i):
                if a[j] < a[i] and b[j] < b[i]:
                    best[i] = max(best[i], op5_passages.WORDS + best[j] - op5_passages.GAP_COST * (a[i] - a[j] + b[i] - b[j]))
        chain = op5_passages.chains(a, b)[0]
        score = op5_passages.WORDS * len(chain) - op5_passages.GAP_COST * (a[chain[-1]] - a[chain[0]] + b[chain[-1]] - b[chain[0]])
        assert abs(score - max(best)) < 1e-9


def test_golay_code():
    made = golay.tables()
    rng = np.random.default_rng(0)
    v = rng.integers(0, 1 << 23, 4000)
    w = v.copy()
    for _ in range(2):
        w ^= 1 << rng.integers(0, 23, len(w))
    one, two = golay.keys(v, made), golay.keys(w, made)
    assert set((one >= 0).sum(axis=1)) == {1, 6}
    assert all(set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(one, two))


def test_golay_keys_lose_no_pair():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    w = v.copy()
    for _ in range(3):
        w ^= np.uint64(1) << rng.integers(0, 64, len(w)).astype(np.uint64)
    made, shared = golay.tables(), [set(), set()]
    for out, x in zip(shared, (v, w)):
        row, key = op6_simhash.golay_keys(x, made)
        out |= set(zip(row.tolist(), key.tolist()))
    assert {r for r, _ in shared[0] & shared[1]} == set(range(len(v)))


def test_near_duplicates_against_brute_force(spark):
    docs = documents(spark).select("doc_id", "text").collect()
    extra = [(1000 + i, d.text + " tail" * (i % 3)) for i, d in enumerate(docs[:40])]
    rows = [(d.doc_id, d.text) for d in docs] + extra
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op6_simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    def fp(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))

    fps = {i: fp(t) for i, t in rows}
    ids = list(fps)
    group = brute_components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (fps[a] ^ fps[b]).bit_count() <= 3])
    assert got == {i: (f"{fps[i]:016x}", group[i]) for i in ids}


def test_near_duplicates_awkward(spark):
    rows = [(r.doc_id, r.component_id) for r in op6_simhash.near_duplicates(awkward(spark)).collect()]
    assert sorted(rows, key=str) == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 6), (7, 6), (None, None), (8, 8)], key=str)
    assert op6_simhash.near_duplicates(empty(spark)).count() == 0


def test_keys_of_few_classes_are_not_broadcast(spark):
    """Their table is some 40 times as long as the file that Spark knows the size of."""
    classes = op6_simhash.cut(spark.range(3000).selectExpr("id AS rep", "xxhash64(id DIV 2) ^ id % 2 AS fp"))
    links = op6_simhash.class_links(classes)
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()
    assert {(r.a, r.b) for r in links.collect()} == {(i, i + 1) for i in range(0, 3000, 2)}


def test_arc_round_trip():
    blocks = [op7_warc.http_block(b"<p>" + bytes(range(256)), 5), b"dns answer\n\nwith blank lines", b""]
    for version in (1, 2):
        data = op7_warc.version_block("x", version) + b"".join(op7_warc.arc_record(version, u, b, "x", 0) for u, b in zip(("http://a/b c", "dns:a", "https://e/"), blocks))
        for packed in (data, op7_warc.gzipped(data)):
            got = list(op7_warc.arc_records(packed))
            assert [g[5] for g in got] == blocks and got[0][0] == "http://a/b%20c"
        with pytest.raises(ValueError):
            list(op7_warc.arc_records(data[:-300] if version == 1 else data[:-30]))
    head, payload, kind = op7_warc.split_http("http://a/", blocks[0])
    assert kind == "response" and payload == b"<p>" + bytes(range(256)) and op7_warc.http_field(head, "x-page-id") == "5"
    assert op7_warc.split_http("dns:a", blocks[1])[2] == "resource"
    assert op7_warc.warc_date("20240102030405") == "2024-01-02T03:04:05Z" and op7_warc.warc_date("2024") == "2024-01-01T00:00:00Z"


def test_warc_awkward(spark):
    same = "x" * 100
    rows = [(1, "http://a", None), (2, None, ""), (3, "ftp://b", same), (4, "http://c\n", same), (4, "http://c\n", same), (5, "http://d", "x" * 99), (6, "http://e", "x" * 99), (None, "http://f", same), (7, "http://g", "é\r\n\r\nWARC/1.0\r\n" * 20)]
    got = op7_warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=str) == sorted([(1, 0, "response", None), (2, 0, "response", None), (3, 100, "response", None), (4, 100, "revisit", 3), (4, 100, "revisit", 3), (5, 99, "response", None), (6, 99, "response", None), (None, 100, "response", None), (7, 320, "response", None)], key=str)
    assert all(r.payload_digest == hashlib.sha256(("" if r.payload_bytes == 0 else same[: r.payload_bytes] if r.payload_bytes <= 100 else rows[-1][2]).encode()).hexdigest() for r in got)
    assert op7_warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_quality_awkward(spark):
    got = {r.doc_id: r for r in op8_quality.assess(awkward(spark)).collect()}
    assert got[1].n_words == 0 and got[1].base_failed and got[6].n_words == 30_000 and got[6].n_repeat_words == 30_000 and not got[6].kept
    assert op8_quality.assess(empty(spark)).count() == 0
    words = "one two three four five six seven eight nine ten".split()
    text = " ".join(words + ["x%d" % i for i in range(40)] + words[:9])
    assert op8_quality.assess(spark.createDataFrame([(1, text)], "doc_id int, text string")).first().n_repeat_words == 18


def brute_removal(rows):
    seen, out = set(), {}
    for d, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), sum(1 for i in range(len(gone)) if gone[i] and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_against_brute_force(spark):
    rng = random.Random(4)
    chunk = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    shared, rows = [chunk(n) for n in (99, 100, 101, 180, 700)], []
    for i in range(40):
        rows.append((i, chunk(rng.randrange(120)) + "".join(rng.choice(shared)[rng.randrange(40) :] + chunk(rng.randrange(3)) for _ in range(rng.randrange(4)))))
    rows += [(50, "ab" * 400), (51, "x" * 350), (52, "ab" * 300)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op9_suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute_removal([(i, t.encode()) for i, t in rows])


def test_suffix_dedup_of_documents(spark):
    docs = documents(spark)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op9_suffix_dedup.dedup(docs).collect()}
    assert got == brute_removal(sorted((r.doc_id, r.text.encode()) for r in docs.collect()))


def test_suffix_dedup_awkward(spark):
    rows = op9_suffix_dedup.dedup(awkward(spark)).collect()
    by = {r.doc_id: r for r in rows if r.doc_id}
    want = brute_removal([(6, LONG.encode()), (7, LONG.encode())])
    assert len(rows) == 10 and by[1].n_bytes == 0 and (by[6].n_removed, by[7].n_removed) == (want[6][1], want[7][1])
    assert op9_suffix_dedup.dedup(empty(spark)).count() == 0


def test_merge_runs():
    rng = np.random.default_rng(3)
    for runs in (1, 2, 5):
        made, rows = [], []
        for _ in range(runs):
            m = rng.integers(97, 99, (rng.integers(0, 60), 12)).astype(np.uint8)
            lengths = rng.integers(6, 13, len(m))
            m[np.arange(12) >= lengths[:, None]] = 0
            order = byte_order(m)
            m, lengths = m[order], lengths[order]
            shared, rest = front_code(m, lengths)
            made.append((shared, lengths, rest))
            rows.append(m)
        run, known, rank = merge_runs(made, 12)
        got = [bytes(rows[r][k]) for r, k in zip(run, rank)]
        assert got == sorted(bytes(x) for m in rows for x in m)
        for i in range(1, len(got)):
            assert known[i] == next((j for j in range(12) if got[i][j] != got[i - 1][j]), 12)


def test_decontamination(spark):
    rng = random.Random(6)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    item, docs = words(40), [(i, " ".join(words(100))) for i in range(10)]
    edited = list(item)
    for i in (6, 17, 29):
        edited[i] = "other"
    docs += [(20, " ".join(words(30) + item + words(30))), (21, " ".join(words(10) + edited)), (22, " ".join(words(20) + item[:8] + words(20))), (23, " ".join(item[5:20]).upper())]
    items = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "too short")], "item_id long, text string")
    got = {r.doc_id: r for r in op10_decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert set(got) == {20, 21, 23}
    assert (got[20].doc_start, got[20].n_words, got[20].n_matches) == (30, 40, 40) and got[21].n_matches == 37 and got[23].n_matches == 15
    assert op10_decontaminate.contaminated(empty(spark), items).count() == 0
    assert op10_decontaminate.contaminated(awkward(spark), items.limit(0)).count() == 0
    assert op10_decontaminate.contaminated(awkward(spark), items).count() == 0


def brute_overlap(a, b):
    """(matches, -length, -start in a, -start in b) of the best overlap over all diagonals and stretches, or None."""
    best = None
    for d in range(1 - len(b), len(a)):
        pairs = [(i + d, i) for i in range(len(b)) if 0 <= i + d < len(a)]
        hits = [k for k, (i, j) in enumerate(pairs) if a[i] == b[j]]
        for x in range(len(hits)):
            for y in range(x + 9, len(hits)):
                n, m = hits[y] - hits[x] + 1, y - x + 1
                if 5 * m >= 4 * n:
                    best = max(best or (0,), (m, -n, *[-v for v in pairs[hits[x]]]))
    return best


def test_decontamination_against_brute_force(spark):
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    items, docs, want = [], [], {}
    for k in range(240):
        n = (12, 15, 20, 40, 80)[k % 5]
        item, swapped = words(n), rng.random() * 0.25
        copy = [f"x{rng.randrange(10**6)}" if rng.random() < swapped else w for w in item]
        items.append((k, " ".join(item)))
        docs.append((k, " ".join(words(15) + copy + words(15))))
        best = brute_overlap(docs[-1][1].split(), item)
        if best:
            want[k] = best
    # exact words before a long stretch that isn't identical enough
    item = words(120)
    copy = [w if i < 20 or i % 4 else "other" for i, w in enumerate(item)]
    items.append((900, " ".join(item)))
    docs.append((900, " ".join(copy)))
    want[900] = brute_overlap(copy, item)
    assert want[900][0] >= 20 and 100 < len(want) < 241
    found = op10_decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_matches, -r.n_words, -r.doc_start, -r.item_start) for r in found if r.doc_id == r.item_id} == want


def test_masks_hit_every_overlap():
    masks, span = [int(m, 2) for m in op10_decontaminate.MASKS], max(map(len, op10_decontaminate.MASKS))
    # strings of matches (1) and mismatches (0) that no mask hits: the best score, 1 for a match and -4 for a
    # mismatch, by the last bits and the number of matches; one that falls under -60 has no part in an overlap
    best = {(0, 0): 0}
    while best:
        longer = {}
        for (bits, m), score in best.items():
            for bit in (0, 1):
                now, state = (bits << 1 | bit) & ((1 << span) - 1), score + (1 if bit else -4)
                if state >= -60 and not any(now & mask == mask for mask in masks):
                    name = (now & ((1 << span - 1) - 1), min(10, m + bit))
                    longer[name] = max(longer.get(name, state), state)
        assert not any(m == 10 and score >= 0 for (_, m), score in longer.items())
        best = longer


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as cp

    docs = documents(spark)
    good = cp.quality(spark, docs, SMALL)
    kept = {r.doc_id for r in op8_quality.query(spark, SMALL).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept
    one = cp.near_dedup(spark, good, SMALL)
    assert {r.doc_id for r in one.collect()} == {r.component_id for r in op6_simhash.near_duplicates(good).collect()}
    clean = cp.decontaminate(spark, one, SMALL)
    leaks = {r.doc_id for r in op10_decontaminate.query(spark, SMALL).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - leaks
    mixed = cp.mix_sources(spark, clean, SMALL)
    plan = op3_mixing.mix(clean, op3_mixing.weights(), op3_mixing.slopes())
    assert mixed.count() == plan.agg(F.sum("passes")).first()[0] and mixed.columns == docs.columns
    done = cp.shard(spark, mixed, SMALL)
    assert done.count() == mixed.count() and done.columns == [*docs.columns, "shard"]
    for f in (cp.quality, cp.near_dedup, cp.decontaminate, cp.mix_sources, cp.shard):
        assert f(spark, docs.limit(0), SMALL).count() == 0
    rows = cp.near_dedup(spark, awkward(spark), SMALL).collect()
    assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 4, 6, 8]


def test_near_dedup_of_rows_that_share_a_doc_id(spark):
    import corpus_pipeline as cp

    rng = random.Random(12)
    t, u, v, w = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(4))
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(3, t), (5, t), (5, u), (7, v), (7, w), (7, w), (8, w), (9, t), (9, v), (None, t)]
    kept = cp.near_dedup(spark, spark.createDataFrame([(i, x, "en", "a", 1) for i, x in rows], kind), SMALL)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(0, t), (3, t), (5, u), (7, v), (7, w)])


def test_pipeline_stages_on_awkward_rows(spark):
    """Nulls, empty and very long texts, repeated rows, and columns that have an operator's own names."""
    import corpus_pipeline as cp

    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").limit(2).collect()]
    good = documents(spark).orderBy("doc_id").limit(40).collect()
    kind = "doc_id long, text string, lang string, source string, n_chars long, size int, positions string, n_words int, kept string, taken string, _m string, _gone string"
    texts = [(r.doc_id, r.text) for r in good] + [(None, items[0]), (900, items[1]), (900, good[0].text + " more"), (901, None), (902, ""), (903, LONG), (None, None)]
    rows = [(i, t, "en", s, 3, 99, "mine", 7777, "orig", "t", "m", "g") for k, (i, t) in enumerate(texts) for s in ((None, "a", "b")[k % 3],)]
    rows += rows[3:5]
    docs = spark.createDataFrame(rows, kind)
    own = [(99, "mine", 7777, "orig", "t", "m", "g")]

    def carried(df):
        assert df.columns == docs.columns
        out = df.collect()
        assert not out or {(r.size, r.positions, r.n_words, r.kept, r.taken, r._m, r._gone) for r in out} == set(own)
        return out

    verdicts = op8_quality.assess(docs.select(F.monotonically_increasing_id().alias("k"), "text")).where("kept").count()
    assert len(carried(cp.quality(spark, docs, SMALL))) == verdicts > 0
    clean = carried(cp.decontaminate(spark, docs, SMALL))
    left = [r.text for r in clean]
    assert items[0] not in left and items[1] not in left and left.count(None) == 2 and left.count("") == 1 and LONG in left
    assert good[0].text + " more" in left or good[0].text not in left  # a row of a contaminated doc_id is judged for itself
    mixed = carried(cp.mix_sources(spark, docs, SMALL))
    plan = op3_mixing.mix(docs.select("doc_id", "source", "text"), op3_mixing.weights(), op3_mixing.slopes()).collect()
    assert len(mixed) == sum(r.passes for r in plan) and all(r.text for r in mixed)
    placed = cp.shard(spark, docs, SMALL).collect()
    assert len(placed) == len(rows) and len({r.shard for r in placed if r.doc_id is None}) == 1
    assert len(cp.near_dedup(spark, docs, SMALL).collect()) <= len(rows)
