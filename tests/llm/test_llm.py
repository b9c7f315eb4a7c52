import collections
import itertools
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.llm import decontaminate, embeddings, graph, licenses, minhash, packing, pages, quality, queries, store, substring, tokencounts, urls

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(60)]
    out = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(1, 120))]
        if i % 5 == 0:
            w[3:3] = passage
        if i % 7 == 1:
            w = [w[0]] * 50 + w
        if i % 9 == 2:
            w = w[:6] * 12
        out.append((i, " ".join(w)))
    out += [(100 + i, out[0][1]) for i in range(5)]  # exact copies
    base = out[1][1].split()
    for i in range(12):  # near copies
        w = list(base)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = word()
        out.append((200 + i, " ".join(w).upper()))
    out += [(300, None), (301, ""), (302, " \n "), (303, "a"), (304, "a"), (305, "a b c"), (306, "x " * 9000)]
    return [(i, t, "en", "s", len(t or "")) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


def test_substring_against_all_windows(spark, docs):
    texts = {r.doc_id: SPLIT.findall(r.text or "") for r in docs.collect()}
    seen = collections.Counter(tuple(w[i : i + 35]) for w in texts.values() for i in range(len(w) - 34))
    got = {r.doc_id: (r.text, r.n_words, r.n_removed) for r in substring.drop_repeats(spark, docs, 35, joined=True).collect()}
    for d, w in texts.items():
        gone = {k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert ((got[d][0] or ""), *got[d][1:]) == (kept, len(w), len(gone)), d


def test_near_duplicates_against_all_pairs(spark, docs):
    sets = {}
    for r in docs.collect():
        w = SPLIT.findall((r.text or "").lower())
        sets[r.doc_id] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.doc_id: r for r in minhash.near_duplicates(spark, docs, 4).collect()}
    assert {d: (got[d].n_shingles, got[d].component_id) for d in sets} == {d: (len(s), find(d)) for d, s in sets.items()}
    left = {r.doc_id for r in minhash.drop_near_duplicates(spark, docs, 4).collect()}
    assert left == {d for d in sets if find(d) == d}


def test_leaks(spark, docs):
    item = " ".join(f"word{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, " ".join(f"other{i}" for i in range(20)))], "item_id long, text string")
    leak = item.replace("word3 ", "Word3, ").replace("word29", "changed")
    more = docs.unionByName(spark.createDataFrame([(900, f"before {leak} after", "en", "s", 1), (900, f"before {leak} after", "en", "s", 1)], DOCS))
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(spark, more, bench).collect()] == [(900, 1)] * 2
    assert decontaminate.drop_contaminated(spark, more, bench).count() == docs.count()


def test_leaks_in_texts_shorter_than_the_item(spark):
    w = [f"word{i}" for i in range(59)]
    bench = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(f"other{i}" for i in range(20)))], "item_id long, text string")
    rows = [(1, " ".join(w[:-1])), (2, " ".join(w[2:-2])), (3, " ".join(w[:40])), (4, "word1 word2"), (5, " ".join(w))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).coalesce(1)
    got = decontaminate.leaks(spark, docs, bench).orderBy("doc_id").collect()
    assert [(r.doc_id, r.item_id, r.start, r.n_words) for r in got] == [(1, 1, 0, 58), (2, 1, 0, 55), (5, 1, 0, 59)]
    assert np.allclose([r.similarity for r in got], [54 / 55, 51 / 55, 1])
    assert [r.doc_id for r in decontaminate.drop_contaminated(spark, docs, bench).orderBy("doc_id").collect()] == [3, 4]


def test_packing_round_trip(spark, docs):
    path = queries.tokenizer_path()
    rows = packing.pack(spark, docs, path, 256).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    for r in docs.collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted((x for x in rows if x.doc_id == r.doc_id), key=lambda x: x.piece)
        assert [(x.start, x.length, x.ids_crc32) for x in mine] == [(k, len(ids[k : k + 256]), zlib.crc32(ids[k : k + 256].tobytes())) for k in range(0, len(ids), 256)]
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        s.sort()
        assert all(o == sum(n for _, n in s[:k]) for k, (o, _) in enumerate(s)) and sum(n for _, n in s) <= 256
    assert len(by) <= -(-sum(r.length for r in rows) // 256) + 1


def test_bin_completion_beats_best_fit():
    lengths = [6, 5, 5, 4, 4, 3, 3] + [7, 3]
    assert len(packing.bin_completion(lengths, 10)) == packing.lower_bound(lengths, 10) == 4


def test_bin_completion_of_long_pieces():
    rng = random.Random(1)
    lengths = [rng.randint(900, 1800) for _ in range(4000)]
    bins = packing.bin_completion(lengths, 4096)
    assert sorted(x for b in bins for x in b) == sorted(lengths) and max(map(sum, bins)) <= 4096
    assert len(bins) < len(packing.best_fit_decreasing(lengths, 4096)) == 1436


def least_bins(lengths, capacity):
    """Brute force: the fewest bins."""
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins)}.values():
            if bins[j] + lengths[i] <= capacity:
                bins[j] += lengths[i]
                go(i + 1, bins)
                bins[j] -= lengths[i]
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best


def test_bin_completion_against_brute_force():
    for seed in range(150):
        rng = random.Random(seed)
        for low, high, n, capacity in ((1, 20, rng.randint(1, 10), 20), (15, 60, 10, 100)):
            lengths = sorted((rng.randint(low, high) for _ in range(n)), reverse=True)
            assert len(packing.bin_completion(lengths, capacity, 100_000)) == least_bins(lengths, capacity)


def test_every_undominated_filling_comes():
    rng = random.Random(3)
    for _ in range(60):
        sizes = sorted(rng.sample(range(1, 30), 7))
        count = {x: rng.randint(1, 2) for x in sizes}
        pieces = [x for x in sizes for _ in range(count[x])]
        every = {tuple(sorted(pieces[i] for i in range(len(pieces)) if m >> i & 1)) for m in range(1 << len(pieces))}
        fits = {c for c in every if sum(c) <= 40}
        whole = {c for c in fits if all(sum(c) + x > 40 for x in sizes if c.count(x) < count[x])}
        got = [tuple(sorted(f)) for batch in packing.fillings(40, sizes, count, steps=5) for _, f in batch]
        assert len(got) == len(set(got)) and set(got) <= whole
        for c in whole - set(got):  # what is left out is dominated: one piece can take the place of some of its pieces
            outside = [x for x in sizes if c.count(x) < count[x]]
            sums = {sum(p) for k in range(1, len(c) + 1) for p in itertools.combinations(c, k)}
            assert any(s <= x <= s + 40 - sum(c) and (x > s or x not in c) for s in sums for x in outside)


def test_packing_groups_stay_bounded(spark):
    """Pieces of which no two fit together: a level places none well, and its sequences stand."""
    n, group = 6000, 500
    rows = spark.range(n).selectExpr("id as doc_id", "0 as piece", "0L as start", "33 + id % 20 as length", "id as ids_crc32", "id as row")
    got = packing.pack_pieces(store.Workspace(spark, "t"), rows, 64, group).collect()
    assert len(got) == n == len({r.sequence_id for r in got}) and sorted(r.doc_id for r in got) == list(range(n))
    assert max(collections.Counter(r.sequence_id >> 20 for r in got).values()) < 2 * group
    mixed = spark.range(n).selectExpr("id as doc_id", "0 as piece", "0L as start", "1 + xxhash64(id) % 30 + 30 as length", "id as ids_crc32", "id as row")
    got = packing.pack_pieces(store.Workspace(spark, "t"), mixed, 64, group).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    assert all(sum(x for _, x in b) <= 64 and sorted(o for o, _ in b) == [sum(x for _, x in sorted(b)[:k]) for k in range(len(b))] for b in by.values())
    lengths = [r.length for r in got]
    assert len(got) == n and len(by) <= 1.02 * len(packing.best_fit_decreasing(lengths, 64))


def test_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in base[i % 6] + 0.15 * rng.normal(size=8)], None if i == 7 else f"label {i % 2}") for i in range(60)]
    rows += [(90, None, "label 0"), (91, [0.0] * 8, "label 0"), (92, [float("nan")] * 8, "label 0"), (93, rows[0][1], "label 0"), (94, [1.0, 2.0], "label 0"), (95, [1.0, None], "label 0"), (96, [], "label 0")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    ok = {i: np.float32(v).astype(float) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    lab = {i: x for i, _, x in rows}
    near = {i: {j for j in ok if i in ok and j != i and lab[i] == lab[j] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= 0.93} for i in lab}
    want = {i: i for i in lab}
    for _ in lab:
        want = {i: min([want[i], *(want[j] for j in near[i])]) for i in lab}
    got = {r.vec_id: r for r in embeddings.near_vectors(spark, df).collect()}
    assert {i: (got[i].n_links, got[i].component_id, got[i].kept) for i in lab} == {i: (len(near[i]), want[i], want[i] == i) for i in lab}
    assert len(set(want.values())) < len(lab) - 30
    big = {r.vec_id: r for r in embeddings.near_vectors(spark, df.selectExpr("vec_id", "embedding", "5000000000 + int(substr(label, 7)) as label")).collect()}
    assert {i: big[i].component_id for i in lab} == want


def test_vector_intervals_against_all_pairs(spark, monkeypatch):
    """Many small intervals: the grid and box tests lose no link."""
    monkeypatch.setattr(embeddings, "INTERVAL", 16)
    rng = np.random.default_rng(1)
    low = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 12))
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(low)]
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.97).collect()}
    u = low / np.linalg.norm(low, axis=1, keepdims=True)
    assert got == dict(enumerate(((u @ u.T >= 0.97).sum(axis=1) - 1).tolist()))


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51), (60, 60), (None, 3)], "src long, dst long")
    want = {**dict.fromkeys(range(31), 0), 50: 50, 51: 50}
    work = store.Workspace(spark, "t")
    for small in (graph.SMALL, 4):  # finished in one task, and by star rounds
        assert {r.node: r.component for r in graph.connected_components(work, edges, small).collect()} == want
    names = edges.selectExpr("concat('u', src) as src", "concat('u', dst) as dst")
    for small in (graph.SMALL, 4):
        assert {r.node: r.component for r in graph.connected_components(work, names, small).collect()} == {f"u{k}": f"u{v}" for k, v in want.items()}


def test_least_reachable_against_search():
    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 300):
        a, b = rng.integers(0, n, (2, n))
        want = np.arange(n)
        for _ in range(n):
            m = np.minimum(want[a], want[b])
            np.minimum.at(want, a, m)
            np.minimum.at(want, b, m)
        assert (graph.least_reachable(a, b, n) == want).all()


def components_of(sets, percent):
    """Brute force: the least id reachable over links of all pairs."""
    ids, least = sorted(sets), {d: d for d in sets}
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


def test_near_duplicates_of_groups_near_the_threshold(spark):
    """A template's texts below, at and over the similarity, their slots filled from few or many words, and chains of copies."""
    rng = random.Random(5)
    rows = []
    for edits, vocabulary in ((1, 10**6), (2, 4), (3, 3), (5, 10**6)):
        base = [f"t{edits}{k}" for k in range(60)]
        for _ in range(60):
            w = list(base)
            for k in rng.sample(range(60), edits):
                w[k] = f"x{k}x{rng.randrange(vocabulary)}"
            rows.append((len(rows), " ".join(w)))
    chain = [f"c{k}" for k in range(80)]
    for k in range(30):
        rows.append((len(rows), " ".join(chain[:-1] + [f"d{k}"] if k % 3 else chain[k:] + [f"e{j}" for j in range(k)])))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS).repartition(3)
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for i, t in rows}
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark, docs, 4).collect()}
    want = components_of(sets, 80)
    assert got == want and len(set(want.values())) > 60


def test_prefix_lists_hold_every_link(spark):
    rng = random.Random(2)
    sets = {i: set(rng.sample(range(14), rng.randint(1, 12))) for i in range(70)} | {100 + i: set(range(1000 + 50 * i, 1040 + 50 * i)) | set(range(100)) for i in range(40)}
    for percent in (50, 80):
        rows = spark.createDataFrame([(i, i, sorted(x)) for i, x in sets.items()], "id long, g long, items array<long>")
        found = minhash._list_edges(store.Workspace(spark, "t"), rows, percent)
        groups = {r.node: r.component for r in graph.connected_components(store.Workspace(spark, "t"), found).collect()}
        assert {i: groups.get(i, i) for i in sets} == components_of(sets, percent)


def test_token_counts(spark, docs):
    tokens = [b"a", b"ab", b"abc", b" ab", b"cde", b" "]
    m = tokencounts.Matcher(tokens)
    have = {*tokens, *(bytes([b]) for b in range(256))}

    def greedy(w):
        n = 0
        while w:
            k = max(k for k in range(1, len(w) + 1) if w[:k] in have)
            w, n = w[k:], n + 1
        return n

    for w in (b" abcde", b"abcdeabcab", b" a", b"", b"zzab\xff"):
        assert m.count(w) == greedy(w)
    assert tokencounts.token_counts(docs, queries.tokenizer_path("byte_bpe_50k.json")).where("doc_id in (300, 301, 302) and n_tokens = 0").count() == 3


def test_licenses(spark):
    rows = [(1, "Text.\nReleased under the MIT License. More"), (2, None), (3, "All rights reserved. Licensed under the Apache License, Version 2.0.")]
    got = [(r.doc_id, r.license) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "first_sentence").collect()]
    assert got == [(1, "MIT"), (3, "All-Rights-Reserved"), (3, "Apache-2.0")]


PUBLISHED = """Released under the MIT License.
Licensed under the MIT license.
This project is licensed under the MIT License - see LICENSE.
SPDX-License-Identifier: MIT
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES
Licensed under the Apache License, Version 2.0 (the "License");
Released under the Apache License, Version 2.0.
SPDX-License-Identifier: Apache-2.0
you may not use this file except in compliance with the License.
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
This work is licensed under the GNU General Public License, version 3.
The library is licensed under the GNU General Public License, version 3.
SPDX-License-Identifier: GPL-3.0-only
SPDX-License-Identifier: GPL-3.0-or-later
It is licensed under the GNU General Public License, version 2.
SPDX-License-Identifier: GPL-2.0-only
SPDX-License-Identifier: GPL-2.0-or-later
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
It is licensed under the GNU Lesser General Public License, version 2.1.
It is licensed under the GNU Lesser General Public License, version 3.
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Licensed under the BSD License.
Released under the BSD license.
SPDX-License-Identifier: BSD-3-Clause
SPDX-License-Identifier: BSD-2-Clause
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy
Licensed under the Mozilla Public License, version 2.0.
Licensed under CC BY 4.0.
This work is licensed under a Creative Commons Attribution 4.0 International License.
Licensed under CC BY-SA 4.0.
This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.
Licensed under CC BY-NC 4.0.
This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.
Licensed under CC0 1.0.
This work is dedicated to the public domain.
All rights reserved.
Licensed under the ISC license.
SPDX-License-Identifier: ISC
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
Licensed under the zlib license.
SPDX-License-Identifier: Zlib
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
Distributed under the Boost Software License, Version 1.0.
SPDX-License-Identifier: BSL-1.0
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software")
This is free and unencumbered software released into the public domain.
SPDX-License-Identifier: Unlicense
Licensed under the GNU Affero General Public License, version 3.
SPDX-License-Identifier: AGPL-3.0-only
SPDX-License-Identifier: AGPL-3.0-or-later
This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation
either version 3 of the License, or (at your option) any later version.
either version 2 of the License, or (at your option) any later version.
either version 2.1 of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
SPDX-License-Identifier: LGPL-2.1-only
SPDX-License-Identifier: LGPL-2.1-or-later
SPDX-License-Identifier: LGPL-3.0-only
SPDX-License-Identifier: LGPL-3.0-or-later
This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
SPDX-License-Identifier: MPL-2.0
This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0
SPDX-License-Identifier: EPL-2.0
SPDX-License-Identifier: CC-BY-4.0
SPDX-License-Identifier: CC-BY-SA-4.0
SPDX-License-Identifier: CC0-1.0""".split("\n")


def test_licenses_in_published_form():
    known = licenses.Recogniser(rules=tuple((k, (k,)) for k in licenses.SENTENCES))
    of = {s: k for k, all_ in licenses.SENTENCES.items() for s in all_}
    normal = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    held = {s: max((x for x in of if x in normal(s)), key=len) for s in PUBLISHED}
    assert sorted(set(held.values())) == sorted(of)
    for text, s in held.items():
        for shown in (text, f"Some file. {text} And so on", *("Intro.\n\n" + textwrap.fill(text, w, initial_indent=i, subsequent_indent=i) for w in (30, 70, 80) for i in ("", " * ", "# "))):
            assert [x[3] for x in known.scan(shown)] == [[of[s]]], shown
    whole = lambda *rows: [x[0] for x in licenses.Recogniser().scan("\n".join(textwrap.fill(PUBLISHED[r], 72, initial_indent=" * ", subsequent_indent=" * ") for r in rows))]
    assert whole(4, 5, 6) == ["MIT"] and whole(8, 11, 12) == ["Apache-2.0"] and whole(20, 21) == ["GPL"] and whole(39, 24, 7) == ["All-Rights-Reserved", "BSD"]
    assert licenses.Recogniser().scan("First. Here:\n\n# SPDX-License-Identifier: MIT\n") == [("MIT", 2, 2, ["mit-ref"])]
    assert licenses.Recogniser().scan("SPDX-License-Identifier: MIT-0\nSPDX-License-Identifier: BSD-3-Clause-Clear") == []


WHOLE = {
    "MIT": """Copyright (c) 2021 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "Apache-2.0": """Copyright 2020 A. Person

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
}


@pytest.mark.parametrize("name", WHOLE)
def test_whole_licences(name):
    text = WHOLE[name]
    know = licenses.Recogniser()
    for shown in (text, "int main;\n/*\n" + textwrap.indent(text, " * ", lambda _: True) + "\n */\n", textwrap.indent(text, "# "), "\n" + " ".join(text.split())):
        assert [x[0] for x in know.scan(shown)] == [name]


def test_licence_sentences_far_apart_are_no_rule():
    parts = [WHOLE["Apache-2.0"].split("Unless")[0], "word " * 300, "Unless" + WHOLE["Apache-2.0"].split("Unless")[1]]
    assert [x[3] for x in licenses.Recogniser().scan("\n".join(parts))] == [["apache-ref", "apache-may"]]


def test_quality(spark):
    rng = random.Random(1)
    good = lambda: "\n".join(" ".join(rng.choice(["the", "house", "runs", "of", "green"]) + str(rng.randint(0, 99)) for _ in range(12)) + "." for _ in range(4))
    rows = [(i, good() if i % 3 else "\n".join(["spam spam spam"] * 6)) for i in range(300)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(1, None)], "doc_id long, quality int")
    model = quality.fit_quality(spark, docs, labels)
    got = quality.score_quality(docs, model).where("crc32(cast(doc_id as string)) % 4 = 2 and doc_id < 900").collect()
    assert all((r.score >= 0.7) == (r.doc_id % 3 > 0) for r in got) and len(got) > 30
    assert all(0 <= r.score <= 1 for r in quality.score_quality(docs, model).where("doc_id >= 900").collect())


def test_forward_backward_against_enumeration():
    u, t = np.array([0.3, -1.0, 0.7]), np.array([[0.5, -0.2], [0.1, 0.4]])
    total, good = 0.0, np.zeros(3)
    for y in np.ndindex(2, 2, 2):
        p = np.exp(sum(u[i] * y[i] for i in range(3)) + t[y[0], y[1]] + t[y[1], y[2]])
        total, good = total + p, good + p * np.array(y)
    got, _, z = quality.forward_backward(u, np.array([0, 3, 3]), t)
    assert np.allclose(got, good / total) and np.isclose(z, np.log(total))


def test_urls(spark):
    link = '<link rel="canonical" href="https://a.com/en/1">'
    rows = [(1, "http://A.com/en/1", None), (2, "https://b.org/x#y", link), (3, "https://c.org/z", '<meta http-equiv="refresh" content="0;url=https://b.org/x">'), (4, None, ""), (5, "nothing", ""), (6, "https://d.example.com/en/7", link)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(spark, spark.createDataFrame(rows[:5], "page_id long, url string, html string"), queries.RULES).collect()}
    assert got == {1: ("a.com", "/en/1", "com/en/", "block"), 2: ("b.org", "/x", None, "block"), 3: ("c.org", "/z", None, "block"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow")}
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), queries.RULES).collect()}
    assert got[6] == ("example.com/en/7", "allow") and got[3] == (None, "allow") and got[1] == ("com/en/", "block")


def test_url_rules_of_the_contract(spark):
    link = '<link rel="canonical" href="http://a.org/es/1">'
    rows = [("http://a.com/en/1", ""), ("http://example.com/en/7", ""), ("http://a.net/de/1", link), ("http://www.example.net/de/8", ""), ("http://a.org/es/1", ""), ("http://a.net/fr/1", ""), ("http://example.net/de/9", "")]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = [(r.rule, r.verdict) for r in urls.judge_urls(spark, pages, queries.RULES).orderBy("page_id").collect()]
    own = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
    assert got == [*own, (None, "allow"), ("net/de/", "allow")]


def test_pages(spark):
    page = '<html><head><title>t</title></head><body><nav><a>menu</a></nav><div class="top">same words</div><article><h1>T{0} &amp; x</h1><p>a{0} <b>b</b>\n c<p>d<div class="comments">talk {0}</div></article><footer>f</footer></body>'
    rows = [(i, "http://h.com/", page.format(i)) for i in range(12)] + [(50, None, None), (51, "http://h.com/", ""), (52, "http://h.com/", "<p>cut &am")]
    got = {r.page_id: r.text for r in pages.main_text(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "T3 & x a3 b c d" and got[50] == got[51] == "" and got[52] == "cut &am"
    outside = [(i, "http://h.com/", f'<body><div class="top">same words</div><div class="c"><p>text {chr(97 + i)}</p></div>') for i in range(12)]
    got = pages.main_text(spark, spark.createDataFrame(outside, "page_id long, url string, html string")).where("page_id = 2").first().text
    assert got == "text c"


def alone(page, importance=None):
    """Text of a page that no tree knows, or of which it knows the importance of elements by key."""
    nodes = pages.parse(page)
    articles = pages.judge(nodes, "")
    return pages.extract(nodes, articles, {x.path: v for x in nodes for k, v in (importance or {}).items() if x.key == k})


def texts_of(spark, rows):
    return {r.page_id: r.text for r in pages.main_text(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_pages_keep_tables_and_lists_of_articles(spark):
    cells = "".join(f"<tr><td>{k}</td><td>{'total ' + str(k) if k % 4 == 0 else k * k}</td></tr>" for k in range(25))
    lone = f'<body><article><table>{cells}</table></article><div class="d">{"<b>7</b>" * 9}</div>'
    got = texts_of(spark, [(1, "http://t.com/", lone)])
    assert got[1] == " ".join(f"{k} {'total ' + str(k) if k % 4 == 0 else k * k}" for k in range(25))
    page = '<body><article><div class="box">Read more here</div><h2 class="t">Results</h2><p class="lead">Same lead</p><ul><li>yes</li><li>no</li><li>as {2}</li></ul><table><tr><td>0</td><td>{0}</td></tr></table><div class="score">{1}</div><p>story {2}</p></article>'
    got = texts_of(spark, [(i, "http://u.com/", page.format(i % 2, i % 3, chr(97 + i))) for i in range(24)])
    assert got == {i: f"Results Same lead yes no as {chr(97 + i)} 0 {i % 2} {i % 3} story {chr(97 + i)}" for i in range(24)}


def test_pages_all_hosts_tree_is_for_small_hosts(spark):
    page = '<body><div class="top">menu</div><div class="content">{}</div></body>'
    hot = [(i, "http://hot.com/", f'<body><div class="content">same text</div><div class="c">own {chr(97 + i % 26)}{chr(97 + i // 26)}</div></body>') for i in range(60)]
    own = [(100 + i, "http://big.com/", page.format(f"story {chr(97 + i)}")) for i in range(10)]
    few = [(200 + i, "http://few.com/", page.format(f"news {chr(97 + i)}")) for i in range(3)]
    got = texts_of(spark, hot + own + few)
    assert got[0] == "own aa" and got[103] == "story d" and got[202] == "news c"
    menus = [(i, f"http://h{i}.com/", page.format(f"tale {chr(97 + i)}")) for i in range(12)]
    assert texts_of(spark, menus)[4] == "tale e"


def test_pages_copies_count_once(spark):
    page = '<body><div class="top">menu</div><div class="content">{}</div></body>'
    rows = [(i, "http://c.com/", page.format("copied" if i < 60 else f"single {chr(97 + i % 26)}{chr(97 + i // 26)}")) for i in range(80)]
    got = texts_of(spark, rows)
    assert got[3] == "copied" and got[70] == "single sc"


@pytest.mark.parametrize("wrap", ['<div class="layout has-sidebar">{}</div>', '<div class="no-sidebar"><article>{}</article></div>', '<article class="post category-ads comments-open">{}</article>', '<article><div class="widget-text">{}</div></article>'])
def test_pages_class_words_do_not_silence_the_text(wrap):
    text = "A story of many words that goes on for a while."
    for body in (f"<p>{text}</p>", f'<p>{text}</p><div class="sidebar">links</div><div class="share">send</div>'):
        assert alone(f"<body><nav>menu</nav>{wrap.format(body)}</body>") == text


def test_pages_class_words_of_posts_and_comments():
    posts = "".join(f'<div class="post category-{c} comments-open"><p>Post {c}.</p></div>' for c in ("ads", "news", "promo"))
    assert alone(f'<body>{posts}<div class="ad">buy</div></body>') == "Post ads. Post news. Post promo."
    page = '<body><article class="post"><p>A longer story here.</p></article><div id="comments"><article class="comment"><p>Nice</p></article></div></body>'
    assert alone(page) == "A longer story here."


@pytest.mark.parametrize("inside", [True, False])
@pytest.mark.parametrize("times", [1, 2, 10])
def test_pages_comments_go_however_long_they_are(spark, inside, times):
    word = lambda i, k: "".join(chr(97 + (i * 7 + k * k + j) % 26) for j in range(3 + (i + k) % 5))
    story = lambda i: " ".join(word(i, k) for k in range(40))
    talk = lambda i: "".join(f'<li class="comment"><p>{" ".join(word(i + 50 + t, k) for k in range(40))}</p></li>' for t in range(times))
    box = lambda i: f'<div class="post-comments" id="comments"><h3>Comments</h3><ol class="commentlist">{talk(i)}</ol></div>'
    main = '<article><h1>{2}</h1><p>{0}</p>{1}</article>' if inside else '<div class="story"><h1>{2}</h1><p>{0}</p></div>{1}'
    rows = [(i, "http://talk.com/" if i < 20 else f"http://one{i}.com/", f"<body>{main.format(story(i), box(i), word(i, 3))}</body>") for i in range(24)]
    assert texts_of(spark, rows) == {i: f"{word(i, 3)} {story(i)}" for i in range(24)}


def test_pages_of_comments_alone_are_kept():
    assert alone('<body><h1>A thread</h1><div class="discussion"><p>What do you all think of this?</p><p>I like it very much indeed.</p></div></body>') == "A thread What do you all think of this? I like it very much indeed."


def test_pages_keep_plain_blocks_beside_and_within_articles():
    page = '<body><div class="lead">A lead of some words.</div><article><p>Story.</p><div class="related-work">Others did this before.</div></article><div class="post-body">And it goes on here.</div></body>'
    assert alone(page) == "A lead of some words. Story. Others did this before. And it goes on here."


def test_pages_tree_decides_without_class_words(spark):
    page = '<body><div class="a1"><p>Welcome to this house of many words</p></div><div class="b1"><p>Tale {0} of a day</p></div><div class="c1"><p>Made by hand in the same old town</p></div></body>'
    rows = [(i, "http://plain.com/", page.format("".join(chr(97 + (i * k) % 26) for k in range(1, 9)))) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    with_tree = {r.page_id: r.text for r in pages.main_text(spark, df).collect()}
    without = {r.page_id: r.text for r in pages.main_text(spark, df, trusted=10**9).collect()}
    assert all(re.fullmatch(r"Tale [a-z]+ of a day", t) for t in with_tree.values()) and all(t.startswith("Welcome") and t.endswith("town") for t in without.values())


def test_pages_long_maps_travel_once(spark, monkeypatch):
    page = lambda i, h: f'<body><div class="share">{h} {chr(97 + i)}</div><div class="top">menu {h}</div>' + "".join(f'<div class="k{chr(97 + k)}">same</div>' for k in range(12)) + f'<p>Story {h} {chr(97 + i)}</p></body>'
    rows = [(100 * h + i, f"http://h{h}.com/", page(i, h)) for h in range(3) for i in range(20)] + [(900, None, "<p>x</p>"), (901, "http://h1.com/", None)]
    want = texts_of(spark, rows)
    monkeypatch.setattr(pages, "TRAVELS", 3)
    for n in (20_000, 4):  # maps of these hosts are long; then a host in several tasks
        monkeypatch.setattr(pages, "PAGES", n)
        assert texts_of(spark, rows) == want and len(want) == len(rows)


def test_pages_importance_decides(spark):
    """The tree's importance overrules what a class tells, both ways, and without it the result differs."""
    page = '<body><div class="share">{}</div><div class="c">{}</div><p>Story of {}</p></body>'
    assert alone(page.format("x", "y", "z")) == "y Story of z"  # no tree: the class decides
    varied = '<i>a</i><b>b</b>', '<b>c</b>', '<u>d</u><b>e</b>', '<i>f</i>'
    rows = [(i, "http://v.com/", page.format(f"{varied[i % 4]}{chr(97 + i)}<em>{'<s>q</s>' * (i % 2)}</em>", "Same line", chr(97 + i))) for i in range(24)]
    rows = [(i, u, h.replace('<em>', f'<em class="k{chr(97 + i)}">')) for i, u, h in rows]
    got = texts_of(spark, rows)
    text = lambda i: re.sub("<[^>]*>", "", f"{varied[i % 4]}{chr(97 + i)}{'q' * (i % 2)}")
    assert got == {i: f"{text(i)} Story of {chr(97 + i)}" for i in range(24)}
    inside = [(i, "http://w.com/", f'<article><div class="box">Read on</div><div class="own">Own {chr(97 + i)}</div><p>Text {chr(97 + i)}</p></article>') for i in range(24)]
    assert texts_of(spark, inside) == {i: f"Own {chr(97 + i)} Text {chr(97 + i)}" for i in range(24)}
    assert alone(inside[0][2]) == "Read on Own a Text a"
    beside = [(i, "http://x.com/", f'<h1>Title</h1><div class="lead">Lead {chr(97 + i)}</div><div class="top">Top</div><article><p>Text {chr(97 + i)}</p></article>') for i in range(24)]
    assert texts_of(spark, beside) == {i: f"Lead {chr(97 + i)} Text {chr(97 + i)}" for i in range(24)}


def test_pages_importance_against_entropy(spark):
    """Importance of every path against the entropies of contents and presentations, counted page by page."""
    rng = random.Random(4)
    rows = []
    for i in range(40):
        menu = "".join(f"<a>{rng.choice('xy')}</a>" if rng.random() < 0.7 else f"<b>{rng.choice('xyz')}</b>" for _ in range(rng.randint(1, 3)))
        rows.append((i, "http://e.com/", f'<div class="m">{menu}</div><div class="t"><p>{rng.choice(["one", "two", "three"])}</p>{"<p>more</p>" * rng.randint(0, 2)}<h2>{i}</h2> unique {chr(97 + i % 26)}{chr(97 + i // 26)}</div>'))
    shows = collections.defaultdict(lambda: (collections.Counter(), collections.Counter(), set()))
    for i, _, h in rows:
        nodes = pages.parse(h)
        pages.judge(nodes, "e.com")
        for path, kind, value in pages.observe(nodes):
            if kind < 2:
                shows[path][kind][value] += 1
            shows[path][2].add(i)
    got = {r.path & ((1 << 64) - 1): (r.n, r.importance) for r in pages.style_tree(pages._sums(spark, spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    assert set(got) == set(shows)
    for path, (contents, shapes, having) in shows.items():
        n, want = len(having), 0.0
        for weight, counts in ((pages.GAMMA, contents), (1 - pages.GAMMA, shapes)):
            total = sum(counts.values())
            want += weight * (max(0.0, sum(c * (np.log(n) - np.log(c)) for c in counts.values()) / total / np.log(n)) if n > 1 else 1.0)
        assert got[path][0] == n and np.isclose(got[path][1], want)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article class="post ad-free"><p>Real text</p></article>', "Real text"),
        ("<form><main><p>Real text</p></main></form>", "Real text"),
        ('<article><p class="share-price">Price 5</p><p>Other</p></article>', "Price 5 Other"),
        ('<body><h1>Title</h1><p class="lead">Lead</p><article><p>Body</p></article></body>', "Title Lead Body"),
        ('<div id="comments">hi there</div><div class="ad">x</div><div><p>text of a page that is long</p></div>', "text of a page that is long"),
        ("<form><div>all of the text</div></form>", "all of the text"),
        ("<article>a &lt;b&gt; &#233;<br>c<nav>menu</nav><form>f</form></article>", "a <b> é c"),
    ],
)
def test_pages_kept_whole(page, text):
    assert alone(page) == text


def test_pages_of_any_depth_and_length(spark):
    deep = "<div>" * 10_000 + "bottom" + "</div>" * 10_000
    crossed = "<b>" * 3_000 + "<p>a</i></u>" * 300
    long = "<article>" + "".join(f"<p>block {i}</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "http://d.com/", deep), (2, "http://d.com/", crossed), (3, "http://d.com/", long), (3, "http://d.com/", long), (None, None, "<p>no id"), (4, "", "")]
    got = pages.main_text(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.page_id].append(r.text)
    assert by == {1: ["bottom"], 2: [" ".join("a" * 300)], 3: [" ".join(f"block {i}" for i in range(20_000))] * 2, None: ["no id"], 4: [""]}


CLASHING = ["k1", "k2", "id", "key", "row", "text_key", "group_id", "same", "score", "__score", "quality", "n_words", "n_removed", "host", "known", "c0", "c1", "Lang", "spans", "cell"]


def hard_rows(texts):
    """Documents with nulls, ties, repeated rows and columns whose names operators use."""
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (None, texts[0]), (0, texts[0]), (0, texts[0]), (7, None), (7, ""), (8, " \n\t "), (9, "word"), (9, "word")]
    return [(*r, *(f"{c} {k}" for c in CLASHING)) for k, r in enumerate(rows)]


@pytest.fixture(scope="module")
def hard(spark):
    texts = [" ".join(f"w{i}x{k % 50}" for k in range(n)) for i, n in enumerate((200, 1, 60, 40_000))]
    return spark.createDataFrame(hard_rows(texts), "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING)).repartition(2).cache()


def same_columns(df, hard):
    """The clashing columns come back with their rows."""
    for r in df.collect():
        values = [r[hard.columns.index(c)] for c in CLASHING]
        assert len({v.rsplit(" ", 1)[1] for v in values}) == 1 and [v.rsplit(" ", 1)[0] for v in values] == CLASHING


def test_hard_tables_of_all_operators(spark, hard):
    path, n = queries.tokenizer_path(), hard.count()
    bench = spark.createDataFrame([("a", " ".join(f"w2x{k}" for k in range(30)), "x"), ("b", None, "x"), (None, "", "x"), ("a", " ".join(f"w2x{k}" for k in range(30)), "y")], "item_id string, text string, doc_id string")
    found = decontaminate.leaks(spark, hard, bench).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(2, "a")]
    clean = decontaminate.drop_contaminated(spark, hard, bench)
    assert clean.columns == hard.columns and clean.count() == n - 1
    same_columns(clean, hard)
    packed = packing.pack(spark, hard, path).collect()
    assert sum(r.piece == 0 for r in packed) == n and max(r.length for r in packed) <= 4096
    cut = substring.drop_repeats(spark, hard, counts=("gone", "left"))
    assert cut.columns == [*hard.columns, "gone", "left"]
    same_columns(cut, hard)
    # the first text stands four times, the long one repeats itself
    assert [(r.doc_id, r.left) for r in cut.where("left > 0").orderBy("doc_id", "gone").collect()] == [(None, 200), (0, 200), (0, 200), (0, 200), (3, 40_000)]
    assert cut.where("doc_id = 7 and text is null").count() == 1 and set(substring.drop_repeats(spark, hard).columns) == set(hard.columns)
    near = minhash.near_duplicates(spark, hard).collect()
    assert len(near) == n and {r.component_id for r in near if r.doc_id in (0, None) and r.n_shingles} == {0}
    kept = minhash.drop_near_duplicates(spark, hard)
    assert kept.columns == hard.columns and kept.where("doc_id = 0").count() == 1 and kept.where("doc_id = 9").count() == 1 and kept.where("trim(coalesce(text, '')) = '' or text rlike '^\\\\s+$'").count() == 4
    same_columns(kept, hard)
    assert licenses.scan_licenses(hard).count() == 0 and tokencounts.token_counts(hard, queries.tokenizer_path("byte_bpe_50k.json")).where("n_words = 40000").count() == 1
    labels = spark.createDataFrame([(0, 1, "x"), (0, None, "x"), (2, 0, "x"), (None, 1, "x"), (3, 1, "x")], "doc_id long, quality int, text string")
    scored = quality.score_quality(hard, quality.fit_quality(spark, hard, labels))
    assert scored.columns == [c for c in hard.columns if c != "score"] + ["score"] and scored.where("score between 0 and 1").count() == n
    other = quality.score_quality(hard, quality.fit_quality(spark, hard, labels.limit(0)), "mark")
    assert other.columns == [*hard.columns, "mark"] and other.where("mark between 0 and 1").count() == n
    same_columns(other, hard)
    vectors = hard.selectExpr("doc_id as vec_id", "if(doc_id = 0, array(1.0, 2.0), null) as embedding", "doc_id as label", *[f"`{c}`" for c in CLASHING])
    assert [(r.vec_id, r.n_links) for r in embeddings.near_vectors(spark, vectors).where("n_links > 0").collect()] == [(0, 2)] * 3
    sites = hard.selectExpr("doc_id as page_id", "text as url", "text as html", *[f"`{c}`" for c in CLASHING if c != "host"], "lang as host")
    assert urls.judge_urls(spark, sites, queries.RULES).where("verdict = 'allow'").count() == n
    assert pages.main_text(spark, sites).where("text = ''").count() == 4


def test_rules_of_equal_length_in_order(spark):
    page = spark.createDataFrame([(1, "http://a.com/b/x", None), (1, "http://a.com/b/x", None)], "page_id long, url string, html string")
    for rules in ([("block", "a.com", "/"), ("allow", "com", "/b/")], [("allow", "com", "/b/"), ("block", "a.com", "/")]):
        assert [r.verdict for r in urls.judge_urls(spark, page, rules).collect()] == ["block" if len("a.com/") > len("com/b/") else rules[0][0]] * 2


def test_benchmarks_of_several_passes(spark, docs, monkeypatch):
    items = [(i, " ".join(f"i{i}w{k}" for k in range(25))) for i in range(30)]
    bench = spark.createDataFrame(items, "item_id int, text string")
    more = docs.unionByName(spark.createDataFrame([(900 + i, f"x {t} y", "en", "s", 1) for i, t in items], DOCS))
    want = sorted((900 + i, i) for i, _ in items)
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(spark, more, bench).collect()) == want
    monkeypatch.setattr(decontaminate, "PASS_ITEMS", 16)
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(spark, more, bench).collect()) == want
    assert decontaminate.drop_contaminated(spark, more, bench).count() == docs.count()


def test_leaks_against_every_window(spark):
    """Recall: every window of every text by its exact weighted similarity."""
    rng = random.Random(6)
    word = lambda: f"v{rng.randrange(400)}"
    items = [(i, [word() for _ in range(rng.randint(12, 40))]) for i in range(12)]
    rows = []
    for i in range(160):
        w = [word() for _ in range(rng.randint(0, 60))]
        if i % 2:
            part = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 2)):
                part[rng.randrange(len(part))] = word()
            w[len(w) // 2 : len(w) // 2] = part
        rows.append((i, w))
    bag = lambda w: collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    want = set()
    for d, w in rows:
        for i, t in items:
            b = bag(t)
            for p in range(max(1, len(w) - len(t) + 1)):
                a = bag(w[p : p + len(t)])
                if sum((a & b).values()) and sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                    want.add((d, i))
    df = lambda x, c: spark.createDataFrame([(i, " ".join(w)) for i, w in x], c)
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark, df(rows, "doc_id long, text string"), df(items, "item_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 20


def test_quality_lines_are_bounded():
    sizes = np.arange(1000.0)
    s, e = quality._drawn(sizes, 10, 1010, 128)
    assert e - s == 128 and 10 <= s and e <= 1010 and quality._drawn(sizes[:5], 3, 8, 128) == (3, 8)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert not minhash.near_duplicates(spark, none).count() and not substring.drop_repeats(spark, none).count() and not packing.pack(spark, none, queries.tokenizer_path()).count()
    assert not decontaminate.leaks(spark, none, docs.select(F.col("doc_id").alias("item_id"), "text").limit(0)).count()
    assert not embeddings.near_vectors(spark, spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count()
    assert not licenses.scan_licenses(none).count() and not tokencounts.token_counts(none, queries.tokenizer_path("byte_bpe_50k.json")).count()
    model = quality.fit_quality(spark, none, spark.createDataFrame([], "doc_id long, quality int"))
    assert not quality.score_quality(none, model).count() and quality.score_quality(docs, model).where("score between 0 and 1").count() == docs.count()
    sites = spark.createDataFrame([], "page_id long, url string, html string")
    assert not urls.judge_urls(spark, sites, queries.RULES).count() and not pages.main_text(spark, sites).count()


def test_every_window_has_a_symbol_of_its_words():
    """Equal windows have one symbol, wherever they stand; texts of any kind leave none without."""
    rng = np.random.default_rng(7)
    texts = [rng.integers(1, 50, 400).astype(np.uint64), np.full(300, 9, np.uint64), np.tile(rng.integers(1, 9, 50).astype(np.uint64), 8)]
    texts += [np.concatenate([rng.integers(1, 50, 60).astype(np.uint64), texts[0][100:200], rng.integers(1, 50, 30).astype(np.uint64)])]
    h, offsets = np.concatenate(texts), np.r_[0, np.cumsum([len(t) for t in texts])]
    h = substring.W.mix(h)
    text, p0, p1, name = substring.window_symbols(h, offsets, 35, 4)
    by = collections.defaultdict(set)
    for a, b, n in zip(p0.tolist(), p1.tolist(), name.tolist(), strict=True):
        for p in range(a, b + 1):
            by[tuple(h[p : p + 35].tolist())].add(n)
    assert all(len(x) == 1 for x in by.values()) and (p1 - p0 + 1).sum() == sum(max(0, len(t) - 34) for t in texts)


def test_long_texts_of_known_sentences_take_linear_time():
    import time

    know = licenses.Recogniser()
    took = []
    for n in (4_000, 16_000, 64_000):
        text = "all rights reserved yes\n" * n
        began = time.process_time()
        assert len(know.scan(text)) == n
        took.append(time.process_time() - began)
    assert took[2] < 10 * took[1] + 0.5 and took[1] < 10 * took[0] + 0.5
    names = licenses.Recogniser(rules=licenses.all_rules())
    assert sum(map(len, licenses.all_sentences().values())) >= 200
    for text, name in (("Released under the WTFPL.", "WTFPL"), ("SPDX-License-Identifier: EUPL-1.2", "EUPL-1.2"), ("This font software is licensed under the SIL Open Font License, Version 1.1.", "OFL-1.1"),
                       ("licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License", "CC-BY-NC-SA-3.0")):
        assert [x[0] for x in names.scan(text)] == [name]


def test_quality_is_fitted_on_one_row_of_an_id(spark):
    rows = [(i, f"line {i}\n" * 3 + "w " * (i % 5), i % 2) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] * 1 + [(3, "another text of it")] * 50 + [(3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    model = quality.fit_quality(spark, docs, labels)
    once = quality.fit_quality(spark, docs.dropDuplicates(["doc_id"]), labels)
    scores = [[r.score for r in quality.score_quality(docs.where("doc_id <> 3"), m).orderBy("doc_id").collect()] for m in (model, once)]
    assert np.allclose(*scores, atol=0.2)
