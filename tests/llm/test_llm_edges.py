"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; and the parts of each method."""

from __future__ import annotations

import collections
import io
import math
import struct
import zipfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from conftest import same_rows
from pyspark.sql import functions as F

from wavelake.llm import chat, common, components, licences, media, mixing, packing, quality, scoring, sharding, simhash, urls
from wavelake.llm.common import mix64
from wavelake.llm.trie import EliasFano, Trie, quantise, share_of

LONG = "long words " * 30_000
ROWS = [(1, "a b c d e", "x"), (1, "a b c d e", "x"), (2, None, None), (3, "", "y"), (None, "null id here", "y"), (None, None, None), (4, LONG, "x"), (5, " \t\n", "z"), (6, "ü\x85ö  é", "z")]
SCHEMA = "doc_id long, text string, source string"
CLASHING = ["bin", "pack", "__mix_id", "__times", "__copy", "__id", "__rows", "shards", "place", "total", "end", "bucket", "shard", "size", "taken", "component_id", "root", "id", "__key", "k", "n", "part"]
OPERATORS = {
    "mix": (mixing.mix_documents, len(ROWS)), "shard": (sharding.shard_documents, len(ROWS)), "quality": (quality.repetition_rules, len(ROWS)), "simhash": (simhash.simhash_components, len(ROWS)),
    "score": (scoring.score_documents, len(ROWS)), "licences": (licences.scan_licences, len(ROWS)), "media": (media.media_digest, len(ROWS)), "pack": (packing.pack_documents, None),
    "keep": (quality.keep_good, None), "near": (simhash.drop_near_copies, None), "mixed": (mixing.mixed_corpus, None),
}


def documents(spark, rows=ROWS, clashing=False):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(7).alias(c) for c in CLASHING]) if clashing else df


@pytest.mark.parametrize("clashing", [False, True])
@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, name, clashing):
    f, n = OPERATORS[name]
    rows = f(documents(spark, clashing=clashing)).collect()
    if n is not None:
        assert len(rows) == n and collections.Counter(r.doc_id for r in rows) == collections.Counter(r[0] for r in ROWS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(spark, name):
    assert OPERATORS[name][0](documents(spark, [])).count() == 0


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_very_long_words_and_very_many_lines(spark, name):
    rows = [(1, "x" * 1_000_000, "x"), (2, "\n" * 100_000 + "a b\n" * 100_000, "y"), (3, "<" * 200_000 + "%PDF-" * 20_000, "x"), (4, " ".join(map(str, range(300_000))), "y")]
    got = OPERATORS[name][0](documents(spark, rows)).toPandas()
    assert set(got.doc_id) <= {1, 2, 3, 4} and (OPERATORS[name][1] is None or len(got) == 4)


PAGES = "page_id long, url string, html string"
TALK = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("empty", [False, True])
def test_other_tables_with_clashing_columns_and_without_rows(spark, empty):
    def clash(rows, schema, names):
        df = spark.createDataFrame([] if empty else rows, schema)
        return df.select("*", *[F.lit(7).alias(c) for c in names])

    n = 0 if empty else 3
    pages = clash([(1, "http://a.org/x", '<link rel=canonical href="/y">'), (2, "http://a.org/y", None), (None, None, "x" * 100_000)], PAGES, ["host", "path", "rule", "verdict", "by", "component", "node", "root", "blocked", "__node", "__rule", "source", "target", "tag"])
    got = urls.judge_urls(pages)
    assert got.count() == n and len(set(got.columns)) == len(got.columns)
    talk = clash([(1, 1, "user", "a"), (1, 1, "user", "a"), (2, None, None, None), (3, 1, "assistant", "long " * 100_000)], TALK, ["messages", "turns", "layout", "formatted", "loss_spans", "__parts", "__turns", "__loss", "n_turns", "fingerprint"])
    assert sorted((r.conv_id, r.n_turns) for r in chat.format_conversations(talk).collect()) == [(1, 2), (2, 1), (3, 1)][:n]
    held = clash([(1, b"GIF89a", "x"), (1, b"GIF89a", "x"), (None, None, None)], "id long, content binary, declared string", ["type", "length", "carved", "declared_ok", "rows"])
    out = media.sniff_media(held)
    assert out.count() == n and out.columns == ["id", "rows", "type", "declared_ok", "length", "carved"]
    records = clash([("p", "c"), ("p", "c"), (None, None)], "prompt string, completion string", ["turns", "layout", "fingerprint", "other"])
    assert sorted(str(r.layout) for r in chat.canonical_turns(records).collect()) == ["None", "prompt", "prompt"][:n]


def test_odd_rows_have_the_results_that_are_told(spark):
    df = documents(spark)
    q = {r.doc_id: r for r in quality.repetition_rules(df).filter("doc_id is not null").collect()}
    assert q[2].n_words == q[3].n_words == q[5].n_words == 0 and q[2].base_failed and not q[2].kept and q[6].n_words == 2 and q[6].word_chars == 4
    assert q[4].n_repeat_words == 60_000 and q[4].base_failed
    s = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(df).collect()]
    assert {x[2] for x in s if x[1] == "0" * 16} == {2} and len([x for x in s if x[1] == "0" * 16]) == 4
    p = packing.pack_documents(df).toPandas()
    assert p[p.words == 0].bin.isna().all() and p[p.doc_id == 4].words.sum() == 60_000 and p[p.doc_id == 4].piece.max() == 60_000 // 2048
    m = mixing.mix_documents(df).toPandas()
    assert m[m["size"] == 0].taken.sum() == 0 and m[m.source.isna()]["size"].sum() == 0
    near = [r.doc_id for r in simhash.drop_near_copies(df).collect()]
    assert sorted(x for x in near if x is not None) == [1, 2, 4, 6] and near.count(None) == 1
    empty = scoring.score_documents(df).filter("doc_id = 2").first()
    assert empty.n_tokens == 1 and empty.score < 0


# Mixing ----------------------------------------------------------------------------------------------------------


@settings(max_examples=20, deadline=None)
@given(sizes=st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_targets_are_the_fixed_point_of_resharing(spark, sizes):
    got = mixing.targets(spark.createDataFrame([(f"s{i}", False, n) for i, n in enumerate(sizes)], "source_key string, source_null boolean, source_size long"), mixing.Mix()).orderBy("source_key").collect()
    left, open_, target = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(1 + i % 3 for i in open_)
        over = {i for i in open_ if left * (1 + i % 3) / total > 3 * sizes[i] + 1e-9}
        if not over:
            for i in open_:
                target[i] = left * (1 + i % 3) / total
            break
        for i in over:
            target[i] = 3.0 * sizes[i]
            left -= target[i]
        open_ -= over
    assert [r.target for r in got] == pytest.approx(target, abs=1e-6)


def test_quotas_are_an_apportionment(spark):
    rows = [(i, "w " * (20 + i % 13), f"s{i % 7 if i % 3 else 0}") for i in range(600)]
    mix = mixing.Mix(shards=5)
    quotas = mixing.shard_quotas(documents(spark, rows), mix).toPandas()
    sizes = mixing.mix_documents(documents(spark, rows), mix).toPandas().groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    total, house = sizes["size"].sum(), round(sizes["size"].sum() / mix.block_tokens)
    seats = sorted(((-t / (2 * k + 1), i) for i, t in enumerate(sizes.target) for k in range(house)))[:house]
    want = collections.Counter(i for _, i in seats)
    assert quotas.groupby("source").quota.sum().tolist() == [want[i] for i in range(len(sizes))]
    assert quotas.groupby("shard").quota.sum().max() - quotas.groupby("shard").quota.sum().min() <= 1 and total > 0
    assert ((sizes.taken - sizes.target).abs() <= 2 * mix.block_tokens).all()


def test_small_sources_meet_their_targets_however_large_the_blocks(spark):
    """Sources of 1 : 10**6 words, and blocks of large ones that hold several small sources whole."""
    rows = [(i, "w " * 20_000, "large") for i in range(50)] + [(1000, "w", "one"), (1001, "w " * 13, "small")] + [(2000 + i, "w " * 50, "middle") for i in range(30)]
    mix = mixing.Mix(max_blocks=64)  # blocks of 15,649 words
    by = mixing.mix_documents(documents(spark, rows), mix).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).toPandas().set_index("source")
    assert by.target["one"] == 3 and by.target["small"] == 39 and by.target["middle"] == 4500
    assert by.taken["one"] == 3 and by.taken["small"] == 39 and abs(by.taken["middle"] - 4500) <= 4500 / 64 and abs(by.taken["large"] - by.target["large"]) <= 15_649
    got = mixing.mixed_corpus(documents(spark, rows), mix).groupBy("source").agg(F.sum(common.n_words(F.col("text"))).alias("words")).toPandas().set_index("source").words
    assert got["one"] == 3 and got["small"] == 39 and abs(got["middle"] - 4500) <= 100 and abs(got["large"] - by.target["large"]) <= 40_000


def test_shards_get_their_quotas_of_blocks(spark):
    """With documents of a block each, a document's shards are those of its block's seats; shards differ by one seat."""
    rows = [(i, "w " * 16, f"s{i % 2}") for i in range(400)]
    mix = mixing.Mix(shards=8, weights=(1, 1))
    got = mixing.mix_documents(documents(spark, rows), mix).toPandas()
    seats = collections.Counter(x for s in got.shards if s for x in s.split(","))
    assert sum(seats.values()) == 400 and max(seats.values()) - min(seats.values()) <= 1 and len(seats) == 8
    assert ((got.taken > 0) == (got.shards != "")).all()


# Components ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_EDGES", few)
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2200)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        if a is not None and a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a is not None and a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    assert got == root
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_split_by_loses_nothing(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("id"))
    some, rest = common.split_by(df, "id", common.members(df.filter("id < 40"), "id"))
    a, b = {r.id for r in some.collect()}, {r.id for r in rest.collect()}
    assert len(a) + len(b) == 1000 and {str(i) for i in range(40)} <= a and len(a) < 60


# URLs ------------------------------------------------------------------------------------------------------------


def test_aliases_inherit_blocks_but_not_over_an_allow(spark):
    rows = [
        (1, "http://a.net/x?q=1#f", '<LINK href="/y" REL=canonical>'), (2, "https://a.net/y", "<meta content=\"0; URL='https://b.com/de/1'\" http-equiv=\"Refresh\">"), (3, "http://b.com/de/1", None),
        (4, "https://q.org/z", '<link rel="canonical" href="https://b.com/de/1">'), (5, None, "<link rel=canonical href=http://c.d/>"), (6, "nothing", None), (7, "http://A.NET", "x"), (7, "http://A.NET", "x"),
        (8, "https://k.net/aa/b?z", '<link rel="canonical" href="c&amp;d">'), (9, "http://ORG/es/", None), (10, "http://www.example.org/es/q", ""), (11, "http://example.org/en/12", ""), (12, "http://badexample.org/es/", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, r.by, r.rule) for r in urls.judge_urls(pages).collect()}
    assert got[1] == got[2] == ("block", "alias", None) and got[3] == ("block", "rule", "com/de/") and got[4] == ("allow", "rule", "org/")
    assert got[5] == got[6] == got[7] == got[8] == ("allow", "default", None) and got[9] == ("allow", "rule", "org/")
    assert got[10][2] == "example.org/es/" and got[11][2] == "example.org/en/1" and got[12][2] == "org/"
    log = spark.createDataFrame([("http://k.net/aa/b?z", "http://t.com/de/")], "source string, target string")
    assert {r.page_id: r.verdict for r in urls.judge_urls(pages, log).collect()}[8] == "block"
    assert urls.judge_urls(pages.limit(0)).count() == 0


# Trie ------------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(values=st.lists(st.integers(0, 1 << 62), max_size=300), dense=st.booleans(), asked=st.lists(st.integers(0, 1 << 62), max_size=40))
def test_elias_fano(values, dense, asked):
    if dense:
        values, asked = [v % 97 for v in values], [v % 120 for v in asked]
    v = np.array(sorted(values), np.uint64)
    e = EliasFano.of(v)
    assert np.array_equal(e[np.arange(len(v))], v)
    x = np.array([*asked, *values[:20]], np.uint64)
    got = e.successor(x, np.zeros(len(x), np.int64), np.full(len(x), len(v)))
    assert np.array_equal(got, np.searchsorted(v, x))


def test_trie_finds_what_was_put_in_and_nothing_else(tmp_path):
    rng = np.random.default_rng(2)
    grams = sorted({tuple(int(x) for x in g) for g in rng.integers(0, 60, (3000, 3))})
    first = sorted({g[0] for g in grams})
    pairs = sorted({g[:2] for g in grams})
    two = [(first.index(a), b) for a, b in pairs]
    place = {x: i for i, x in enumerate(pairs)}
    codes = [rng.integers(0, 65536, len(x)).astype(np.uint16) for x in (pairs, grams)]
    level = lambda rows, code: (*(np.array(x, np.int64) for x in zip(*rows, strict=True)), code)
    trie = Trie.of(np.array(first), np.arange(len(first)), [level(two, codes[0]), level([(place[g[:2]], g[2]) for g in grams], codes[1])])
    path = str(tmp_path / "trie")
    common.stored_file(path, trie.to_bytes())
    t = Trie.map(common.mapped_file(path))
    asked = np.array([*grams, *rng.integers(0, 70, (2000, 3)).tolist()])
    second = t.below(1, t.root(asked[:, 0]), t.named(asked[:, 1]))
    third = t.below(2, second, t.named(asked[:, 2]))
    know = {g: c for g, c in zip(grams, codes[1], strict=True)}
    assert t.code(2, third).tolist() == [know.get(tuple(g), 0) for g in asked.tolist()]
    assert ((third >= 0) == [tuple(g) in know for g in asked.tolist()]).all()
    assert t.code(1, second).tolist() == [int(codes[0][place[tuple(g[:2])]]) if tuple(g[:2]) in place else 0 for g in asked.tolist()]
    assert len(trie.to_bytes()) < 8 * (len(grams) + len(pairs))
    none = np.empty(0, np.int64)
    assert t.counts.tolist() == list(range(len(first)))
    bare = Trie.map(Trie.of(none, none, [(none, none, none.astype(np.uint16))] * 2).to_bytes())
    assert bare.below(2, bare.below(1, bare.root(np.array([1])), np.array([2])), np.array([3])).tolist() == [-1]


def test_quantised_shares():
    p = np.array([1.0, 0.5, 1e-9, 0.0])
    assert np.allclose(share_of(quantise(p)), p, rtol=0.0012) and share_of(quantise(p))[3] == 0


def test_scores_do_not_depend_on_chunks_or_shards(spark, monkeypatch):
    rows = [(i, f"the cat {i % 5} sat on the mat {i % 3} of the {i}", "s") for i in range(120)]
    whole = {r.doc_id: r.score for r in scoring.score_documents(documents(spark, rows)).collect()}
    for hot in (500_000, 8):  # at 8 the first word "the" and the pair "of the" are spread over shards
        monkeypatch.setattr(scoring, "CHUNK_WORDS", 50)
        monkeypatch.setattr(scoring, "SHARD_ENTRIES", 20)
        monkeypatch.setattr(scoring, "HOT", hot)
        cut = {r.doc_id: r.score for r in scoring.score_documents(documents(spark, rows)).collect()}
        assert cut == pytest.approx(whole, abs=1e-6)


def test_ids_beside_nulls_stay_what_they_are(spark):
    """Python would read whole numbers beside a null as floats: 3 as 3.0, and 2**53 + 1 as 2**53."""
    ids = [*range(1, 101), 2**53 + 1, None]
    rows = [(i, f"some words of text {i} and a tail " * 5 + str(i), "s") for i in ids]
    df = documents(spark, rows).coalesce(1)
    for f in (scoring.score_documents, simhash.simhash_components, quality.repetition_rules, media.media_digest, packing.pack_documents):
        assert collections.Counter(r.doc_id for r in f(df).collect()) == collections.Counter(ids)
    for r in scoring.score_documents(df).collect():
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 1)
        assert r.train_tokens == sum(len(t.split()) + 1 for i, t, _ in rows if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1)
    for r in simhash.simhash_components(df).collect():
        assert r.component_id is None or r.component_id in ids


# Licences --------------------------------------------------------------------------------------------------------


def test_licence_rules(spark):
    text = {k: v for k, v in licences.SENTENCES.items()}
    names = f"Neither the name of the copyright holder {text['bsd-names']}"
    rows = [
        (1, f"Title\n{text['bsd-source']}\n{text['bsd-binary']} {names}", ""), (2, f"{text['bsd-binary']} {text['bsd-source']}", ""), (3, f"{text['bsd-source']} And {text['arr']} {text['bsd-binary']}", ""),
        (4, "see\nReleased under the MIT License\nfor more", ""), (5, "the MIT License", ""), (6, text["apache-2.0"] + " x " + text["gpl-3"], ""), (7, "unreleased under the MIT Licenses", ""),
        (8, "// SPDX-License-Identifier: GPL-2.0-or-later\nx SPDX-License-Identifier: GPL-2.0", ""), (9, "Released under the Apache License of MIT. Licensed under the", ""),
    ]
    got = {r.doc_id: r.licences for r in licences.scan_licences(documents(spark, rows)).collect()}
    assert got == {1: "BSD-3-Clause", 2: "", 3: "BSD-2-Clause;all-rights-reserved", 4: "MIT", 5: "", 6: "Apache-2.0;GPL-3.0", 7: "", 8: "GPL-2.0;GPL-2.0-or-later", 9: ""}


MIT_TEXT = """MIT License

Copyright (c) 2020 Someone

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
"""
APACHE_TEXT = """Copyright 2020 Someone

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS.
"""
BSD_TEXT = """Copyright (c) 2020, Someone

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
ISC_TEXT = """Copyright (c) 2020 Someone

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER.
"""
GNU_TEXT = """This file is part of Thing.

Thing is free software: you can redistribute it and/or modify
it under the terms of the GNU {0} as published by
the Free Software Foundation, either version {1} of the License, or
(at your option) any later version.

Thing is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
GPL_HEAD = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.
"""
MPL_TEXT = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
CC0_TEXT = """Creative Commons Legal Code

CC0 1.0 Universal

    CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE
    LEGAL SERVICES.

Statement of Purpose

The laws of most jurisdictions throughout the world automatically confer
exclusive Copyright and Related Rights (defined below) upon the creator
and subsequent owner(s) of an original work of authorship and/or a database.
"""
STANDARD = {
    "MIT": MIT_TEXT, "Apache-2.0": APACHE_TEXT, "BSD-2-Clause": BSD_TEXT + BSD_END, "BSD-3-Clause": BSD_TEXT + BSD_NAMES + BSD_END, "ISC": ISC_TEXT, "GPL-3.0": GPL_HEAD, "MPL-2.0": MPL_TEXT, "CC0-1.0": CC0_TEXT,
    "GPL-2.0-or-later": GNU_TEXT.format("General Public License", 2), "GPL-3.0-or-later": GNU_TEXT.format("General Public License", 3), "LGPL-2.1-or-later": GNU_TEXT.format("Lesser General Public License", 2.1),
    "AGPL-3.0-or-later": GNU_TEXT.format("Affero General Public License", 3), "MIT-0": MIT_TEXT.replace(MIT_TEXT[MIT_TEXT.index(", subject to the following") : MIT_TEXT.index("THE SOFTWARE IS")], ".\n\n"),
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "LGPL-3.0": "<!-- SPDX-License-Identifier: LGPL-3.0 -->",
}


@pytest.mark.parametrize("layout", ["plain", "crlf", "slashes", "stars", "one line", "narrow", "within"])
def test_standard_licences(spark, layout):
    """Typed apart from the table of sentences; as comments, at any width, in the middle of text without a full stop."""
    def laid(t: str) -> str:
        lines = t.split("\n")
        return {
            "plain": t, "crlf": t.replace("\n", "\r\n"), "slashes": "\n".join(f"// {x}" for x in lines), "stars": "/*\n" + "\n".join(f" * {x}" for x in lines) + "\n */\nint x;", "one line": " ".join(t.split()),
            "narrow": "\n".join(t.split()), "within": "é words without an end " * 50 + " ".join(t.split()) + " and more words " * 500,
        }[layout]

    names = list(STANDARD)
    got = {r.doc_id: r.licences for r in licences.scan_licences(documents(spark, [(i, laid(STANDARD[n]), "") for i, n in enumerate(names)])).collect()}
    assert [got[i] for i in range(len(names))] == names


def test_what_is_no_licence(spark):
    cut = {n: " ".join(t.split()).replace("distribut", "distrib", 1) for n, t in STANDARD.items() if n in ("ISC", "GPL-2.0-or-later", "GPL-3.0")}
    rows = [(i, t, "") for i, t in enumerate([*cut.values(), "the permission is hereby granted", "a licence of MIT", "CC BY 4.0", BSD_NAMES, BSD_END])]
    assert {r.licences for r in licences.scan_licences(documents(spark, rows)).collect()} == {""}


def test_licences_equal_their_sql_on_standard_texts(spark):
    import duckdb

    texts = [*STANDARD.values(), *[" ".join(STANDARD[a].split()) + STANDARD[b] for a, b in (("MIT", "ISC"), ("ISC", "MIT"), ("BSD-3-Clause", "BSD-2-Clause"))], " ".join(licences.SENTENCES.values()), None, "", "é!"]
    rows = [(i, t, "") for i, t in enumerate(texts)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    same_rows(licences.scan_licences(documents(spark, rows)).toPandas(), con.execute(licences.licences_sql()).df())


# Sharding --------------------------------------------------------------------------------------------------------


def test_hypergeometric_law(spark):
    draw = sharding.hypergeometric(F.lit(12).cast("bigint"), F.lit(18).cast("bigint"), F.lit(10).cast("bigint"), "law", F.col("id"), 64)
    got = collections.Counter(r.k for r in spark.range(20_000).select(draw.alias("k")).collect())
    for k in range(11):
        p = math.comb(12, k) * math.comb(18, 10 - k) / math.comb(30, 10)
        assert abs(got[k] - 20_000 * p) <= 5 * math.sqrt(20_000 * p * (1 - p)) + 1
    edge = spark.range(3).select(*[sharding.hypergeometric(F.lit(a).cast("bigint"), F.lit(b).cast("bigint"), F.lit(n).cast("bigint"), "e", F.col("id"), 64).alias(f"c{i}") for i, (a, b, n) in enumerate([(0, 5, 3), (5, 0, 3), (4, 4, 8), (4, 4, 0)])]).first()
    assert tuple(edge) == (0, 3, 4, 0)


def test_matrix_has_its_margins(spark):
    s = sharding.Sharding(shards=5, columns=3, partitions=4)
    sizes = [(0, 37), (1, 0), (2, 5), (3, 101)]
    rows = sharding.communication_matrix(spark.createDataFrame(sizes, "part int, n long"), s).collect()
    assert [sum(r.sends) for r in rows] == [n for _, n in sizes]
    columns = np.array([r.sends for r in rows]).sum(0)
    shards = columns.reshape(5, 3).sum(1)
    assert shards.max() - shards.min() <= 1 and columns.max() - columns.min() <= 1 and columns.sum() == 143


def test_equal_rows_are_dealt_anywhere(spark):
    """Pairs of equal rows meet in one shard as often as any two rows do: once in 24 times."""
    rows = spark.range(6000).select((F.col("id") % 3000).alias("doc_id"), F.lit("same").alias("text"))
    got = sharding.shard_documents(rows).toPandas()
    together = got.groupby("doc_id")["shard"].nunique().eq(1).sum()
    assert len(got) == 6000 and abs(together - 3000 / 24) <= 5 * math.sqrt(3000 / 24) and got["shard"].value_counts().nunique() == 1
    hot = spark.range(9000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("x").alias("text"))
    assert sharding.shard_documents(hot).groupBy("shard").count().select("count").distinct().count() == 1


def test_the_matrix_is_drawn_by_its_law(spark):
    """Two groups of partitions: what a partition sends to a shard has the mean and variance of a hypergeometric number."""
    sends = []
    for i in range(60):
        s = sharding.Sharding(shards=2, columns=1, partitions=4, seed=f"law-{i}")
        rows = sharding.communication_matrix(spark.createDataFrame([(p, 50) for p in range(4)], "part int, n long"), s).collect()
        sends += [r.sends[0] for r in rows]
    assert abs(np.mean(sends) - 25) <= 0.01 and 5 < np.var(sends) < 14  # 50 * 1/4 * 150/199 = 9.4


def test_numbered_rows(spark):
    rows = spark.createDataFrame([(1, None)] * 5000 + [(2, "x")] + [(None, "y")] * 2, "times long, block string")
    got = common.numbered(rows, "copy").toPandas()
    assert len(got) == 5003 and sorted(got[got.times == 1]["copy"]) == list(range(5000)) and sorted(got[got.block == "y"]["copy"]) == [0, 1]


# Chat ------------------------------------------------------------------------------------------------------------


def test_layouts_are_told_by_their_fingerprints(spark):
    schema = "prompt string, completion string, system string, instruction string, input string, output string, messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>, note string"
    rows = [("p", "c", None, None, None, None, None, None, "x"), ("p", "c", "s", None, None, None, None, None, None), (None, None, None, "i", "n", "o", None, None, None), (None, None, None, "i", None, "o", None, None, None),
            (None, None, None, None, None, None, [("user", None)], None, None), (None, None, None, None, None, None, None, [("human", "v")], None), ("p", None, None, None, None, None, None, None, None)]
    got = chat.canonical_turns(spark.createDataFrame(rows, schema)).collect()
    assert [r.layout for r in got] == ["prompt", "system_prompt", "instruction_input", "instruction", "messages", "conversations", None]
    assert [len(r.turns) for r in got[:6]] == [2, 3, 2, 2, 1, 1] and got[4].turns[0].text == "" and got[6].turns is None and len({r.fingerprint for r in got}) == 7


@settings(max_examples=25, deadline=None)
@given(turns=st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", ""]), st.text(alphabet="<>|&;[]/sINTima_endtr\n \\é\0", max_size=30)), max_size=5))
def test_formatting_is_reversible(spark, turns):
    records = spark.createDataFrame([(turns,)], "turns array<struct<role:string,text:string>>")
    r = chat.formatted(records).select("formatted", chat.read_back(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [(t.role, t.text) for t in r.back] == turns and r.loss == "".join(t for role, t in turns if role == "assistant")
    assert r.formatted.count("<|im_end|>") == len(turns) == r.formatted.count("<|im_start|>") and "</s>" not in r.formatted and "[INST]" not in r.formatted


def test_conversations_with_nulls_and_ties(spark):
    rows = [(None, 1, "user", None), (None, None, None, "x"), (1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a")]
    got = {r.conv_id: r.n_turns for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {None: 2, 1: 3}


# SimHash ---------------------------------------------------------------------------------------------------------


def test_links_lose_nothing_in_small_or_large_buckets(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 62))
    fps = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (400, 2))} | {int(x) for x in rng.integers(0, 1 << 62, 200)}
    fps |= {x ^ 3 for x in list(fps)[-50:]}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    got = {r.node: r.root for r in components.connected_components(simhash.linked_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
    root = {x: x for x in signed}
    for i, a in enumerate(signed):
        for b in signed[i + 1 :]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2 and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if v == old else v for k, v in root.items()}
    assert {x: got.get(x, x) for x in signed} == root


def test_chains_hold_for_all_near_fingerprints(spark):
    rng = np.random.default_rng(4)
    rows = [(int(np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)).astype(np.int64)),) for n in (1, 2) for _ in range(300)]
    assert spark.createDataFrame(rows, "x long").filter(~simhash.chain_holds(F.col("x"), 4, 2)).count() == 0


def test_near_copies_of_a_large_group(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):  # each copy changes one word: similar to the base, and most to each other
        own = list(words)
        own[int(rng.integers(0, 120))] = f"x{i}"
        rows.append((i, " ".join(own), "s"))
    rows += [(1000 + i, " ".join(f"u{i}_{j}" for j in range(60)), "s") for i in range(40)] + [(2000, "", "s"), (2001, None, "s")]
    got = sorted(r.doc_id for r in simhash.drop_near_copies(documents(spark, rows)).collect())
    assert got == [0, *range(1000, 1040), 2000]


def test_runs_are_compared_block_against_block(spark, monkeypatch):
    """A hub, its variants, which are mostly not similar to each other, and a run of one key that is longer than a block."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(6)
    sets = [np.arange(100, dtype=np.int32)]
    for i in range(150):  # 11 of 100 shingles are others: Jaccard 89 / 111 to the hub, 0.65 or so to each other
        own = np.arange(100, dtype=np.int32)
        own[rng.choice(100, 11, replace=False)] = 1000 + 20 * i + np.arange(11)
        sets.append(own)
    rows = [(key, i, 100, i, i) for key in (1, 2, 3) for i in range(len(sets)) if key < 3 or i < 40]
    texts = [" ".join(f"w{x}" for x in s) for s in sets]  # shingles of one word
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    sketches = frame([(i, simhash.sketch(simhash.short(simhash.shingle_hashes([t], 1)[0])).tolist()) for i, t in enumerate(texts)], "no long, sketch array<long>")
    named = [(i, f"t{i}") for i in range(len(sets))]
    links = simhash._linked_runs(frame(rows, "key long, no long, n long, root long, met long"), sketches, frame([(f"t{i}", t) for i, t in enumerate(texts)], "id string, text string"), frame(named, "no long, id string"), 1, 0.8)
    got = {r.node: r.root for r in components.connected_components(links).collect()}
    assert got == {i: 0 for i in range(len(sets))}


def test_a_hub_joins_the_variants_of_a_long_run(spark):
    """3,000 variants, two of 110 words changed at random: each is similar to the hub (0.83), few are to each other."""
    rng = np.random.default_rng(8)
    rows = [(0, " ".join(f"w{i}" for i in range(110)), "s")]
    for k in range(3000):
        own = [f"w{i}" for i in range(110)]
        for p in rng.choice(np.arange(4, 106), 2, replace=False):
            own[p] = f"x{k}_{p}"
        rows.append((k + 1, " ".join(own), "s"))
    assert [r.doc_id for r in simhash.drop_near_copies(documents(spark, rows)).collect()] == [0]


def test_near_copies_of_every_kind_of_edit(spark):
    """Texts of 30 to 2,000 words, each with a copy cut at the end, at the front, or with words changed, at 0.8 or little above."""
    rng = np.random.default_rng(9)
    rows = []
    for k in range(240):
        n = int(rng.integers(30, 2000) if k % 4 else rng.integers(30, 120))
        own = [f"v{int(x)}" for x in rng.integers(0, 30_000, n)]
        cut = int(0.2 * (n - 4))
        other = list(own)
        for p in rng.choice(np.arange(2, n - 2), max(1, n // 47), replace=False):
            other[p] = f"y{k}_{p}"
        rows += [(2 * k, " ".join(own), "s"), (2 * k + 1, " ".join([own[: n - cut], own[cut:], other][k % 3]), "s")]
    sets = [set(simhash.shingles(r[1].encode().split(), 5)) for r in rows]
    similar = [len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    want = [i for i in range(480) if i % 2 == 0 or not similar[i // 2]]
    assert sum(similar) > 200 and sorted(r.doc_id for r in simhash.drop_near_copies(documents(spark, rows)).collect()) == want


@settings(max_examples=60, deadline=None)
@given(a=st.sets(st.integers(0, 40), max_size=30), b=st.sets(st.integers(0, 40), max_size=30), often=st.sets(st.integers(0, 40), min_size=1))
def test_similar_sets_share_a_key(a, b, often):
    common, seen = np.array(sorted(often), np.uint64), np.arange(3, 3 + len(often))
    keys = [set(simhash.prefix(np.array(sorted(x), np.uint64) + np.uint64(1), 0.8, common, seen).tolist()) for x in (a, b)]
    assert keys[0] & keys[1] or len(a & b) < 0.8 * len(a | b)
    x, y = (simhash.sketch(simhash.short(mix64(np.array(sorted(s), np.uint64))))[None, :] for s in (a, b))
    assert 0 <= simhash.differences(x, y, np.array([len(a ^ b)]))[0] <= len(a ^ b)


def test_near_copies_with_repeated_shingles(spark):
    w = [f"w{i}" for i in range(79)]
    repeated = [*w, *w[20:34], *[f"z{i}" for i in range(7)]]  # Jaccard 0.87 of distinct shingles, 0.78 if repeats count
    rows = [(1, " ".join(w), "s"), (2, " ".join(repeated), "s"), (3, " ".join(f"d{i}" for i in range(90)), "s"), (4, " ".join(f"d{i % 90}" for i in range(180)), "s")]
    assert sorted(r.doc_id for r in simhash.drop_near_copies(documents(spark, rows)).collect()) == [1, 3]


def test_sketches_of_two_sizes_are_folded():
    rng = np.random.default_rng(11)
    a = np.unique(rng.integers(0, 1 << 32, 1100).astype(np.uint32))
    b = np.union1d(a[:1000], rng.integers(0, 1 << 32, 20).astype(np.uint32))
    x, y = simhash.sketch(a), simhash.sketch(b)
    assert len(x) == 2 * len(y) and simhash.differences(simhash.folded(x[None, :], len(y)), y[None, :], np.array([len(np.setxor1d(a, b))]))[0] > 0


def test_pigeonring_prunes_nothing_within_the_budget():
    rng = np.random.default_rng(12)
    a = rng.integers(-(1 << 62), 1 << 62, (500, 16))
    b = a.copy()
    for i in range(500):
        for bit in rng.choice(1024, i % 130, replace=False):
            b[i, bit // 64] ^= np.int64(1) << np.int64(bit % 64)
    assert simhash.differences(a, b, np.full(500, 100.0)).tolist() == [i % 130 if i % 130 <= 100 else -1 for i in range(500)]


def test_links_between_blocks_join_all_similar_sets():
    rng = np.random.default_rng(13)
    sets = []
    for k in range(120):
        base = np.arange(1000 * (k // 6), 1000 * (k // 6) + 60 + 600 * (k % 4 == 0))
        sets.append(np.unique(np.where(rng.random(len(base)) < 0.06, rng.integers(0, 1 << 30, len(base)), base)).astype(np.uint32))
    similar = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
    root = list(range(120))
    for i in range(120):
        for j in range(i):
            if similar(sets[i], sets[j]) and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    a, b = (lambda: simhash.Block.of_sets(list(range(60)), list(range(60)), sets[:60])), (lambda: simhash.Block.of_sets(list(range(60, 120)), list(range(60, 120)), sets[60:]))
    x, y = a(), b()
    found = [*simhash.links_between(x, x, 0.8), *simhash.links_between(y, y, 0.8), *simhash.links_between(a(), b(), 0.8)]
    label = list(range(120))
    for i, j in found:
        assert similar(sets[i], sets[j])
        old, new = max(label[i], label[j]), min(label[i], label[j])
        label = [new if r == old else r for r in label]
    assert label == root and len(set(root)) < 100


# Media -----------------------------------------------------------------------------------------------------------


def _png() -> bytes:
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def _samples() -> dict[str, bytes]:
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "b")
    box = lambda k, b=b"": struct.pack(">I", 8 + len(b)) + k + b
    return {
        "image/png": _png(), "audio/wav": media.as_wav(b"\x80" * 192), "application/zip": z.getvalue(), "image/gif": b"GIF89a\1\0\1\0\0\0\0,\0\0\0\0\1\0\1\0\0\2\2D\1\0;",
        "image/bmp": b"BM" + struct.pack("<IHHIIiiHHIIiiII", 58, 0, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4, "video/mp4": box(b"ftyp", b"isom\0\0\0\0") + box(b"moov", box(b"free")),
        "application/pdf": b"%PDF-1.4\nx\nstartxref\n0\n%%EOF", "image/jpeg": b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x04cd\x01\xff\x00\x02\xff\xd9",
        "audio/ogg": b"OggS\0\6" + b"\0" * 20 + b"\1\3abc", "audio/mpeg": b"ID3\3\0\0\0\0\0\2ab", "audio/flac": b"fLaC\x80\0\0\x22" + b"\0" * 34,
    }


@pytest.mark.parametrize("kind", sorted(media.SIGNATURES and set(media.VALIDATORS)))
def test_sniffing(spark, kind):
    whole = _samples()[kind]
    found = media.automaton()
    assert (0, len(whole), kind) in media.sniff(whole, found)
    inside = media.sniff(b"pre" + whole + (b"" if kind == "audio/flac" else b"post"), found)
    assert (3, len(whole), kind) in inside
    if kind not in ("audio/mpeg", "audio/flac"):
        assert (0, len(whole), kind) not in media.sniff(whole[:-1], found)


def test_declared_types_are_corrected_and_media_carved(spark):
    png, wav = _png(), media.as_wav(b"\x80" * 192)
    rows = [(1, png, "image/jpeg"), (2, b"text " + png + b" and " + wav, None), (3, None, "x"), (4, b"", None), (5, wav, "audio/wav")]
    got = {r.id: r for r in media.sniff_media(spark.createDataFrame(rows, "id long, content binary, declared string")).collect()}
    assert got[1].type == "image/png" and not got[1].declared_ok and got[5].declared_ok and got[3].type == media.UNKNOWN and got[4].length == 0
    assert [(c.offset, c.length, c.type) for c in got[2].carved] == [(5, len(png), "image/png"), (10 + len(png), len(wav), "audio/wav")]


def test_digest_carves_media_out_of_texts(spark):
    pdf = "%PDF-1.4\nx\nstartxref\n0\n%%EOF"
    got = {r.doc_id: r for r in media.media_digest(documents(spark, [(1, f"some {pdf} text", ""), (2, "%PDF-1.4 " * 20_000, ""), (3, "PK\x03\x04" * 20_000, "")])).collect()}
    assert got[1].feature == f"application/octet-stream>audio/wav+{44 + 192};application/pdf@{44 + 5}+{len(pdf)}"
    assert got[2].feature.count(";") == got[3].feature.count(";") == 0


# Packing and quality ---------------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(items=st.lists(st.tuples(st.integers(1, 100), st.integers(0, 3), st.integers(0, 5)), max_size=60), per_source=st.integers(1, 3))
def test_best_fit_takes_the_tightest_compatible_bin(items, per_source):
    p = packing.Packing(capacity=100, per_source=per_source)
    got = packing.best_fit(*(list(x) for x in zip(*items, strict=True)), p) if items else []
    bins: list[list[tuple]] = []
    for item, b in zip(items, got, strict=True):
        room = [100 - sum(x[0] for x in each) for each in bins]
        fits = [i for i, each in enumerate(bins) if room[i] >= item[0] and room[i] > 0 and sum(x[1] == item[1] for x in each) < per_source and all(x[2] != item[2] for x in each)]
        assert b == (min(fits, key=lambda i: (room[i], i)) if fits else len(bins))
        if b == len(bins):
            bins.append([])
        bins[b].append(item)


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(["a", "b", "é", "\n", "#$"]), max_size=60).map(" ".join), min_size=1, max_size=5))
def test_repetition_measures(texts):
    got = quality.measure(texts)
    for text, r in zip(texts, got.itertuples(), strict=True):
        w = text.split()
        for n in quality.REPEAT_LIMITS:
            grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
            twice = {g for g, k in collections.Counter(grams).items() if k > 1}
            covered = {i + j for i, g in enumerate(grams) if g in twice for j in range(n)}
            assert getattr(r, f"repeated_chars_{n}") == sum(len(w[i]) for i in covered)
            if n == 8:
                assert r.n_repeat_words == len(covered)
        lines = [x for x in text.split("\n") if x.strip()]
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_symbols == sum(c in "#*$%&|<>" for c in text) and r.word_chars == sum(map(len, w))


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
def test_sums_before(spark, n):
    a = list(range(5, 5 + n))
    got = spark.createDataFrame([(a,)], "a array<bigint>").select(common.sums_before(F.col("a")).alias("s")).first().s
    assert got == [sum(a[:i]) for i in range(n)]


def test_a_conversation_of_very_many_turns(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é<|im_end|> "), F.col("id").cast("string")).alias("text"))
    r = chat.format_conversations(rows).first()
    assert r.n_turns == 20_000 and r.loss_chars == sum(len(f"é<|im_end|> {i}") for i in range(1, 20_000, 2)) and len(r.loss_spans) == 10_000


def test_slices_cover_everything():
    assert list(common.slices([5, 1, 9, 1, 1], 6)) == [(0, 2), (2, 3), (3, 5)] and list(common.slices([], 6)) == []
