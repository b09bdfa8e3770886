"""URL filter, licences, language."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from tallyweave.llm import langid, licences, url_filter
from tallyweave.llm.queries import LISTED_SITES, URL_RULES


def test_urls(spark):
    urls = [
        (1, "https://WWW.Example.com/en/1?utm_source=x#top"), (2, "http://shop.example.com/en/2"), (3, "http://a.net/es/3"), (4, "http://a.net/de/3"), (5, None), (6, "no scheme"),
        (7, "http://spam-farm.org/x/"), (8, "http://www.spam-farm.org/x?ref=1"), (9, "http://spam-farm.org/x"), (10, "http://example.com?q"), (11, "://"), (12, ""), (7, "http://spam-farm.org/x/"),
    ]
    pages = spark.createDataFrame([(i, u, "html", "clash") for i, u in urls], "page_id long, url string, html string, rule string")
    rows = url_filter.addressed(pages)
    got = {r.page_id: r for r in url_filter.filter_urls(rows, URL_RULES, url_filter.listed_urls(rows, LISTED_SITES)).collect()}
    assert len(got) == 12
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert (got[2].rule, got[2].verdict) == ("example.com/en/", "block")
    assert (got[3].rule, got[3].verdict) == ("net/es/", "block")
    assert (got[4].rule, got[4].verdict) == (None, "allow")
    assert [(got[i].host, got[i].path, got[i].verdict) for i in (5, 6, 11, 12)] == [("", "", "allow")] * 4
    assert [got[i].verdict for i in (7, 8, 9)] == ["block"] * 3
    assert got[10].path == "" and got[10].rule is None


def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.range(2000).selectExpr("concat('u', id) as url")
    keyed = spark.range(20000).selectExpr("id", "concat('u', id) as k")
    got = url_filter.on_list(keyed, "k", listed).filter("listed").select("id").collect()
    assert {r.id for r in got} == set(range(2000))


def test_urls_of_an_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    rows = url_filter.addressed(pages)
    assert url_filter.filter_urls(rows, URL_RULES, url_filter.listed_urls(rows, LISTED_SITES)).count() == 0


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_urls_of_a_given_list(spark, monkeypatch, broadcast):
    """A list of its own, hosts without any telling label, columns named like the filter's own, addresses that are null."""
    monkeypatch.setattr(url_filter, "BROADCAST_BLOCKS", broadcast)
    keyed = spark.createDataFrame([(i, f"h{i % 50}.org/{i}" if i % 3 else None, "clash") for i in range(600)], "w0 long, m0 string, block string")
    listed = spark.createDataFrame([(f"h{i % 50}.org/{i}",) for i in range(0, 1200, 4)], "url string")
    got = {r.w0: r.listed for r in url_filter.on_list(keyed, "m0", listed).collect()}
    assert got == {i: i % 3 != 0 and i % 4 == 0 for i in range(600)}


MIT = """MIT License

Copyright (c) 2020 Somebody

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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD2 = """Copyright (c) 2020, Somebody
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = f"""BSD 3-Clause License

{BSD2}
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
"""
APACHE = """Copyright 2020 Somebody

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
GPL3 = GPL2.replace("software; you", "software: you").replace("Foundation; either version 2", "Foundation, either version 3")
LGPL = GPL2.replace("program", "library").replace("General", "Lesser General").replace("version 2", "version 2.1")
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
FULL = {"MIT": MIT, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "Apache-2.0": APACHE, "GPL-2.0-or-later": GPL2, "GPL-3.0-or-later": GPL3, "LGPL-2.1-or-later": LGPL, "MPL-2.0": MPL}


def test_published_texts(spark):
    """As published, commented in three ways, on one line, without blank lines, between other words, and all in one."""
    rows = []
    for name, text in FULL.items():
        lines = text.split("\n")
        forms = [text, "\n".join(f"# {x}".rstrip() for x in lines), "/*\n" + "\n".join(f" * {x}" for x in lines) + " */\nint x;", "\r\n".join(f"// {x}" for x in lines)]
        forms += [" ".join(text.split()), "\n".join(x for x in lines if x), f"Some words before\n{text}\nand after"]
        rows += [(f, [name]) for f in forms]
    rows.append(("\n\n".join(FULL.values()), list(FULL)))
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    for r in licences.scan(docs).collect():
        assert sorted(r.licences) == sorted(rows[r.doc_id][1]), rows[r.doc_id][0]


ADVERTISING = """3. All advertising materials mentioning features or use of this software
   must display the following acknowledgement:
   This product includes software developed by the organization."""


def _clauses(spark, text):
    return licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().licences


def test_advertising_clause_makes_another_licence(spark):
    """The published text with four clauses, its acknowledgement with and without a word of licences; then no known clause at all."""
    third = BSD3.index("3. Neither")
    four = BSD3[:third] + ADVERTISING + "\n\n4" + BSD3[third + 1 :]
    assert _clauses(spark, four) == ["BSD-4-Clause"]
    assert _clauses(spark, four.replace("by the organization", "by the organization, licensed by X")) == ["BSD-4-Clause"]
    assert _clauses(spark, four.replace("acknowledgement", "acknowledgment")) == ["BSD-4-Clause"]
    other = BSD3[:third] + "3. No copyright notice may be shown.\n\n4" + BSD3[third + 1 :]
    assert _clauses(spark, other) == []
    assert _clauses(spark, BSD2) == ["BSD-2-Clause"] and _clauses(spark, BSD3) == ["BSD-3-Clause"]


def test_every_known_sentence_has_a_cue():
    for sentence in licences.SENTENCES.values():
        assert any(c in sentence for c in licences.CUES) and any(c in sentence for c in licences.CUE_WORDS)
    assert {i for _, run in licences.RULES for i in run} <= set(licences.SENTENCES)


@pytest.mark.parametrize(
    ("text", "found", "unknown"),
    [
        ("Words.\nReleased under the MIT License.\nMore.", ["MIT"], 0),
        ("A | b |\nLicensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"], 0),
        ("Licensed under the Apache License, Version 2.0. Released under the MIT License.", ["Apache-2.0", "MIT"], 0),
        ("This program is free\nsoftware: you can", [], 0),
        ("Under some other licence we know nothing of.", [], 1),
        ("A licence that\nwe don't know.\n\nNor that other licence", [], 2),
        ("// SPDX-License-Identifier: MIT\nint x;", ["MIT"], 0),
        ("/* SPDX-License-Identifier: GPL-2.0-only */", ["GPL-2.0-only"], 0),
        ("# SPDX-License-Identifier: GPL-3.0-or-later\r\n# more", ["GPL-3.0-or-later"], 0),
        ("SPDX-License-Identifier: MIT OR Apache-2.0\nnext", ["Apache-2.0", "MIT"], 0),
        ("SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0\nnext", [], 1),
        ("SPDX-License-Identifier: Nobody-1.0", [], 1),
        ("SPDX-License-Identifier: BSD-3-Clause\nSPDX-License-Identifier: Zlib\n", ["BSD-3-Clause", "Zlib"], 0),
        ("Licensed under the Apache License, Version 2.0 or the MIT license.", ["Apache-2.0 OR MIT"], 0),
        ("Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:", ["Zlib"], 0),
        ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"], 0),
        ("This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0", ["EPL-2.0"], 0),
        ("Eclipse Public License - v 2.0", ["EPL-2.0"], 0),
        ("CC0 1.0 Universal", ["CC0-1.0"], 0),
        ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007", ["AGPL-3.0"], 0),
        ("it under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.", ["GPL-2.0-only"], 0),
        ("", [], 0),
        (None, [], 0),
        ("x" * 100_000, [], 0),
        (("A licence " + "x" * 50 + ". ") * 2000, [], 2000),
    ],
)
def test_licences(spark, text, found, unknown):
    row = licences.scan(spark.createDataFrame([(1, text, "clash")], "doc_id long, text string, licences string")).first()
    assert row.licences == found and row.n_unknown == unknown


def test_licences_of_no_and_repeated_rows(spark, empty):
    assert licences.scan(empty).count() == 0
    rows = licences.scan(spark.createDataFrame([(1, MIT)] * 3, "doc_id long, text string")).collect()
    assert len(rows) == 3 and all(r.licences == ["MIT"] for r in rows)


def test_licence_rules_go_in_order(spark):
    from pyspark.sql import functions as F

    ids = spark.createDataFrame([(["GPLfree", "GPLterms", "GPLv3later", "GPLnoWarranty", "GPLreceived", "MITrel"],)], "ids array<string>")
    assert ids.select(licences.licences(F.col("ids"))).first()[0] == ["GPL-3.0-or-later", "MIT"]


def grams_by_hand(text):
    """3- and 4-grams of each word with its two ends as one character each."""
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            w = f"\0{word}\0"
            out += [w[i : i + n] for n in langid.LENGTHS for i in range(len(w) - n + 1)]
            word = ""
    return out


def gram_hash(gram):
    h = len(gram)
    for c in gram:
        h = (h * 0x100000001B3 + ord(c)) % 2**64
    return (h ^ h >> 15) * 0x9E3779B97F4A7C15 % 2**64


def test_language_against_counting_by_hand(spark, docs):
    """The model is that of plain counts of all learned texts, and its predictions those of sets of n-grams."""
    from pyspark.sql import functions as F

    learned = docs.filter((langid.crc32_mod(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull()).select("text", "lang").collect()
    counts = {}
    for text, lang in learned:
        counts.setdefault(lang, Counter()).update(map(gram_hash, grams_by_hand(text or "")))
    profiles = {k: set(sorted(c, key=lambda g: (-c[g], g - 2**64 if g >= 2**63 else g))[: langid.KEPT]) for k, c in counts.items()}
    order = sorted(profiles, key=lambda k: (-sum(lang == k for _, lang in learned), k))
    model = langid.learn(docs.filter(langid.crc32_mod(F.col("doc_id"), 4) != 2))
    assert model.languages == order
    want = langid.build(order, {k: np.array(sorted(v), np.uint64) for k, v in profiles.items()})
    assert (model.cells == want.cells).all()
    texts = {i: t for i, t in docs.select("doc_id", "text").collect()}
    rows = langid.identify(docs, langid.crc32_mod(F.col("doc_id"), 4) != 2).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is None:
            continue
        hits = list(map(gram_hash, grams_by_hand(texts[r.doc_id] or "")))
        if not any(c.isalpha() for c in texts[r.doc_id] or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        true = [sum(h in profiles[k] for h in hits) for k in order]
        if abs(true[0] - true[1]) > 0.02 * len(hits):  # beyond what false positives can turn
            assert r.lang_pred == order[int(np.argmax(true))]
            assert abs(r.score - max(true) / sum(true)) < 0.03


def test_language_filters_hold_what_was_put_in():
    h = np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64)
    m = langid.build(["a", "b"], {"a": h[:250], "b": h[250:]})
    mask = np.full(500, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in langid._cells(h, len(m.cells)):
        mask &= m.cells[at]
    assert (mask[:250] & np.uint64(1) == 1).all() and (mask[250:] & np.uint64(2) == 2).all()
    assert m.wrong.max() < 0.01


def test_language_held_out(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, langid.crc32_mod(F.col("doc_id"), 4) != 2).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.filter("held_out").selectExpr("avg(cast(lang_pred = lang as double)) as a").first().a > 0.98


def test_language_of_nothing(spark, empty, docs):
    from pyspark.sql import functions as F

    assert langid.identify(empty, F.lit(True)).count() == 0
    assert langid.fluent(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, F.lit(False)).collect()} == {"und"}


def test_fluent_keeps_what_a_plain_count_keeps(spark, docs):
    """A document stays if the winning language has at least 15 of 100 of its n-grams, false positives taken off."""
    letters = docs.select("doc_id", "text", "lang").filter("doc_id is not null").dropDuplicates(["doc_id"])
    noise = [(100000 + i, " ".join(["qzx" * (1 + i % 3), "vkq", "xjz"] * i), None) for i in range(1, 8)]
    rows = letters.unionByName(spark.createDataFrame(noise, letters.schema))
    model = langid.learn(rows)
    kept = {r.doc_id for r in langid.fluent(rows).collect()}
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    cells = [model.cells, *model.more]
    for doc_id, text in texts.items():
        hits = list(map(gram_hash, grams_by_hand(text)))
        if not any(c.isalpha() for c in text):
            assert doc_id not in kept
            continue
        at = langid._cells(np.array(hits, np.uint64), len(model.cells))
        share = []
        for k in range(len(model.languages)):
            bits = [np.all([(cells[k // 64][x[g]] >> np.uint64(k % 64)) & np.uint64(1) for x in at]) for g in range(len(hits))]
            share.append((sum(bits) / len(hits) - model.wrong[k]) / (1 - model.wrong[k]))
        if abs(max(share) - 0.15) > 1e-9:
            assert (doc_id in kept) == (max(share) >= 0.15)
    assert not {100000 + i for i in range(1, 8)} & kept and len(kept) > 20


def test_fluent_without_languages_keeps_all(spark, docs):
    from pyspark.sql import functions as F

    for lang in (None, "und"):
        rows = docs.withColumn("lang", F.lit(lang).cast("string"))
        assert langid.fluent(rows).count() == docs.count()


def test_more_languages_than_a_mask_word_has_bits(spark):
    rng = np.random.default_rng(4)
    letters = [[chr(0x4E00 + 10 * k + i) for i in range(10)] for k in range(70)]
    rows = [(10 * k + i, " ".join("".join(rng.choice(letters[k], 5)) for _ in range(30)), f"l{k:02}") for k in range(70) for i in range(10 - (k > 63))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert len(model.languages) == 70
    assert langid.predict(model, [t for _, t, _ in rows])[0] == [lang for _, _, lang in rows]
    assert langid.fluent(docs).count() == len(rows)
