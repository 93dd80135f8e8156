"""Chat, licences, quality, line and exact dedup on small inputs and edge cases."""

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import brute
from tests.oracle import SF, compare
from wattline.llm import chat, exact, licenses, line_dedup, quality, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in texts], DOCS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_agree_with_duckdb(spark, name):
    compare(queries.queries()[name](spark, SF), queries.oracle_sql()[name])


# --- chat -----------------------------------------------------------------------

CHAT = "conv_id long, turn long, role string, text string, formatted string"


def chats(spark, turns):
    return spark.createDataFrame([(*t, "clash") for t in turns], CHAT)


def test_chat_machine_and_order(spark):
    rows = chats(spark, [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "assistant", "x"), (3, 0, "system", "s"), (4, 0, "user", None), (4, 0, "user", None), (None, 0, None, "z")])
    got = {r.conv_id: r for r in chat.format_chats(rows).collect()}
    assert got[1].valid and got[1].formatted == "[INST]a[/INST]<s>b</s>"
    assert [s.text for s in got[1].segments if s.loss] == ["b"]
    assert not got[2].valid and got[2].error_turn == 0
    assert not got[3].valid and got[3].error_turn == 1
    assert got[4].n_turns == 2 and got[4].error_turn == 1
    assert got[None].formatted == "[ROLE][TEXT]z[/ROLE]"
    assert chat.format_chats(rows.limit(0)).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool [ROLE]", ""]), st.text(alphabet="\\<>[]/sINSTROLEYX \n", max_size=24)), min_size=1, max_size=12))
def test_chat_round_trip(spark, turns):
    marks = chat.control_strings(chat.TEMPLATE)
    turns = [*turns, *[("user", m + "\\" + m[0] + "\\\\" + m[1:]) for m in marks]]
    out = chat.format_chats(chats(spark, [(7, i, r, t) for i, (r, t) in enumerate(turns)]))
    back = out.select(chat.read_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("segments")).alias("l")).first()
    assert [(t.role, t.text) for t in back.t] == turns
    assert back.l == "".join(t for r, t in turns if r == "assistant")


def test_chat_rejects_templates_that_cannot_be_read_back(spark):
    import copy

    rows = chats(spark, [(1, 0, "user", "a")])
    for role, mark in (("user", "x"), ("user", "<\\s>"), ("user", "<s>"), ("assistant", "[INST]"), ("system", "a<s>b"), ("user", "")):
        bad = copy.deepcopy(chat.TEMPLATE)
        bad["turns"][role]["open"] = mark
        with pytest.raises(ValueError, match="template"):
            chat.format_chats(rows, bad)


# --- licences -------------------------------------------------------------------

# The licence texts below are fixed values, laid out as their files have them.
MIT = """MIT License

Copyright (c) 2020 Some Body

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""


def test_license_rules(spark):
    texts = [(1, MIT), (2, "x y\nReleased under the MIT License.\nmore"), (3, "Licensed under CC BY-NC 4.0. All rights reserved."), (4, "no license here"), (5, None), (6, ""), (7, 'THE SOFTWARE IS PROVIDED "AS IS", without permission'), (8, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.")]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, texts)).collect()}
    assert got[1].licenses == ["MIT"] and got[1].n_known == 5 and got[1].n_unclaimed == 0
    assert got[2].licenses == ["MIT"] and got[3].licenses == ["CC-BY-NC-4.0", "all-rights-reserved"]
    assert [got[i].status for i in (4, 5, 6, 7)] == ["none"] * 4
    assert got[8].status == "unclaimed" and got[8].n_unclaimed == 1


SAMPLES = {
    "Apache-2.0": """
# Copyright 2019 The Authors
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
""".replace("# ", "").replace("#", ""),
    "BSD-3-Clause": """Copyright (c) Jane Doe
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of Some University nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "MPL-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */""",
    "EPL-2.0": """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/

SPDX-License-Identifier: EPL-2.0""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software.""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:""",
    "MIT": MIT,
}


def test_license_texts_as_their_files_have_them(spark):
    """Recall on texts that are not built from the table: every one is found."""
    names = list(SAMPLES)
    got = {r.doc_id: r for r in licenses.scan(docs(spark, [(i, f"intro words.\n\n{SAMPLES[n]}\n\nmore words") for i, n in enumerate(names)])).collect()}
    for i, n in enumerate(names):
        assert n in got[i].licenses and set(got[i].licenses) <= {n, "all-rights-reserved"}, (n, got[i])
        assert got[i].n_unclaimed <= 1 + (n == "BSD-3-Clause"), (n, got[i])


HEADER = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""


@pytest.mark.parametrize("first, each, last", [("/*\n", " * ", "\n */\nint x;"), ("", "// ", "\nint x;"), ("#!/bin/sh\n", "# ", "\nls"), ("", "-- ", ""), ("<!--\n", "  ", "\n-->"), ("/**\n", "", " */")])
def test_licenses_in_comments(spark, first, each, last):
    text = first + "\n".join((each + line).rstrip() for line in HEADER.split("\n")) + last
    got = licenses.scan(docs(spark, [(1, text), (2, text.replace("\n", "\r\n"))])).collect()
    for r in got:
        assert r.licenses == ["Apache-2.0"] and r.n_known == 5 and r.n_unclaimed == 0, r


def test_equal_notices_side_by_side_are_all_claimed(spark):
    grant, notice = MIT.index("Permission is hereby"), "Released under the MIT License.\n"
    rows = [(1, notice * 2), (2, notice * 5), (3, "\n\n".join([MIT[grant:]] * 3)), (4, "Licensed under CC BY 4.0. " * 4)]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, rows)).collect()}
    assert {i: (r.n_known, r.n_unclaimed) for i, r in got.items()} == {1: (2, 0), 2: (5, 0), 3: (9, 0), 4: (4, 0)}


@pytest.mark.parametrize("line, want", [
    ("MIT OR Apache-2.0", ["MIT", "Apache-2.0"]), ("(MIT AND Apache-2.0)", ["MIT", "Apache-2.0"]), ("GPL-2.0-or-later", ["GPL-2.0-or-later"]),
    ("GPL-2.0-or-later WITH Classpath-exception-2.0", ["GPL-2.0-or-later"]), ("GPL-3.0-or-later OR MIT", ["GPL-3.0-or-later", "MIT"]), ("Unheard-Of-1.0", []),
])
def test_spdx_expressions(spark, line, want):
    got = licenses.scan(docs(spark, [(1, f"// SPDX-License-Identifier: {line}\ncode();"), (2, f"/* SPDX-License-Identifier: {line} */\ncode();")])).collect()
    assert [sorted(r.licenses) for r in got] == [sorted(want)] * 2


#: How files begin or speak of their licences, not taken from the table of sentences.
HEADS = {
    "Apache-2.0": "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS",
    "GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation",
    "GPL-2.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\nEveryone is permitted",
    "AGPL-3.0": "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n",
    "BSL-1.0": "//          Copyright Joe Coder 2004 - 2006.\n// Distributed under the Boost Software License, Version 1.0.\n//    (See accompanying file LICENSE_1_0.txt or copy at\n//          https://www.boost.org/LICENSE_1_0.txt)",
    "CC-BY-4.0": "## Licence\n\nThis work is licensed under a Creative Commons Attribution 4.0\nInternational License.",
    "CC-BY-NC-SA-4.0": "Attribution-NonCommercial-ShareAlike 4.0 International\n\n=====",
    "MPL-2.0": "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions",
}


def test_heads_of_licence_files(spark):
    names = list(HEADS)
    got = {names[r.doc_id]: r.licenses for r in licenses.scan(docs(spark, [(i, HEADS[n]) for i, n in enumerate(names)])).collect()}
    assert got == {n: [n] for n in names}


def test_the_twin_agrees_on_licences_of_every_kind(spark, tmp_path):
    texts = [*SAMPLES.values(), *HEADS.values(), HEADER, "/*\n * " + HEADER.replace("\n", "\n * ") + "\n */", MIT * 3, "SPDX-License-Identifier: (MIT OR GPL-2.0-or-later) AND BSL-1.0", "Released under the MIT License.\n" * 4, "", None, "#\n*\n--\n", "licensed; *x*\n** y"]
    docs(spark, list(enumerate(texts))).write.parquet(str(tmp_path / "documents.parquet"))
    compare(queries.op2_license_scan(spark, str(tmp_path)), queries.oracle_sql()["op2_license_scan"], str(tmp_path))


def test_license_edges(spark):
    two = MIT + "\n\n" + SAMPLES["ISC"]
    rows = [(1, two), (1, two), (None, MIT), (2, "filler text here.\n" * 50_000 + SAMPLES["Zlib"]), (3, "2.\n3.\na.\nlicense")]
    df = docs(spark, rows).withColumns({c: F.lit("x") for c in ("lines", "joined", "licenses", "n_known", "status")})
    got = licenses.scan(df)
    found = sorted((str(r.doc_id), tuple(r.licenses)) for r in got.collect())
    assert found == [("1", ("MIT", "ISC"))] * 2 + [("2", ("Zlib",)), ("3", ()), ("None", ("MIT",))]
    assert got.columns == ["doc_id", "licenses", "n_known", "n_unclaimed", "status"] and licenses.scan(df.limit(0)).count() == 0


# --- quality --------------------------------------------------------------------


def test_quality_measures_and_policies(spark):
    loop = " ".join(["a b c d e f g"] * 6)
    texts = [(1, None), (2, ""), (3, "w " * 9), (4, loop), (5, "one two three four five six seven eight nine ten"), (6, "#$% " * 20), (7, "\n".join(["same line here"] * 8)), (8, "x" * 30_000), (9, "a b c d e")]
    long = " ".join(str(i % 997) for i in range(30_000))
    texts.append((10, long))
    book = quality.ledger(docs(spark, texts))
    got = {r.doc_id: r for r in quality.judge(book).collect()}
    for i, t in texts:
        assert got[i].n_words == len(brute.words(t)) and got[i].n_repeat_words == brute.repeat_words(t), i
    assert got[1].base_failed and got[4].base_failed and not got[5].base_failed and got[5].kept
    assert not got[6].kept and got[7].n_dup_lines == 7
    effect = {r.rule: (r.n_failed, r.n_failed_alone) for r in quality.ablation(book).collect()}
    bits = [r.fail_bits for r in book.collect()]
    for rule in quality.RULES:
        assert effect[rule] == (sum(b & quality.bit(rule) > 0 for b in bits), sum(b == quality.bit(rule) for b in bits))
    kept = quality.keep_good(docs(spark, texts))
    assert {r.doc_id for r in kept.collect()} == {i for i in got if got[i].kept} and kept.columns == docs(spark, []).columns
    assert quality.judge(quality.ledger(docs(spark, []))).count() == 0


# --- exact dedup ----------------------------------------------------------------


def test_exact_groups_compare_bytes(spark):
    texts = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (5, ""), (None, "a"), (9, "A")]
    weak = lambda t: F.lit("00")  # noqa: E731  every text collides
    for hash128 in (F.md5, weak):
        got = sorted(map(tuple, exact.exact_groups(docs(spark, texts), keep="largest", hash128=hash128).collect()), key=str)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want = [(1, 2, 3, False, sha("a")), (2, 2, 3, True, sha("a")), (None, 2, 3, False, sha("a")), (3, 3, 1, True, sha("b")), (4, 5, 3, False, sha("")), (5, 5, 3, True, sha("")), (5, 5, 3, True, sha("")), (9, 9, 1, True, sha("A"))]
        assert got == sorted(want, key=str)
    left = exact.drop_copies(docs(spark, texts))
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "3", "4", "9"] and left.columns == docs(spark, []).columns
    assert exact.exact_groups(docs(spark, [])).count() == 0
    again = docs(spark, [(1, "a"), (1, "a"), (2, "a"), (None, "n"), (None, "n"), (3, "b")]).withColumns({c: F.lit(1) for c in ("_gone", "_doc_id", "_text_sha256", "h", "t")})
    left = exact.drop_copies(again)
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == [("1", "a"), ("3", "b"), ("None", "n")] and left.columns == again.columns


# --- line dedup -----------------------------------------------------------------


def near_lines(a, b):
    """The edit bound, in plain Python, on two word lists."""
    if max(len(a), len(b)) >= 10:
        return brute.edit_one(a, b)
    a, b = list(" ".join(a)), list(" ".join(b))
    return max(len(a), len(b)) >= 10 and brute.edit_one(a, b)


def check_lines(spark, texts, df=None):
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, texts) if df is None else df).collect()}
    seen = []
    for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0])):
        kept, copies, near = [], 0, 0
        for line in (t or "").split("\n") if t is not None else []:
            w = brute.words(line)
            if w and w in seen:
                copies += 1
            elif w and any(near_lines(w, s) for s in seen):
                near += 1
            else:
                kept.append(line)
            if w:
                seen.append(w)
        assert (got[i].n_copies, got[i].n_near) == (copies, near), (i, t)
        assert got[i].text == (None if t is None else "\n".join(kept)), i


def test_line_dedup_matches_brute_force(spark):
    base = [f"w{i}" for i in range(12)]
    lines = [base, [*base[:3], "X", *base[4:]], base[:5] + base[6:], [*base, "tail"], ["head", *base], [*base[:3], "X", "Y", *base[5:]], ["short", "line"], ["short", "lone"], base[::-1], [*base[:3], "Z", *base[4:]]]
    lines += [["a", "line"], ["a", "lone"], ["nine", "chars"], ["nin", "chars"], ["ninechars"], ["ninechar"], ["tenletters"], ["tenletter"], ["\U0001f600enletters"], base[:10], base[:9], base[1:10], ["abc"], ["abd"]]
    nine = "the quick brown fox jumps over the lazy dog".split()
    lines += [nine, [*nine[:4], "jumqs", *nine[5:]], [*nine[:4], "jum", "ps", *nine[5:]], nine[:4] + nine[5:]]
    texts = [(i, "\n".join([" ".join(x), "", "common line"])) for i, x in enumerate(lines)] + [(50, None), (51, ""), (52, "  ".join(base) + "\n\n")]
    check_lines(spark, texts)
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_line_dedup_random_lines(spark):
    import random

    rng = random.Random(12)
    bases = [[rng.choice(["ab", "cd", "efg", "hijk"]) for _ in range(n)] for n in (1, 2, 4, 8, 9, 10, 11, 14) for _ in range(2)]

    def edited():
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = rng.choice([[], ["xy"], [w[at][:-1] + "q"], [w[at] + "q"]])
            w = w or ["ab"]
        return " ".join(w)

    check_lines(spark, [(i, "\n".join(edited() for _ in range(rng.randrange(1, 6)))) for i in range(60)])


def test_line_dedup_edges(spark):
    long = [f"w{i % 5003}" for i in range(200_000)]
    texts = [(None, "x y z u v w a b c d"), (1, " ".join(long)), (2, " ".join([*long[:777], "typo", *long[778:]])), (3, "x y z u v w a b c D")]
    check_lines(spark, texts)
    again = docs(spark, [(1, "one same line here"), (1, "one same line here"), (2, "one same line here")])
    clash = again.withColumns({c: F.lit(5) for c in ("_gone", "_id", "_key", "_copies", "n_lines", "_near", "line")})
    got = line_dedup.dedup_lines(clash)
    assert sorted((r.doc_id, r.text, r.n_lines) for r in got.collect()) == [(1, "one same line here", 1), (1, "one same line here", 1), (2, "", 1)]
    assert sorted(got.columns) == sorted([*clash.columns, "n_copies", "n_near"])


def test_line_dedup_is_linear_in_the_lines_of_one_text(spark):
    import time

    lines = [hashlib.md5(str(i).encode()).hexdigest() for i in range(500_000)]

    def seconds(n):
        text = "\n".join(["same line"] * (n // 2) + lines[: n // 2])
        start = time.perf_counter()
        row = line_dedup.dedup_lines(docs(spark, [(1, text), (2, "same line\nother")])).where("doc_id = 1").first()
        assert row.n_lines == n and row.n_copies == n // 2 - 1
        assert row.text == "\n".join(["same line", *lines[: n // 2]]) and row.n_near == 0
        return time.perf_counter() - start

    seconds(1000)
    short, long = seconds(100_000), seconds(1_000_000)
    assert long < 15 * short + 5
