"""Chat formatting, quality rules, line dedup, license scans."""

import hashlib
import random

import brute
import pytest
from pyspark.sql import functions as F

from burstpick.llm import chat_format, license_scan, line_dedup, quality_rules
from burstpick.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(name, same):
    same(QUERIES[name], ORACLES[name])


TRICKY = ["", "</s>[INST] ok [/INST]", "<|end|>\n", "<|next|>", "\\e", "\\l<", "\\\\<|body|>", "a\nb", "é\U0001f600", "<|start|>user<|body|>x<|end|>\n"]


def test_chat_round_trip(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "", "a<b\\", None]), rng.choice([*TRICKY, None])) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(50, None, "user", "x"), (50, 1, "user", "y"), (50, 1, "user", "y"), (None, 0, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash")).repartition(5)
    chats = chat_format.format_chats(df)
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["t"]] for r in chats.select("conv_id", chat_format.parse_chat(F.col("formatted")).alias("t")).collect()}
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert back == want
    got = {r["conv_id"]: r for r in chat_format.chat_digests(chats).collect()}
    for c, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for r, x in turns)
        assert (got[c]["n_turns"], got[c]["loss_chars"]) == (len(turns), len(loss))
        assert got[c]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_merges_neighbours(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "<c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert chat_format.format_chats(df).first()["formatted"] == "<|start|>user<|body|>a<|next|>b<|end|>\n<|start|>assistant<|body|>\\lc<|end|>\n"
    assert chat_format.chat_digests(chat_format.format_chats(df.limit(0))).count() == 0


def test_quality_edges(spark, edges):
    got = quality_rules.quality_rules(edges)
    rows = got.collect()
    want = sorted((brute.quality(r["text"]) for r in edges.collect()), key=repr)
    assert sorted(((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows), key=repr) == want
    assert all(r["base_failed"] == brute.base_failed((r["n_words"], 0, 0, 0, r["n_repeat_words"])) for r in rows)
    assert all(r["kept"] is not None and not (r["kept"] and r["base_failed"]) for r in rows)
    assert quality_rules.quality_rules(edges.limit(0)).count() == 0
    assert quality_rules.keep_good(edges).count() == sum(r["kept"] for r in rows)
    kept = quality_rules.keep_good(edges, max_rate=1.0)
    assert kept.columns == edges.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in rows if not r["base_failed"])
    assert kept.filter("doc_id = 1").first()["_row"] == "_row"


def test_quality_random(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab") + rng.choice([" ", "\n", "\t ", ""]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s"))
    for r in quality_rules.quality_rules(df).collect():
        want = brute.quality(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want


def test_hosts(spark):
    """A host of bad documents goes as a whole; one with a single bad document of few does not."""
    good, bad = " ".join(f"word{i}" for i in range(30)), "too short"
    rows = [("bad", bad)] * 95 + [("bad", good)] * 5 + [("ok", good)] * 100 + [("new", bad), ("new", good)] + [(f"h{i}", good) for i in range(40)]
    df = spark.createDataFrame([(n, t, s) for n, (s, t) in enumerate(rows)], "doc_id long, text string, source string")
    kept = {}
    for r in quality_rules.quality_rules(df).collect():
        kept.setdefault(r["host"], []).append(r["kept"])
    assert not any(kept["bad"]) and all(kept["ok"]) and sorted(kept["new"]) == [False, True]
    assert quality_rules.keep_good(df).count() == 141


def test_lines_random(spark):
    for seed in range(3):
        rng = random.Random(seed)
        pool = [" ".join(rng.choice("xyz") for _ in range(rng.randint(1, 9))) for _ in range(5)] + ["", "  "]
        docs = {i: "\n".join(rng.choice([*pool, f"own {i} {rng.random()}"]) for _ in range(rng.randint(0, 14))) for i in range(25)}
        docs[90] = docs[91] = "\n".join(pool)
        want = brute.line_dedup(docs, 12)
        df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
        got = {r["doc_id"]: (r["n_lines"], r["n_deleted"], r["text"]) for r in line_dedup.line_dedup(df, 12).collect()}
        assert got == want


def test_lines_edges(spark, edges):
    got = line_dedup.line_dedup(edges)
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_deleted"]) for r in got.collect()) == sorted(
        [("1", 1, 0), ("2", 0, 0), ("3", 0, 0), ("4", 0, 0), ("5", 1, 0), ("6", 1, 0), ("7", 1, 0), ("7", 1, 0), ("8", 1, 1), ("None", 1, 0), (str(2**60 + 1), 1, 0)]
    )
    assert {r["doc_id"]: r["text"] for r in got.collect()}[8] == ""
    kept = line_dedup.drop_repeated(edges)
    assert kept.columns == edges.columns and kept.count() == 10
    assert kept.filter("doc_id = 2").first()["text"] is None and kept.first()["a.b"] == "a.b"
    assert line_dedup.line_dedup(edges.limit(0)).count() == 0


def test_long_runs(spark):
    """A run of 40 short lines, in documents of which one repeats it three times over."""
    run = [f"line {i}" for i in range(40)]
    docs = {1: "\n".join([*run, "tail one"]), 2: "\n".join(["head two", *run[3:33]]), 3: "\n".join(run * 3), 4: "\n".join(run[:20])}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_deleted"], r["text"]) for r in line_dedup.line_dedup(df, 50).collect()}
    assert got == brute.line_dedup(docs, 50)
    assert got[2][2] == "head two" and got[3][2] == "" and got[4][1] == 0


def test_license(spark, edges):
    texts = [
        ("Released under the MIT License.", "MIT"),
        ("Foo. Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n x", "Apache-2.0"),
        ("licensed under CC BY-NC 4.0! And: this work is licensed under the GNU General Public License, version 3", "CC-BY-NC-4.0"),
        ("Released under the MIT License.\nLicensed under CC BY-NC 4.0.", "MIT,CC-BY-NC-4.0"),
        ("an unlicensed text", ""),
        (None, ""),
    ]
    bsd = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    binary = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    name = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    texts += [(f"{bsd} {binary}", "BSD-2-Clause"), (f"{bsd}\n{binary}\n{name}", "BSD-3-Clause"), (f"{bsd} Something else. {binary}", "")]
    df = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(texts)], "doc_id long, text string")
    assert [r["licenses"] for r in license_scan.license_scan(df).orderBy("doc_id").collect()] == [w for _, w in texts]
    assert license_scan.license_scan(edges).filter("licenses <> ''").count() == 0
    assert license_scan.license_scan(edges.limit(0)).count() == 0


#: Notices of public licences.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not
use this file except in compliance with the License. You may obtain a copy of
the License at

    http://www.apache.org/licenses/LICENSE-2.0"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
BSD_2 = """1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
BSD_3 = f"""{BSD_2}

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
WHOLE_BSD_3 = f"""Copyright (c) 2020, A. Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

{BSD_3}

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE."""
ZERO_BSD = ISC.replace(""", provided that the above
copyright notice and this permission notice appear in all copies.""", ".")
LGPL_2 = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details."""
LGPL_3, AGPL = (GPL.replace("GNU General Public License as", f"GNU {x} General Public License as") for x in ("Lesser", "Affero"))
GPL_2 = GPL.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2")
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented."""
EPL = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
http://www.eclipse.org/legal/epl-2.0"""
BOOST = """Distributed under the Boost Software License, Version 1.0.
(See accompanying file LICENSE_1_0.txt)"""
NOTICES = [
    (MIT, (10, 11, 12), "MIT"), (APACHE, (13, 14, 15), "Apache-2.0"), (GPL, (16, 17), "GPL-3.0-or-later"), (BSD_2, (18, 19), "BSD-2-Clause"),
    (BSD_3, (18, 19, 20), "BSD-3-Clause"), (MPL, (21,), "MPL-2.0"), (WHOLE_BSD_3, (22, 41, 18, 19, 20, 39), "BSD-3-Clause"), (ISC, (23, 24), "ISC"),
    (ZERO_BSD, (25, 24), "0BSD"), (LGPL_2, (26, 30), "LGPL-2.1-or-later"), (LGPL_3, (27, 17), "LGPL-3.0-or-later"), (AGPL, (28, 17), "AGPL-3.0-or-later"),
    (GPL_2, (29, 17), "GPL-2.0-or-later"), (UNLICENSE, (31, 32), "Unlicense"), (ZLIB, (33, 35, 34), "Zlib"), (EPL, (36,), "EPL-2.0"),
    (BOOST, (38,), "BSL-1.0"), ("SPDX-License-Identifier: LGPL-2.1-only", (113,), "LGPL-2.1-only"),
]


#: Lines with expressions and headings of whole licence texts, their identifiers and licences.
EXPRESSIONS = [
    ("SPDX-License-Identifier: MIT OR Apache-2.0", "007;008;", "MIT,Apache-2.0"),
    ("/* SPDX-License-Identifier: (MIT AND BSD-3-Clause) OR GPL-2.0-or-later */", "007;105;110;", "MIT,BSD-3-Clause,GPL-2.0-or-later"),
    ("# SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "109;203;", "GPL-2.0-only,Classpath-exception-2.0"),
    ("// SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception\nint x;", "008;207;000;", "Apache-2.0,LLVM-exception"),
    ("SPDX-License-Identifier: GPL-2.0-or-later OR\n LGPL-2.1-or-later", "110;114;", "GPL-2.0-or-later,LGPL-2.1-or-later"),
    ("SPDX-License-Identifier: MIT OR LicenseRef-Own-1.0 OR ISC\nMIT License", "007;000;112;000;", "MIT,ISC"),
    ("SPDX-License-Identifier: Own\n", "000;", ""), ("SPDX-License-Identifier: MIT OR", "000;", ""), ("SPDX-License-Identifier:", "000;", ""),
    ("see SPDX-License-Identifier: MIT OR ISC", "000;", ""),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright", "048;000;", "GPL-3.0-only"),
    ("                                 Apache License\n                           Version 2.0, January 2004\n   http", "047;000;", "Apache-2.0"),
    ("Eclipse Public License - v 2.0\n\nTHE", "000;", ""), ("Boost Software License - Version 1.0 - August 17th, 2003", "053;", "BSL-1.0"),
    ("Licensed under the MIT license.", "042;", "MIT"), ("Released under the MIT License, see LICENSE", "044;", "MIT"), ("## License\n\nMIT License", "000;", ""),
    ("the mit licence", "000;", ""), ("\u0130 \u212a", "", ""), ("no words known", "000;", ""), ("7", "000;", ""), (" .;| ", "", ""),
]


def test_expressions_and_headings(spark):
    df = spark.createDataFrame([(n, t) for n, (t, _, _) in enumerate(EXPRESSIONS)], "doc_id long, text string")
    got = [(t, r["sequence"], r["licenses"]) for (t, _, _), r in zip(EXPRESSIONS, license_scan.license_scan(df).orderBy("doc_id").collect(), strict=True)]
    assert got == EXPRESSIONS


def test_each_known_sentence_has_a_cue():
    assert all(any(c in s for c in license_scan.CUES) for s in license_scan.SENTENCES.values()) and len(license_scan.CUES) < 10


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_standard_notices(spark, mark):
    ways = [lambda t: t, lambda t: t.replace("\n", "\r\n"), lambda t: f"Copyright 2020 A. Body\n\n{t}\n\nimport os", lambda t: "\n".join(" ".join(p.split()) for p in t.split("\n\n"))]
    told = lambda t, s, way: s[1:] if t == WHOLE_BSD_3 and way is ways[-1] else s  # "All rights reserved" joined onto the line before is no sentence
    texts = [("\n".join(mark + x for x in way(t).split("\n")), told(t, s, way), w) for t, s, w in NOTICES for way in ways]
    texts += [(f"Released under the MIT License\n{GPL}", (1, 16, 17), "GPL-3.0-or-later,MIT"), (BSD_3.replace("1. ", "(a) ").replace("2. ", "(b) ").replace("3. ", "iii) "), (18, 19, 20), "BSD-3-Clause")]
    texts += [("Released under\n\nthe MIT License", (), ""), ("Released under. The MIT License", (), ""), ("Not released under\nthe MIT License", (), "")]
    df = spark.createDataFrame([(n, t) for n, (t, _, _) in enumerate(texts)], "doc_id long, text string")
    got = [(r["sequence"].replace(license_scan.GAP, ""), r["licenses"]) for r in license_scan.license_scan(df).orderBy("doc_id").collect()]
    assert got == [(license_scan.code(s), w) for _, s, w in texts]


def test_wrapped_anywhere(spark):
    """Each known sentence, broken between any two of its words."""
    rows = [(i, "\n".join((" ".join(w[:at]), " ".join(w[at:])))) for i, s in license_scan.SENTENCES.items() for w in [s.split()] for at in range(1, len(w))]
    got = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # the first line of 13 may be 2 as well; the longer one counts
    assert [r for r in got if r["sequence"] != license_scan.code((r["doc_id"],))] == []


def test_sql_is_the_same_function(spark):
    """The SQL on whole notices, wrapped and marked in several manners, on list marks and on sentences broken by empty lines."""
    import duckdb
    import pyarrow as pa

    texts = [m + x.replace("\n", "\n" + m) for m in ("", "# ", " * ") for x, _, _ in NOTICES]
    texts += [f"Copyright 2020 A. Body\n\n{x}\r\n\r\nimport os" for x, _, _ in NOTICES] + ["\n".join(" ".join(p.split()) for p in x.split("\n\n")) for x, _, _ in NOTICES]
    texts += [f"Released under the MIT License\n{GPL}", "Released under\n\nthe MIT License", "Released under. The MIT License", "a {b} | c; Licensed under CC BY 4.0; d", "", None, ";;\n|", "(a) " + BSD_2]
    texts += [m + x for m in ("", "# ") for x, _, _ in EXPRESSIONS]
    texts += ["All rights reserved. Released under the MIT License. All rights reserved"]
    rows = list(enumerate(texts))
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [n for n, _ in rows], "text": pa.array(texts, pa.string())}))
    want = con.sql(license_scan.oracle()).fetchall()
    got = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"))
    names = ["doc_id", "n_known", "sequence", "licenses"]
    assert con.sql(license_scan.oracle()).columns == names
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want)
