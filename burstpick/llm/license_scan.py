"""License scans: known sentences, then rules over their order. DataFrame functions only.

A text is normalised: A-Z lower-cased, every run of other characters than a-z and 0-9 one space (so comment marks go). A
sentence ends at ``.``, ``!`` or ``?`` before white space and at an empty line; it may end at a line end or ``;``, but a
known sentence may also be wrapped there. So a known sentence is found where its words stand between two such places,
on a line of its own, on part of one or over several; of two that begin at one place the longer counts, and a list
number or letter before it belongs to it. Known sentences get their identifiers, any run of others is one gap. The rules
are tried in order, longest notices first; a rule whose identifiers stand in the sequence one after another names its
licence and takes them out, so a shorter rule cannot claim them again.

A line ``SPDX-License-Identifier:`` is an expression: each name between ``OR``, ``AND``, ``WITH`` and brackets gives its own identifier
(a gap, if it is not known), so all licences and exceptions of the line are listed. A dated heading of
a licence's own text is a sentence like others; headings such as ``MIT License`` also stand in prose and are none. A text without any of CUES, words of which each known sentence holds one, is a gap as a whole and is not parsed.

Defined cases: a null or empty text has no sentence and no licence. Repeated rows count each. An empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstpick.llm.common import WHITE

#: Normalised sentences of public licence notices, by identifier.
SENTENCES = {
    1: "released under the mit license",
    2: "licensed under the apache license version 2 0",
    3: "this work is licensed under the gnu general public license version 3",
    4: "licensed under cc by nc 4 0",
    5: "licensed under cc by 4 0",
    6: "licensed under cc by sa 4 0",
    7: "spdx license identifier mit",
    8: "spdx license identifier apache 2 0",
    9: "spdx license identifier gpl 3 0 only",
    10: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    11: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    12: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    13: "licensed under the apache license version 2 0 the license",
    14: "you may not use this file except in compliance with the license",
    15: "you may obtain a copy of the license at",
    16: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    17: "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    18: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    19: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    20: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    21: "this source code form is subject to the terms of the mozilla public license v 2 0",
    22: "all rights reserved",
    23: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    24: "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    25: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    26: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    27: "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    28: "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    29: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    30: "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    31: "this is free and unencumbered software released into the public domain",
    32: "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    33: "this software is provided as is without any express or implied warranty",
    34: "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    35: "in no event will the authors be held liable for any damages arising from the use of this software",
    36: "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at http www eclipse org legal epl 2 0",
    37: "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    38: "distributed under the boost software license version 1 0",
    39: "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    40: "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    41: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    42: "licensed under the mit license",
    43: "licensed under the mit license see license",
    44: "released under the mit license see license",
    45: "this project is licensed under the mit license",
    46: "this project is licensed under the mit license see the license file for details",
    47: "apache license version 2 0 january 2004",
    48: "gnu general public license version 3 29 june 2007",
    49: "gnu general public license version 2 june 1991",
    50: "gnu lesser general public license version 3 29 june 2007",
    51: "gnu lesser general public license version 2 1 february 1999",
    52: "gnu affero general public license version 3 19 november 2007",
    53: "boost software license version 1 0 august 17th 2003",
    54: "licensed under the apache license 2 0",
    55: "this project is licensed under the apache license 2 0",
}
#: Further licences that are known by their one-line tag; their identifiers are FIRST_TAG and on.
TAGS = [
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later",
    "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MPL-2.0", "Unlicense", "Zlib",
]
FIRST_TAG = 101
#: Exceptions that may follow ``WITH``; their identifiers are FIRST_EXCEPTION and on.
EXCEPTIONS = ["Autoconf-exception-3.0", "Bison-exception-2.2", "Classpath-exception-2.0", "Font-exception-2.0", "GCC-exception-3.1", "Linux-syscall-note", "LLVM-exception"]
FIRST_EXCEPTION = 201
SPDX = "spdx license identifier "
SENTENCES |= {i: SPDX + tag.lower().replace("-", " ").replace(".", " ") for first, tags in ((FIRST_TAG, TAGS), (FIRST_EXCEPTION, EXCEPTIONS)) for i, tag in enumerate(tags, first)}
#: Ordered rules: licence, identifiers one after another.
RULES = [
    ("BSD-3-Clause", (22, 41, 18, 19, 20)),
    ("BSD-2-Clause", (22, 41, 18, 19)),
    ("MIT", (10, 11, 12)),
    ("Apache-2.0", (13, 14, 15)),
    ("Zlib", (33, 35, 34)),
    ("GPL-3.0-or-later", (16, 17)),
    ("GPL-2.0-or-later", (29, 17)),
    ("AGPL-3.0-or-later", (28, 17)),
    ("LGPL-3.0-or-later", (27, 17)),
    ("LGPL-2.1-or-later", (26, 30)),
    ("ISC", (23, 24)),
    ("0BSD", (25, 24)),
    ("Unlicense", (31, 32)),
    ("BSD-3-Clause", (18, 19, 20)),
    ("BSD-2-Clause", (18, 19)),
    ("MIT", (10, 11)),
    ("Apache-2.0", (13, 14)),
    ("GPL-3.0-or-later", (16,)),
    ("GPL-2.0-or-later", (29,)),
    ("AGPL-3.0-or-later", (28,)),
    ("LGPL-3.0-or-later", (27,)),
    ("LGPL-2.1-or-later", (26,)),
    ("ISC", (23,)),
    ("0BSD", (25,)),
    ("Unlicense", (31,)),
    ("Zlib", (34,)),
    ("EPL-2.0", (36,)),
    ("EPL-2.0", (37,)),
    ("BSL-1.0", (38,)),
    ("CC0-1.0", (40,)),
    ("MIT", (10,)),
    ("Apache-2.0", (13,)),
    ("MPL-2.0", (21,)),
    ("MIT", (7,)),
    ("Apache-2.0", (8,)),
    ("GPL-3.0-only", (9,)),
    *[(tag, (i,)) for i, tag in enumerate(TAGS, FIRST_TAG)],
    *[(tag, (i,)) for i, tag in enumerate(EXCEPTIONS, FIRST_EXCEPTION)],
    ("Apache-2.0", (47,)),
    ("GPL-3.0-only", (48,)),
    ("GPL-2.0-only", (49,)),
    ("LGPL-3.0-only", (50,)),
    ("LGPL-2.1-only", (51,)),
    ("AGPL-3.0-only", (52,)),
    ("BSL-1.0", (53,)),
    *[("MIT", (i,)) for i in range(42, 47)],
    *[("Apache-2.0", (i,)) for i in (54, 55)],
    ("MIT", (1,)),
    ("Apache-2.0", (2,)),
    ("GPL-3.0-only", (3,)),
    ("CC-BY-NC-4.0", (4,)),
    ("CC-BY-4.0", (5,)),
    ("CC-BY-SA-4.0", (6,)),
    ("Proprietary", (22,)),
]
GAP = "000;"
#: Before a sentence in a list: ``1.``, ``(b)``, ``iv)``.
LIST_MARK = "(?:[0-9]{1,2}|[ivx]{1,4}|[a-z])"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def code(ids: tuple[int, ...]) -> str:
    return "".join(f"{i:03d};" for i in ids)


def normalised(text: Column) -> Column:
    """The words of the text between one space, ``|`` (a sentence ends) or a line feed (it may end)."""
    t = F.translate(text, UPPER + "|{", LOWER + "  ")
    t = F.regexp_replace(F.concat(F.lit("\n"), t, F.lit("\n")), f"[.!?]+[{WHITE}]+|\n[^a-z0-9\n]*\n", "|")
    t = F.regexp_replace(t, "[^a-z0-9|;\n]+", " ")
    return F.regexp_replace(F.regexp_replace(t, "[ ;\n]*[|][ |;\n]*", "|"), " ?[;\n][ ;\n]*", "\n")


def cues() -> list[str]:
    """Few words of six letters or more such that each known sentence holds one of them."""
    left, found = set(SENTENCES.values()), []
    words = sorted({w for s in left for w in s.split(" ") if len(w) >= 6})
    while left:
        found.append(max(words, key=lambda w: sum(w in s for s in left)))
        left = {s for s in left if found[-1] not in s}
    return found


CUES = cues()
#: Between the names of an expression; ``or later`` is part of a name and stands as one word while names are parted.
OPERATOR = "(?:or|and|with)"
LATER = " or later", " orlater"
#: Sentence -> its identifier, ``or later`` as one word in the names of expressions.
CODES = {s.replace(*LATER) if s.startswith(SPDX) else s: code((i,)) for i, s in SENTENCES.items()}


def known_pattern(between: str, sentence_end: str) -> str:
    """Pattern of all known sentences, with the patterns that stand between words and, also, behind ``v.``, which ends no sentence.
    An expression may be wrapped between known names; one with others ends with its line."""
    wrapped = lambda s: between.join(s.split(" ")).replace(f"{between}v{between}", f"{between}v(?:{between}|{sentence_end})")
    by_length = sorted(SENTENCES.values(), key=len, reverse=True)
    name = f"(?:{'|'.join(wrapped(s.removeprefix(SPDX)) for s in by_length if s.startswith(SPDX))})"
    head = between.join(SPDX.split())
    spdx = f"{head}{between}{name}(?:{between}{OPERATOR}{between}{name})*|{SPDX.rstrip()}(?: [a-z0-9]+)+"
    return "|".join([wrapped(s) for s in by_length if not s.startswith(SPDX)] + [spdx])


def sequence(text: Column) -> Column:
    """Identifiers of the text's sentences, each as ``NNN;``; a run of unknown sentences as one GAP."""
    known = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    marked = F.regexp_replace(normalised(text), f"([|\n])(?:{LIST_MARK}[ |])?({known_pattern('[ \n]', '[|]')})(?=[|\n])", "$1{$2{")
    of_one = lambda s: F.coalesce(F.try_element_at(known, s), F.lit(GAP))
    names = lambda s: F.split(F.replace(F.substring(s, len(SPDX) + 1, 2**31 - 1), F.lit(LATER[0]), F.lit(LATER[1])), f" {OPERATOR} ")
    of_known = lambda s: F.when(s.startswith(SPDX), F.array_join(F.transform(names(s), lambda x: of_one(F.concat(F.lit(SPDX), x))), "")).otherwise(of_one(s))
    of_part = lambda s: F.when(s.rlike("[a-z0-9]"), of_known(F.translate(s, "|\n", "  "))).otherwise("")
    codes = F.regexp_replace(F.array_join(F.transform(F.split(marked, "[{]"), of_part), ""), f"({GAP})+", GAP)
    lower = F.translate(text, UPPER, LOWER)
    cue = reduce(lambda a, b: a | b, [F.contains(lower, F.lit(c)) for c in CUES])
    return F.when(cue, codes).when(text.rlike("[A-Za-z0-9]"), GAP).otherwise("")


def match_rules(seq: Column) -> Column:
    """Licences of the sequence, each with a comma after it, in the order of RULES."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(code(ids)).alias("code")) for name, ids in RULES])
    step = lambda a, r: F.struct(
        F.replace(a["seq"], r["code"], F.lit(GAP)).alias("seq"),
        F.concat(a["found"], F.when(F.contains(a["seq"], r["code"]), F.concat(r["name"], F.lit(","))).otherwise("")).alias("found"),
    )
    return F.aggregate(rules, F.struct(seq.alias("seq"), F.lit("").alias("found")), step, lambda a: a["found"])


def license_scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_known, sequence, licenses`` for each row of ``docs (doc_id, text)``; ``licenses`` is a list joined by
    commas, each licence once."""
    seq = sequence(F.coalesce(F.col("text"), F.lit("")))
    found = docs.select("doc_id", seq.alias("sequence"))
    rules = F.when(F.col("sequence").isin("", GAP), "").otherwise(match_rules(F.col("sequence")))
    names = F.filter(F.split(rules, ","), lambda x: x != "")
    n_known = F.length(F.replace("sequence", F.lit(GAP), F.lit(""))) / len(GAP)
    return found.select("doc_id", n_known.cast("long").alias("n_known"), "sequence", F.array_join(F.array_distinct(names), ",").alias("licenses"))


def oracle() -> str:
    """The same in DuckDB's SQL over ``documents``. Its patterns cannot look ahead, so each place where a sentence ends or may end
    stands twice, and a known sentence takes one before and one after it."""
    known = ", ".join(f"('{s}', '{c}')" for s, c in CODES.items())
    steps = "".join(
        f", s{n} AS (SELECT row, doc_id, sequence, replace(seq, '{code(ids)}', '{GAP}') AS seq,"
        f" found || CASE WHEN contains(seq, '{code(ids)}') THEN '{name},' ELSE '' END AS found FROM s{n - 1})"
        for n, (name, ids) in enumerate(RULES, 1)
    )
    any_known = known_pattern(r"(?: |\n\n)", r"\|\|")
    return rf"""
WITH known(sentence, code) AS (VALUES {known}), lower AS (
  SELECT row_number() OVER () AS row, doc_id, chr(10) || translate(coalesce(text, ''), '{UPPER}|{{', '{LOWER}  ') || chr(10) AS t FROM documents
), ends AS (
  SELECT row, doc_id, regexp_replace(regexp_replace(t, '[.!?]+[ \t\n\x0b\f\r]+|\n[^a-z0-9\n]*\n', '|', 'g'), '[^a-z0-9|;\n]+', ' ', 'g') AS t FROM lower
), normal AS (
  SELECT row, doc_id, regexp_replace(regexp_replace(t, '[ ;\n]*[|][ |;\n]*', '|', 'g'), ' ?[;\n][ ;\n]*', chr(10), 'g') AS t FROM ends
), marked AS (
  SELECT row, doc_id, regexp_replace(regexp_replace(t, '([|\n])', '\1\1', 'g'), '([|\n])(?:{LIST_MARK}(?: |\|\|))?({any_known})([|\n])', '\1{{\2{{\3', 'g') AS t FROM normal
), parts AS (
  SELECT row, i, translate(replace(replace(string_split(t, '{{')[i], '||', '|'), chr(10) || chr(10), chr(10)), '|' || chr(10), '  ') AS sentence
  FROM marked, unnest(range(1, len(string_split(t, '{{')) + 1)) AS u(i)
), named AS (
  SELECT row, i, 0 AS j, sentence FROM parts WHERE NOT starts_with(sentence, '{SPDX}') UNION ALL
  SELECT row, i, j, '{SPDX}' || string_split_regex(replace(sentence[{len(SPDX) + 1}:], '{LATER[0]}', '{LATER[1]}'), ' {OPERATOR} ')[j]
  FROM parts, unnest(range(1, len(string_split_regex(replace(sentence[{len(SPDX) + 1}:], '{LATER[0]}', '{LATER[1]}'), ' {OPERATOR} ')) + 1)) AS u(j)
  WHERE starts_with(sentence, '{SPDX}')
), coded AS (
  SELECT row, i, j, coalesce(code, '{GAP}') AS code FROM named LEFT JOIN known USING (sentence) WHERE regexp_matches(sentence, '[a-z0-9]')
), joined AS (
  SELECT row, any_value(doc_id) AS doc_id, regexp_replace(coalesce(string_agg(code, '' ORDER BY i, j), ''), '({GAP})+', '{GAP}', 'g') AS sequence
  FROM lower LEFT JOIN coded USING (row) GROUP BY row
), s0 AS (SELECT row, doc_id, sequence, sequence AS seq, '' AS found FROM joined){steps}, hit AS (
  SELECT doc_id, sequence, list_filter(string_split(found, ','), lambda x: x <> '') AS l FROM s{len(RULES)}
)
SELECT doc_id, (length(replace(sequence, '{GAP}', '')) // {len(GAP)})::BIGINT AS n_known, sequence,
  array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS licenses
FROM hit
"""
