"""Licence scans by sentence rules.

A text is cut into sentences, twice: at line ends, and across them (notices are
often wrapped). Sentences are normalised to lower-case letters and digits and looked
up among known licence sentences; a text thus becomes a sequence of identifiers, 0
for any other sentence. Numbers of lists are no sentences, the stop of ``v.`` ends none, and an address
belongs to the sentence that leads to it. Licence rules are sequences of identifiers in an order of
precedence: a rule takes its sentences out of the sequence, so a later, shorter rule
sees only what is left. Sentences that name a licence by themselves are rules of one
sentence, counted last and together. Everything is row-local.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


# Sentences of public licences and notices, normalised, by a name of their own.
SENTENCES = {
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache at": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache at https": "you may obtain a copy of the license at https www apache org licenses license 2 0",
    "apache unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache see": "see the license for the specific language governing permissions and limitations under the license",
    "mit grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "0bsd": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "unlicense anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl at": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl at http": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "zlib": "this software is provided as is without any express or implied warranty",
    "zlib event": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "hope library": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
}
#: Rules of several sentences in order of precedence.
SEQUENCES = [
    ("Apache-2.0", ("apache", "apache at", "apache unless", "apache see")),
    ("Apache-2.0", ("apache", "apache at https", "apache unless", "apache see")),
    ("Apache-2.0", ("apache", "apache at")),
    ("Apache-2.0", ("apache", "apache at https")),
    ("MIT", ("mit grant", "mit notice", "mit warranty")),
    ("MIT", ("mit grant", "mit notice")),
    ("BSD-3-Clause", ("bsd", "bsd source", "bsd binary", "bsd names")),
    ("BSD-2-Clause", ("bsd", "bsd source", "bsd binary")),
    ("ISC", ("isc", "isc warranty")),
    ("0BSD", ("0bsd", "isc warranty")),
    ("Unlicense", ("unlicense", "unlicense anyone")),
    ("MPL-2.0", ("mpl", "mpl at")),
    ("MPL-2.0", ("mpl", "mpl at http")),
    ("Zlib", ("zlib", "zlib event", "zlib grant")),
]
#: Sentences that name a licence by themselves.
ALONE = {"apache": "Apache-2.0", "mit grant": "MIT", "isc": "ISC", "0bsd": "0BSD", "unlicense": "Unlicense", "mpl": "MPL-2.0", "zlib grant": "Zlib"}

# The GNU notices by their rule: of what kind, which family, which version.
for _family, _short, _versions in (("", "GPL", ("2", "3")), ("lesser ", "LGPL", ("2 1", "3")), ("affero ", "AGPL", ("3",))):
    for _version in _versions:
        _name = f"{_short}-{_version.replace(' ', '.')}{'' if ' ' in _version else '.0'}"
        for _kind, _hope in (("program", "hope"), ("library", "hope library")):
            _key = f"{_name} {_kind}"
            SENTENCES[_key] = (
                f"this {_kind} is free software you can redistribute it and or modify it under the terms of the gnu {_family}general public license "
                f"as published by the free software foundation either version {_version} of the license or at your option any later version"
            )
            SEQUENCES.append((f"{_name}-or-later", (_key, _hope)))
            ALONE[_key] = f"{_name}-or-later"
        SENTENCES[f"{_name} only"] = f"this work is licensed under the gnu {_family}general public license version {_version}"
        ALONE[f"{_name} only"] = _name
# The Creative Commons notices by theirs.
for _long, _short in (("", "BY"), (" sharealike", "BY-SA"), (" noncommercial", "BY-NC"), (" noderivatives", "BY-ND"), (" noncommercial sharealike", "BY-NC-SA")):
    SENTENCES[f"CC-{_short}"] = f"this work is licensed under a creative commons attribution{_long} 4 0 international license"
    SENTENCES[f"CC-{_short} short"] = f"licensed under cc {normalised(_short)} 4 0"
    ALONE[f"CC-{_short}"] = ALONE[f"CC-{_short} short"] = f"CC-{_short}-4.0"
# One-line notices and identifiers in files, of each licence.
for _name, _said in (
    ("MIT", ("the mit license",)),
    ("Apache-2.0", ("the apache license version 2 0", "the apache license 2 0", "the apache 2 0 license")),
    ("BSD-3-Clause", ("the bsd 3 clause license", "the 3 clause bsd license")),
    ("BSD-2-Clause", ("the bsd 2 clause license", "the 2 clause bsd license")),
    ("ISC", ("the isc license",)),
    ("MPL-2.0", ("the mozilla public license 2 0", "the mozilla public license version 2 0")),
    ("Zlib", ("the zlib license",)),
):
    for _verb in ("licensed under", "released under", "distributed under", "this project is licensed under", "this software is licensed under", "this code is released under"):
        for _how in _said:
            SENTENCES[f"{_verb} {_how}"] = f"{_verb} {_how}"
            ALONE[f"{_verb} {_how}"] = _name
for _name in dict.fromkeys([*(n for n, _ in SEQUENCES), *ALONE.values()]):
    SENTENCES[f"spdx {_name}"] = f"spdx license identifier {normalised(_name)}"
    ALONE[f"spdx {_name}"] = _name

#: Identifiers: sentences that name a licence first, in the order of their licences' precedence.
_ORDER = [*ALONE, *(k for k in SENTENCES if k not in ALONE)]
IDENTIFIER = {key: i for i, key in enumerate(_ORDER, 1)}
#: Where sentences end: at stops before white space, and at line ends or at blank lines.
_STOPS = r"[.!?]+[ \t\r\f\n]+"
LINES, PARAGRAPHS = rf"{_STOPS}|\n", rf"{_STOPS}|\n[ \t\r\f]*\n"
#: What is joined or left out before a text is cut: marks of comments, a version's ``v.``, numbers and letters of lists, white space before an address.
TIDY = (
    (r"(^|\n)[ \t]*(?:/\*+|//+|\*+/?|#+|;+|--+)", (1,)),
    (r"(\b[vV])\.[ \t]+([0-9])", (1, 2)),
    (r"(^|\n)[ \t]*(?:[0-9]{1,2}|[A-Za-z]|[ivx]{2,4})[.)][ \t]+", (1,)),
    (r"(\b[aA][tT])\s+((?:https?|HTTPS?)://)", (1, 2)),
)
#: Every known sentence holds one of these.
_WORTH = "licen|permi|redistribut|software|merchantability|public domain|mozilla"


def _found(cut: Column, sequence: str) -> tuple[Column, Column]:
    """What is left without the sequence, and how often it was there."""
    left = F.replace(cut, F.lit(sequence), F.lit("|"))
    return left, ((F.length(cut) - F.length(left)) / (len(sequence) - 1)).cast("long")


def _sequence(keys: tuple[str, ...]) -> str:
    return "".join(f"<{IDENTIFIER[k]}>" for k in keys)


def identifiers(text: Column, ends: str) -> Column:
    """The text as a string of sentence identifiers, each in angle brackets."""
    known = F.create_map(*[F.lit(x) for key in _ORDER for x in (SENTENCES[key], f"<{IDENTIFIER[key]}>")])

    def one(sentence: Column) -> Column:
        words = F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))
        # A sentence without a letter is none.
        return F.transform(F.array(words), lambda w: F.when(w.rlike("[a-z]"), F.coalesce(F.element_at(known, w), F.lit("<0>"))).otherwise(""))[0]

    for pattern, groups in TIDY:
        text = F.regexp_replace(text, pattern, " ".join(f"${g}" for g in groups))
    return F.array_join(F.transform(F.split(text, ends), one), "")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_sentences (known ones), n_matches and licences.

    ``licences`` joins the names of the matched rules in order of precedence, each
    once; it is empty for null, empty or unlicensed texts. A rule found in lines is
    not counted again across them. Repeated rows are rows of their own. A table without rows gives none.
    """
    text = F.coalesce("text", F.lit(""))
    # Only a text that holds a word all rules need is worth cutting.
    text = F.when(F.lower(text).rlike(_WORTH), text).otherwise("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select(
        "doc_id", identifiers(F.col("text"), LINES).alias("lines"), identifiers(F.col("text"), PARAGRAPHS).alias("paragraphs")
    )
    known = F.greatest(*[F.length(F.regexp_replace(c, "<0>|[0-9>]", "")) for c in ("lines", "paragraphs")])
    rows = rows.withColumn("n_sentences", known.cast("long"))
    for cut in ("lines", "paragraphs"):
        ids = F.regexp_extract_all(cut, F.lit("<([0-9]+)>"), F.lit(1)).cast("array<int>")
        rows = rows.withColumn(f"in_{cut}", F.filter(ids, lambda i: (i > 0) & (i <= len(ALONE))))
    for i, (_, keys) in enumerate(SEQUENCES):
        (lines, in_lines), (paragraphs, in_paragraphs) = (_found(F.col(c), _sequence(keys)) for c in ("lines", "paragraphs"))
        rows = rows.withColumns({"lines": lines, "paragraphs": paragraphs, f"n{i}": F.greatest(in_lines, in_paragraphs)})
    # What a sequence has taken is not counted by itself, in whichever cut it stands alone.
    taken = F.array(*[sum((F.col(f"n{i}") for i in _holding(key)), F.lit(0).cast("long")) for key in ALONE])

    def times(i: Column) -> Column:
        return F.greatest(*[F.size(F.filter(c, lambda x: x == i)) for c in ("in_lines", "in_paragraphs")]) - F.element_at("taken", i)

    rows = rows.withColumns({"taken": taken, "alone": F.array_sort(F.array_distinct(F.concat("in_lines", "in_paragraphs")))})
    rows = rows.withColumn("alone", F.filter(F.transform("alone", lambda i: F.struct(i.alias("i"), times(i).alias("n"))), lambda x: x["n"] > 0))
    total = F.aggregate("alone", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    for i in range(len(SEQUENCES)):
        total = total + F.col(f"n{i}")
    in_sequence = F.array_compact(F.array(*[F.when(F.col(f"n{i}") > 0, F.lit(name)) for i, (name, _) in enumerate(SEQUENCES)]))
    by_itself = F.transform("alone", lambda x: F.element_at(F.array(*[F.lit(n) for n in ALONE.values()]), x["i"]))
    names = F.array_join(F.array_distinct(F.concat(in_sequence, by_itself)), ", ")
    return rows.select("doc_id", "n_sentences", total.alias("n_matches"), names.alias("licences"))


def _holding(key: str) -> list[int]:
    """The sequences that hold a sentence."""
    return [i for i, (_, keys) in enumerate(SEQUENCES) if key in keys]


def scan_sql() -> str:
    """The same scan for DuckDB."""

    def cut(ends: str) -> str:
        tidy = "t"
        for pattern, groups in TIDY:
            tidy = f"regexp_replace({tidy}, '{pattern}', '{' '.join(f'{chr(92)}{g}' for g in groups)}', 'g')"
        words = "trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))"
        return (
            f"array_to_string(list_transform(string_split_regex({tidy}, '{ends}'), "
            f"lambda s: CASE WHEN regexp_matches({words}, '[a-z]') THEN coalesce(known[{words}], '<0>') ELSE '' END), '')"
        )

    entries = ", ".join(f"'{SENTENCES[k]}': '<{IDENTIFIER[k]}>'" for k in _ORDER)
    steps = [
        f"WITH k AS (SELECT MAP {{{entries}}} AS known), "
        f"texts AS (SELECT doc_id, CASE WHEN regexp_matches(lower(text), '{_WORTH}') THEN text ELSE '' END AS t FROM documents), "
        f"s0 AS (SELECT doc_id, {cut(LINES)} AS a, {cut(PARAGRAPHS)} AS b FROM texts, k)"
    ]
    known = "greatest(" + ", ".join(f"length(regexp_replace({c}, '<0>|[0-9>]', '', 'g'))" for c in "ab") + ")"
    ids = ", ".join(
        f"list_filter(CAST(regexp_extract_all({c}, '<([0-9]+)>', 1) AS INTEGER[]), lambda i: i > 0 AND i <= {len(ALONE)}) AS in_{c}" for c in "ab"
    )
    for i, (_, keys) in enumerate(SEQUENCES):
        sequence = _sequence(keys)
        kept = ", n_sentences, in_a, in_b" + "".join(f", n{j}" for j in range(i))
        found = [f"(length({c}) - length(replace({c}, '{sequence}', '|'))) // {len(sequence) - 1}" for c in "ab"]
        first = f", {known} AS n_sentences, {ids}" if i == 0 else kept
        steps.append(
            f"s{i + 1} AS (SELECT doc_id, replace(a, '{sequence}', '|') AS a, replace(b, '{sequence}', '|') AS b{first}, "
            f"greatest({found[0]}, {found[1]}) AS n{i} FROM s{i})"
        )
    taken = ", ".join(" + ".join(f"n{i}" for i in _holding(key)) or "0" for key in ALONE)
    steps.append(f"alone AS (SELECT *, [{taken}] AS taken, list_sort(list_distinct(list_concat(in_a, in_b))) AS u FROM s{len(SEQUENCES)})")
    times = "greatest(len(list_filter(in_a, lambda x: x = i)), len(list_filter(in_b, lambda x: x = i))) - taken[i]"
    steps.append(f"counted AS (SELECT * REPLACE (list_filter(u, lambda i: {times} > 0) AS u), list_transform(u, lambda i: greatest({times}, 0)) AS m FROM alone)")
    by_id = ", ".join(f"'{name}'" for name in ALONE.values())
    names = ", ".join(f"CASE WHEN n{i} > 0 THEN '{name}' END" for i, (name, _) in enumerate(SEQUENCES))
    all_names = f"list_concat(list_filter([{names}], lambda x: x IS NOT NULL), list_transform(u, lambda i: [{by_id}][i]))"
    counts = " + ".join(f"n{i}" for i in range(len(SEQUENCES)))
    steps.append(f"named AS (SELECT doc_id, n_sentences, {counts} + coalesce(list_sum(m), 0) AS n_matches, {all_names} AS names FROM counted)")
    # Each name once, where it comes first.
    return (
        ", ".join(steps)
        + " SELECT doc_id, CAST(n_sentences AS BIGINT) AS n_sentences, CAST(n_matches AS BIGINT) AS n_matches, "
        + "array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i), ', ') AS licences FROM named"
    )
