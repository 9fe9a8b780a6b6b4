"""Operator 10, licence scans by sentence rules.

Texts and the known notices are cut into normalised sentences by the same rules. Known sentences have identifiers, and the
identifiers that a text holds, in order, are matched against ordered rules: each a licence and the sequence of a notice.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.llm.common import table

#: What ends a sentence or belongs in it, as (pattern, Java's replacement), in order, over a text in lower case without '|':
#: a version's plus is 'or later', 'v. 2' is one word, stops and a colon before a line's end end a sentence, and so do lines
#: that are empty or hold only signs of comments.
STEPS = (
    (r"([0-9])\+", "$1 or later"), (r"(^|[^a-z0-9])v\. *([0-9])", "$1v $2"), (r"[.!?]+([ \t\r\n]|\z)", "|$1"), (r":[ \t]*(\r?\n|\z)", "|$1"), (r"\n[ \t\r*/%#;-]*\n", "|\n"),
)
#: A sentence may end with its line or run on over it: both are looked at.
LINES, WRAPPED = "[\r\n]+", "[^a-z0-9|]+"
#: Parts of words of which known sentences hold one, so that a text without any needs no cutting; see anchors().
ANCHORS = ("licen", "permi", "redistribut", "copyright", "reserved", "warrant", "liable", "public")

#: Names of licences in one-sentence notices.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0", "Apache-2.0 License"),
    "MIT": ("MIT License", "MIT license (MIT)", "terms of the MIT license"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3"),
    "GPL-3.0-or-later": ("GNU General Public License, version 3 or later", "GNU General Public License v3.0 or later", "GPLv3+"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2"),
    "GPL-2.0-or-later": ("GNU General Public License, version 2 or later", "GNU General Public License v2.0 or later", "GPLv2+"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC BY 4.0 license"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0 license"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0 license"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "BSD-3-Clause", "New BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "BSD-2-Clause", "Simplified BSD License"),
    "ISC": ("ISC License",),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License - v 2.0"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "Zlib": ("zlib License",),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "WTFPL": ("Do What The Fuck You Want To Public License", "WTFPL"),
}
SUBJECTS = ("", *(f"this {what} is " for what in ("project", "work", "program", "software", "code", "library", "package", "file")))
VERBS = ("licensed under", "released under", "distributed under")
#: Licences whose name on a line of its own, with or without 'The', is a notice.
TITLED = ("MIT", "ISC", "BSD-3-Clause", "BSD-2-Clause", "Unlicense", "Zlib")

#: Identifiers of SPDX and what they are called here.
SPDX = {name: name for name in NAMES} | {
    "GPL-3.0-only": "GPL-3.0", "GPL-2.0-only": "GPL-2.0", "LGPL-3.0-only": "LGPL-3.0", "LGPL-2.1-only": "LGPL-2.1", "AGPL-3.0-only": "AGPL-3.0", "LGPL-3.0-or-later": "LGPL-3.0-or-later",
    "LGPL-2.1-or-later": "LGPL-2.1-or-later", "AGPL-3.0-or-later": "AGPL-3.0-or-later", "0BSD": "0BSD", "MIT-0": "MIT-0", "Artistic-2.0": "Artistic-2.0", "EUPL-1.2": "EUPL-1.2", "EPL-1.0": "EPL-1.0", "LPPL-1.3c": "LPPL-1.3c",
}

_GNU = "This {what} is free software{sign} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{version}."
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
)
_BSD_INLINE = (_BSD[0][:-1] + ": 1.", *_BSD[1:])
_NAMES_OF = "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software.",
)


def _gnu(name: str, number: str, later: bool) -> list[str]:
    versions = [f", either version {number} of the License, or (at your option) any later version", f"; either version {number} of the License, or (at your option) any later version", f", either version {number} of the License, or any later version"] if later else [f", version {number} of the License", f"; version {number} of the License", f", version {number}", f"; version {number}"]
    return [_GNU.format(what=what, sign=sign, name=name, version=v) for what in ("program", "library", "file", "software") for sign in (":", ";") for v in versions]


#: Notices of several sentences, or of one that isn't of the form above, as (licence, text). A text is a rule: its sentences
#: must follow each other, but for unknown ones in between.
NOTICES = [
    *[("Apache-2.0", f"Licensed under the Apache License, Version 2.0 (the \"License\"){sign} you may not use {what} except in compliance with the License.") for sign in (";", ",") for what in ("this file", "these files", "this software", "this work")],
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0."), ("Apache-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0."),
    ("Apache-2.0", "Apache License\nVersion 2.0, January 2004"),
    *[("MIT", f"{grant}. {keep}") for grant in (f"{_MIT[0]}, subject to the following conditions", _MIT[0]) for keep in _MIT[1:]],
    ("MIT", f"{_MIT[0]}, subject to the following conditions: {_MIT[1]}"), ("MIT", f"{_MIT[0]}, subject to the following conditions."),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."),
    *[("GPL-3.0-or-later", x) for x in _gnu("General Public License", "3", True)], *[("GPL-3.0", x) for x in _gnu("General Public License", "3", False)],
    *[("GPL-2.0-or-later", x) for x in _gnu("General Public License", "2", True)], *[("GPL-2.0", x) for x in _gnu("General Public License", "2", False)],
    *[("LGPL-3.0-or-later", x) for x in _gnu("Lesser General Public License", "3", True)], *[("LGPL-3.0", x) for x in _gnu("Lesser General Public License", "3", False)],
    *[("LGPL-2.1-or-later", x) for x in _gnu("Lesser General Public License", "2.1", True)], *[("LGPL-2.1", x) for x in _gnu("Lesser General Public License", "2.1", False)],
    *[("AGPL-3.0-or-later", x) for x in _gnu("Affero General Public License", "3", True)], *[("AGPL-3.0", x) for x in _gnu("Affero General Public License", "3", False)],
    *[("BSD-3-Clause", " ".join([*grant, _NAMES_OF.format(who)])) for grant in (_BSD, _BSD_INLINE) for who in ("the copyright holder", "the copyright holders", "the author", "the University", "the organization", "Google Inc.", "Google LLC")],
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", " ".join(_BSD)), ("BSD-2-Clause", " ".join(_BSD_INLINE)),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("MIT-0", f"{_MIT[0]}."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License, v. 2.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-2.0/."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n"),
    *[("Zlib", f"This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions{end}") for end in (".", ": 1.")],
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
]
#: Counts only where no rule above matches: plain notices of open licences hold the sentence, too.
LAST = ("Proprietary", "All rights reserved.")


def sentences(text: str, wrapped: bool = True) -> list[str]:
    """The normalised sentences of a text, in plain Python: what the expressions below do."""
    text = text.lower().replace("|", " ")
    for pattern, by in STEPS:
        text = re.sub(pattern.replace(r"\z", r"\Z"), by.replace("$", "\\"), text)
    text = re.sub(WRAPPED, " ", text if wrapped else re.sub(LINES, "|", text))
    return [s for s in (x.strip(" ") for x in text.split("|")) if s]


def compiled(names=None, notices=None, last: tuple[str, str] | None = LAST) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """(identifier by sentence, rules): a rule is a licence and its identifiers as ',3,,7,', longer ones first. All
    one-sentence notices of a licence share an identifier; the rule of `last` comes last."""
    names, notices = NAMES if names is None else names, NOTICES if notices is None else notices
    known: dict[str, int] = {}
    rules: list[tuple[str, tuple[int, ...]]] = []
    for licence, several in names.items():
        own = 1 + max(known.values(), default=-1)
        said = [f"{subject}{verb} {the}{name}" for subject in SUBJECTS for verb in VERBS for the in ("", "the ") for name in several] + [f"License: {name}" for name in several]
        said += [f"{the}{name}" for the in ("", "the ") for name in several if licence in TITLED]
        for s in said:
            (one,) = sentences(s)
            if known.setdefault(one, own) != own:
                raise ValueError(f"{one!r} is said of two licences")
        rules.append((licence, (own,)))
    spdx = [(licence, f"SPDX-License-Identifier: {name}") for name, licence in SPDX.items()] if names is NAMES else []
    for licence, text in [*spdx, *notices]:
        sequence = tuple(known.setdefault(s, 1 + max(known.values(), default=-1)) for s in sentences(text))
        rules.append((licence, sequence))
    rules.sort(key=lambda r: -len(r[1]))
    if last:
        rules.append((last[0], tuple(known.setdefault(s, 1 + max(known.values())) for s in sentences(last[1]))))
    return known, list(dict.fromkeys((licence, "".join(f",{k}," for k in sequence)) for licence, sequence in rules))


def anchors(known: dict[str, int]) -> list[str]:
    """Parts of words such that every known sentence holds one: cutting leaves words as they are, so a text with none of
    them has no known sentence. ANCHORS, and the longest word of each sentence that they miss."""
    out = list(ANCHORS)
    for s in known:
        if not any(a in s for a in out):
            out.append(max(s.split(), key=len))
    return out


def _marked(text: Column, words: list[str]) -> Column:
    """The text in lower case with '|' where sentences end, but at line ends; '' for a text without any of the words."""
    lower = F.lower(text)
    out, any_ = F.translate(lower, "|", " "), F.lit(False)
    for pattern, by in STEPS:
        out = F.regexp_replace(out, pattern, by)
    for a in words:
        any_ = any_ | F.contains(lower, F.lit(a))
    return F.when(any_, out).otherwise("")


def _found(marked: str, known: dict[str, int]) -> Column:
    """The identifiers of the known sentences of a column in order, as one string ',3,,7,'."""
    parts = f"split(trim(regexp_replace({marked}, '{WRAPPED}', ' ')), ' ?[|] ?')"
    listed, codes = ", ".join(f"'{s}'" for s in known), ",".join(map(str, known.values()))
    # few sentences are known, so a look into a hashed set comes first
    hits = f"filter({parts}, s -> s IN ({listed}))"
    return F.expr(f"array_join(transform({hits}, s -> concat(',', element_at(map_from_arrays(split('{'|'.join(known)}', '[|]'), split('{codes}', ',')), s), ',')), '')")


def _matched(ids: Column, rules: list[tuple[str, str]]) -> Column:
    """The licences of the rules that match, in order; what a rule matched is taken from the rest."""
    listed = F.arrays_zip(F.split(F.lit("|".join(name for name, _ in rules)), "[|]"), F.split(F.lit("|".join(pattern for _, pattern in rules)), "[|]"))
    start = F.struct(ids.alias("rest"), F.array().cast("array<string>").alias("found"))
    step = lambda so_far, r: F.struct(F.replace(so_far["rest"], r["1"], F.lit("|")).alias("rest"), F.when(F.contains(so_far["rest"], r["1"]), F.array_append(so_far["found"], r["0"])).otherwise(so_far["found"]).alias("found"))
    none = F.array().cast("array<string>")
    return F.when(ids == "", none).otherwise(F.coalesce(F.aggregate(listed, start, step, lambda x: x["found"]), none))


def licences(docs: DataFrame, names=None, notices=None, last: tuple[str, str] | None = LAST) -> DataFrame:
    """(doc_id, licences, sentences) for every row of docs: the names found, sorted and joined by '|', and how many
    known sentences there are (by lines).

    Null, empty and licence-free texts have '' and 0; null doc_ids and repeated rows have their own lines. Sentences are
    sought twice, with line ends ending them and with sentences running over them, and either counts. `last` counts only
    where nothing else does. A sentence of two licences raises. Whole texts are scanned. Other columns are ignored; no
    rows give no rows.
    """
    known, rules = compiled(names, notices, last)
    marked = docs.select("doc_id", _marked(F.coalesce("text", F.lit("")), anchors(known)).alias("marked"))
    marked = marked.select("doc_id", "marked", F.regexp_replace("marked", LINES, "|").alias("lines"))
    rows = marked.select("doc_id", _found("lines", known).alias("by_line"), _found("marked", known).alias("wrapped"))
    found = F.array_distinct(F.concat(_matched(F.col("by_line"), rules), _matched(F.col("wrapped"), rules)))
    if last:
        others = F.filter(found, lambda x: x != last[0])
        found = F.when(F.size(others) > 0, others).otherwise(found)
    return rows.select("doc_id", F.array_join(F.array_sort(found), "|").alias("licences"), F.regexp_count("by_line", F.lit(r"\d+")).cast("long").alias("sentences"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"))


QUERIES = {"op10_license_scan": op10_license_scan}


def _oracle() -> str:
    """The scan with joins, one row a sentence, and the rules one after the other by recursion."""
    known, rules = compiled()
    marked = "replace(lower(text), '|', ' ')"
    for pattern, by in STEPS:
        sql = lambda s: s.replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r")
        marked = f"regexp_replace({marked}, '{sql(pattern)}', E'{sql(by).replace('$', chr(92) * 2)}', 'g')"
    parts = lambda x: f"string_split_regex(trim(regexp_replace({x}, '{WRAPPED}', ' ', 'g')), ' ?[|] ?')"
    values = ", ".join(f"('{s}', {k})" for s, k in known.items())
    steps = ", ".join(f"({k}, '{name}', '{pattern}')" for k, (name, pattern) in enumerate(rules, 1))
    return f"""
        WITH RECURSIVE known(sentence, code) AS (VALUES {values}), rules(k, name, pattern) AS (VALUES {steps}),
        marked AS (SELECT doc_id, {marked} AS t FROM documents),
        twice AS (SELECT doc_id, 1 AS how, {parts("regexp_replace(t, '[\\r\\n]+', '|', 'g')")} AS s FROM marked UNION ALL SELECT doc_id, 2, {parts("t")} FROM marked),
        parts AS (SELECT doc_id, how, unnest(s) AS s, generate_subscripts(s, 1) AS pos FROM twice),
        hits AS (SELECT doc_id, how, pos, code FROM parts JOIN known ON s = sentence),
        walk AS (
            SELECT doc_id, how, 0 AS k, string_agg(',' || code || ',', '' ORDER BY pos) AS rest, NULL::VARCHAR AS name FROM hits GROUP BY doc_id, how
            UNION ALL
            SELECT doc_id, how, r.k, replace(rest, pattern, '|'), CASE WHEN contains(rest, pattern) THEN r.name END FROM walk w JOIN rules r ON r.k = w.k + 1),
        names AS (SELECT DISTINCT doc_id, name FROM walk WHERE name IS NOT NULL),
        shown AS (SELECT * FROM names n WHERE name <> '{LAST[0]}' OR NOT EXISTS (SELECT 1 FROM names o WHERE o.doc_id = n.doc_id AND o.name <> '{LAST[0]}')),
        lists AS (SELECT doc_id, string_agg(name, '|' ORDER BY name) AS licences FROM shown GROUP BY doc_id),
        counts AS (SELECT doc_id, count(*) AS sentences FROM hits WHERE how = 1 GROUP BY doc_id)
        SELECT d.doc_id, coalesce(l.licences, '') AS licences, coalesce(c.sentences, 0)::BIGINT AS sentences
        FROM documents d LEFT JOIN lists l ON d.doc_id = l.doc_id LEFT JOIN counts c ON d.doc_id = c.doc_id"""


ORACLES = {"op10_license_scan": _oracle()}
