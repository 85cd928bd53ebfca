"""Licence scan by sentence rules, with DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Licence names as texts write them, by identifier.
NAMES = {
    "MIT": ["mit license", "mit licence", "expat license"],
    "Apache-2.0": ["apache license, version 2.0", "apache license version 2.0", "apache license 2.0", "apache 2.0 license"],
    "GPL-2.0": ["gnu general public license, version 2", "gnu general public license version 2", "gnu gpl v2", "gpl-2.0"],
    "GPL-3.0": ["gnu general public license, version 3", "gnu general public license version 3", "gnu gpl v3", "gpl-3.0"],
    "LGPL-2.1": ["gnu lesser general public license, version 2.1", "gnu lesser general public license version 2.1", "lgpl-2.1"],
    "LGPL-3.0": ["gnu lesser general public license, version 3", "gnu lesser general public license version 3", "lgpl-3.0"],
    "AGPL-3.0": ["gnu affero general public license, version 3", "gnu affero general public license version 3", "agpl-3.0"],
    "MPL-2.0": ["mozilla public license, version 2.0", "mozilla public license version 2.0", "mozilla public license 2.0"],
    "EPL-2.0": ["eclipse public license, version 2.0", "eclipse public license 2.0", "eclipse public license - v 2.0"],
    "BSD-2-Clause": ["2-clause bsd license", "bsd 2-clause license", "simplified bsd license"],
    "BSD-3-Clause": ["3-clause bsd license", "bsd 3-clause license", "new bsd license", "modified bsd license"],
    "ISC": ["isc license"],
    "Zlib": ["zlib license", "zlib/libpng license"],
    "BSL-1.0": ["boost software license, version 1.0", "boost software license version 1.0", "boost software license 1.0",
                "boost software license - version 1.0 - august 17th, 2003", "boost software license, version 1.0."],
    "WTFPL": ["wtfpl", "wtfpl license", "wtfpl, version 2", "do what the fuck you want to public license",
              "do what the fuck you want to public license, version 2"],
    "Unlicense": ["unlicense", "unlicense license"],
    "CC0-1.0": ["cc0 1.0 universal license", "cc0 1.0 universal", "cc0 license"],
    "CC-BY-4.0": ["cc by 4.0", "creative commons attribution 4.0 international license"],
    "CC-BY-SA-4.0": ["cc by-sa 4.0", "creative commons attribution-sharealike 4.0 international license"],
    "CC-BY-NC-4.0": ["cc by-nc 4.0", "creative commons attribution-noncommercial 4.0 international license"],
    "CC-BY-ND-4.0": ["cc by-nd 4.0", "creative commons attribution-noderivatives 4.0 international license"],
}
#: How a sentence names a licence: what it speaks of, what is said, and the name at its end.
PHRASE = (r"^(?:(?:this|the|our|all|its) (?:work|project|software|file|program|library|code|source code|package|document|content|data)s? "
          r"(?:is|are) |(?:use of )?(?:this |the )?(?:source )?code (?:is )?|it is |they are )?(?:also |now )?"
          r"(?:licen[sc]ed|released|distributed|made available|available|provided|published|covered|governed)(?: to you)? (?:under|by) "
          r"(?:the )?(?:terms of |terms and conditions of )?(?:the |a |an )?(.{3,100})$")
#: Sentences of licence texts and notices, by sentence identifier.
SENTENCES = {
    "mit-grant": "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "isc-grant": "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "as-is": "the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",
    "apache-grant": "licensed under the apache license, version 2.0 (the license)",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0",
    "apache-as-is": "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied",
    "gpl-free": "this program is free software",
    "gpl-grant-2": "you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl-grant": "you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "agpl-grant": "you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "gpl-either-21": "either version 2.1 of the license, or (at your option) any later version",
    "gpl-version-2": "version 2 of the license",
    "gpl-version-21": "version 2.1 of the license",
    "gpl-version-3": "version 3 of the license",
    "gpl-either-2": "either version 2 of the license, or (at your option) any later version",
    "gpl-either-3": "either version 3 of the license, or (at your option) any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful, but without any warranty",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license, v. 2.0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "public-domain": "this work is in the public domain",
    "all-rights": "all rights reserved",
    "zlib-as-is": "this software is provided as-is, without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "boost-grant": "permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the software) to use, reproduce, display, distribute, execute, and transmit the software, and to prepare derivative works of the software, and to permit third-parties to whom the software is furnished to do so, all subject to the following",
    "wtfpl-grant": "you just do what the fuck you want to",
    "wtfpl-title": "do what the fuck you want to public license",
    "unlicense-grant": "anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "apache-title": "apache license",
    "apache-version": "version 2.0, january 2004",
    "apache-copyright": "subject to the terms and conditions of this license, each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare derivative works of, publicly display, publicly perform, sublicense, and distribute the work and such derivative works in source or object form",
    "gpl-title": "gnu general public license",
    "lgpl-title": "gnu lesser general public license",
    "agpl-title": "gnu affero general public license",
    "gnu-v2-text": "version 2, june 1991",
    "gnu-v21-text": "version 2.1, february 1999",
    "gnu-v3-text": "version 3, 29 june 2007",
    "agpl-v3-text": "version 3, 19 november 2007",
    "gnu-verbatim": "everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",
    "cc0-text": "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law",
    **{f"cc-link:CC-{k.upper()}-4.0": f"to view a copy of this license, visit http://creativecommons.org/licenses/{k}/4.0"
       for k in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")},
}
#: Sentences with a name in them, as patterns of their normalised form, and what they are read as.
WITH_NAMES = [
    (r"^neither the names? of .{1,300} may be used to endorse or promote products derived from this software without (?:specific )?prior written permission$", "bsd-endorse"),
    (r"^the names? of .{1,300} may not be used to endorse or promote products derived from this software without (?:specific )?prior written permission$", "bsd-endorse"),
    (r"^this software is provided by .{1,300} as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed$", "bsd-as-is"),
]
_SUBJECTS = ["this program", "this library", "this file", "this software", "this package", "it"]
_GNU = {"GPL": ("gpl-grant-2", "general", ("2", "3")), "LGPL": ("lgpl-grant", "lesser general", ("2.1", "3")),
        "AGPL": ("agpl-grant", "affero general", ("3",))}


def _variants() -> dict[str, str]:
    """Other spellings of sentences, by spelling: the GNU notices with commas, and identifiers of SPDX lines."""
    out = {f"{who} is free software": "gpl-free" for who in _SUBJECTS}
    out["permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies"] = "isc-grant"
    out["permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"] = "isc-grant"
    for name, (grant, kind, versions) in _GNU.items():
        start = f"you can redistribute it and/or modify it under the terms of the gnu {kind} public license"
        if name == "LGPL":
            out[SENTENCES[grant].replace("lesser", "library")] = grant
        for v in versions:
            number = v if "." in v else f"{v}.0"
            for mark in ("", ","):
                out[f"{start}{mark} version {v} as published by the free software foundation"] = f"only:{name}-{number}"
                out[f"{start}{mark} version {v}{mark} as published by the free software foundation"] = f"only:{name}-{number}"
            out[f"{start} as published by the free software foundation, version {v}"] = f"only:{name}-{number}"
            out[f"{start} as published by the free software foundation, version {v} of the license"] = f"only:{name}-{number}"
            for option in ("(at your option)", "at your option,", "at your option"):
                later = f"either version {v} of the license, or {option} any later version"
                out[f"{start} as published by the free software foundation, {later}"] = f"later:{name}-{number}"
                out[later] = f"gpl-either-{v.replace('.', '')}"
    return out | {SPDX + i.lower(): f"spdx:{SPDX_OLD.get(i, i)}" for i in [*SPDX_IDS, *SPDX_OLD]}


#: How an SPDX line begins once its colon is taken, and the fixed identifiers that it may name; older spellings by what they mean.
SPDX = "spdx-license-identifier="
SPDX_IDS = """0BSD AFL-2.1 AFL-3.0 AGPL-3.0 AGPL-3.0-or-later Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause
    BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0
    CC-BY-4.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-2.0 CC-BY-SA-3.0 CC-BY-SA-4.0
    CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 FTL GFDL-1.1 GFDL-1.2 GFDL-1.3 GPL-1.0
    GPL-1.0-or-later GPL-2.0 GPL-2.0-or-later GPL-3.0 GPL-3.0-or-later HPND ICU IJG ISC LGPL-2.0 LGPL-2.0-or-later LGPL-2.1
    LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-or-later Libpng LPPL-1.3c MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA
    NTP ODbL-1.0 OFL-1.1 OpenSSL OSL-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby SISSL SSPL-1.0 TCL Unicode-3.0 Unicode-DFS-2016
    Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1""".split()
SPDX_OLD = ({f"{i}-only": i for i in SPDX_IDS if i.split("-")[0] in ("GPL", "LGPL", "AGPL") and not i.endswith("later")}
            | {f"{i}+": f"{i}-or-later" for i in SPDX_IDS if f"{i}-or-later" in SPDX_IDS})
#: Ordered rules; a rule takes its run of sentence identifiers away from those after it.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-grant"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-endorse"]),
    ("BSD", ["bsd-grant"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["boost-grant"]),
    ("WTFPL", ["wtfpl-title", "wtfpl-grant"]),
    ("WTFPL", ["wtfpl-grant"]),
    ("WTFPL", ["wtfpl-title"]),
    ("Apache-2.0", ["apache-title", "apache-version", "apache-copyright"]),
    ("Apache-2.0", ["apache-title", "apache-version"]),
    ("Apache-2.0", ["apache-copyright"]),
    ("GPL-2.0", ["gpl-title", "gnu-v2-text"]),
    ("GPL-3.0", ["gpl-title", "gnu-v3-text"]),
    ("LGPL-2.1", ["lgpl-title", "gnu-v21-text"]),
    ("LGPL-3.0", ["lgpl-title", "gnu-v3-text"]),
    ("AGPL-3.0", ["agpl-title", "agpl-v3-text"]),
    ("ISC", ["isc-grant"]),
    ("Apache-2.0", ["apache-grant", "apache-use", "apache-copy", "apache-as-is"]),
    ("Apache-2.0", ["apache-grant", "apache-use"]),
    ("Apache-2.0", ["apache-grant"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl-grant-2", "gpl-either-2"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-grant-2", "gpl-either-3"]),
    ("GPL-2.0", ["gpl-free", "gpl-grant-2", "gpl-version-2"]),
    ("GPL-3.0", ["gpl-free", "gpl-grant-2", "gpl-version-3"]),
    *[(f"{name}-{v if '.' in v else v + '.0'}{end}", [*free, grant, f"{key}-{v.replace('.', '')}"])
      for name, (grant, _, versions) in _GNU.items() for free in (["gpl-free"], []) for v in [*versions, *(["2"] if name == "LGPL" else [])]
      for key, end in (("gpl-either", "-or-later"), ("gpl-version", ""))
      if not (name == "GPL" and free)],
    *[(f"{name}-{v if '.' in v else v + '.0'}{end}", [*free, f"{key}:{name}-{v if '.' in v else v + '.0'}"])
      for name, (_, _, versions) in _GNU.items() for free in (["gpl-free"], []) for v in versions
      for key, end in (("later", "-or-later"), ("only", ""))],
    ("GPL", ["gpl-free", "gpl-grant-2"]),
    *[(name, [*free, grant]) for name, (grant, _, _) in _GNU.items() for free in (["gpl-free"], []) if not (name == "GPL" and free)],
    ("MPL-2.0", ["mpl-notice"]),
    ("Unlicense", ["unlicense", "unlicense-grant"]),
    ("Unlicense", ["unlicense"]),
    ("Unlicense", ["unlicense-grant"]),
    ("CC0-1.0", ["cc0-text"]),
    *[(f"CC-{k}-4.0", [f"cc-link:CC-{k}-4.0"]) for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")],
    ("Public-Domain", ["public-domain"]),
    ("All-Rights-Reserved", ["all-rights"]),
    *[(i, [f"spdx:{i}"]) for i in SPDX_IDS],
]
#: Every known sentence holds one of these, so texts and sentences without any are done at once.
ANCHORS = "|".join(["licen[sc]", "permission", "redistribut", "warrant", "gpl-", "wtfpl", "what the fuck you", "anyone is free to",
                    r"version\s+[0-9.]+,\s+(?:[0-9]{1,2}\s+)?(?:january|february|june|november|december)\s"] + [
    a + r"[\s/*#>|;%\-\"'`]+" + b for a, b in (("public", "domain"), ("rights", "reserved"), ("free", "software"), ("gpl", "v"),
                                          ("cc0", "1\\."), ("cc", "by"))])


def sentence_table() -> dict[str, str]:
    """Normalised sentence to identifier: the fixed sentences, and each licence name, alone and after a phrase."""
    table = {s: i for i, s in SENTENCES.items()} | _variants()
    for licence, names in NAMES.items():
        for name in names:
            table.setdefault(f"under {name}", f"named:{licence}")
            table.setdefault(name, f"title:{licence}")
    return table


def rules() -> list[tuple[str, list[str]]]:
    """The ordered rules: texts and notices first, then names, then titles."""
    return RULES + [(i, [f"named:{i}"]) for i in NAMES] + [(i, [f"title:{i}"]) for i in NAMES]


def _normalised(sentence) -> F.Column:
    s = F.regexp_replace(F.lower(sentence), r"[\s/*#>|]+", " ")
    s = F.regexp_replace(s, "[\"'`“”‘’]", "")
    s = F.regexp_replace(s, r"^[\s\-;(]*(?:\d+\.|\([a-z]\))?\s*|[\s.!?:;,]+$", "")
    s = F.regexp_replace(s, r"^(?:copyright|\(c\)|©).*\ball rights reserved$", "all rights reserved")
    s = F.trim(F.regexp_replace(s, "https?: ?", "http:"))
    for pattern, sentence in WITH_NAMES:
        s = F.regexp_replace(s, pattern, SENTENCES[sentence])
    return F.when(s.startswith("licensed under the apache license, version 2.0 ("), s).otherwise(F.regexp_replace(s, PHRASE, "under $1"))


def _bare(text) -> F.Column:
    """The text without comment marks: lines of marks alone are blank, and copyright lines are paragraphs of their own."""
    t = F.regexp_replace(text, r"(?m)^[ \t]*(?:/\*+!?|//+!?|\*+/|\*+(?=\s|$)|#+!?|<!--+|--+|;+|%+|[>|]+|(?:rem|REM|dnl)(?=\s|$))", "")
    t = F.regexp_replace(t, r"(?m)[ \t]*(?:\*+/|--+>)[ \t]*\r?$", "")
    t = F.regexp_replace(t, r"(?mi)^([ \t]*(?:copyright\s+(?:\(c\)|©|[0-9]{4})|\(c\)|©|all rights reserved\.?[ \t]*\r?$).*)$", "\n$1\n\n")
    t = F.regexp_replace(t, r"(?i)(license at)\s+(?=https?:)", "$1 ")
    t = F.regexp_replace(t, r"\b([vV])\.\s+(?=[0-9])", "$1.")
    t = F.regexp_replace(t, r"\b(Inc|INC|Ltd|LTD|Corp|CORP|Co|CO)\.(\s+)(?=[a-z]|NOR |AND |OR |MAY )", "$1$2")
    return F.regexp_replace(t, r"(?i)SPDX-License-Identifier\s*:[ \t]*(\S[^\n]*)", f"\n\n{SPDX}$1\n\n")


def _key(sentence: str) -> str:
    """What ``_normalised`` makes of a table sentence: slashes are spaces, and web addresses lose theirs."""
    s = re.sub(r"[\s/*#>|]+", " ", sentence.lower())
    return re.sub("https?: ?", "http:", re.sub(r"\bv\. (?=[0-9])", "v.", s)).strip()


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, licences, sentences, leftover) for each document.

    Comment marks at line starts are taken off first, and SPDX lines name their identifiers. Texts are
    split twice into sentences: at line ends and sentence ends, and, for wrapped licence texts, at
    blank lines and sentence ends only. Sentences are normalised (case, white space, comment marks,
    quotes, numbering, closing marks, the names of holders) and mapped to identifiers. The identifiers in
    order are matched against the ordered rules; a rule takes away the run that it matches, so that
    a shorter rule doesn't match again. All-Rights-Reserved is given only without another licence, since
    licence texts say it too. ``licences`` are sorted and distinct, ``sentences`` the
    identifiers found (line split first), ``leftover`` those that no rule took. All that is one
    expression a row: no shuffle, a very long text being one value. Null and empty texts have empty arrays; repeated rows give a row
    each; an empty table gives none.
    """
    known = {_key(s): i for s, i in sentence_table().items()}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    named = lambda s: F.try_element_at(table, s)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ends = r"(?<=[.!?:;])\s+"

    def sequence(split: str) -> F.Column:
        likely = F.filter(F.split("_text", split), lambda s: F.lower(s).rlike(ANCHORS))
        found = F.flatten(F.transform(likely, lambda s: F.when(
            F.startswith(s, F.lit(SPDX)),  # an expression of identifiers, of which WITH adds exceptions that have none
            F.transform(F.split(F.substring(s, len(SPDX) + 1, 2 ** 31 - 1), r"[^A-Za-z0-9.+\-]+"),
                        lambda i: named(F.concat(F.lit(SPDX), F.lower(i))))
        ).otherwise(F.array(named(_normalised(s))))))
        return F.filter(found, lambda i: i.isNotNull())

    rule_array = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(";" + ";;".join(run) + ";").alias("run"))
                           for name, run in rules()])

    def apply(state, rule):
        hit = F.contains(state["run"], rule["run"])
        return F.struct(F.when(hit, F.replace(state["run"], rule["run"], F.lit(""))).otherwise(state["run"]).alias("run"),
                        F.when(hit, F.concat(state["names"], F.array(rule["name"]))).otherwise(state["names"]).alias("names"))

    def matched(run) -> F.Column:
        return F.aggregate(rule_array, F.struct(run.alias("run"), F.array().cast("array<string>").alias("names")), apply)

    maybe = F.lower(text).rlike(ANCHORS)
    none = F.array().cast("array<string>")
    # exploding arrays of one element keeps what stands below from being evaluated again for each use above
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_text"), F.explode(F.array(maybe)).alias("_maybe"))
    rows = rows.select("doc_id", "_maybe", F.explode(F.array(F.when(F.col("_maybe"), _bare(F.col("_text"))).otherwise(""))).alias("_text"))
    found = F.struct(*[F.when(F.col("_maybe"), sequence(split)).otherwise(none).alias(name) for name, split in
                       (("_lines", rf"{ends}|\s*\n\s*"), ("_wrapped", rf"{ends}|\n\s*\n\s*"))])
    rows = rows.select("doc_id", F.explode(F.array(found)).alias("_found")).select("doc_id", "_found._lines", "_found._wrapped")
    joined = lambda c: F.concat_ws("", F.transform(c, lambda i: F.concat(F.lit(";"), i, F.lit(";"))))
    rows = rows.select("doc_id", F.concat("_lines", F.array_except("_wrapped", "_lines")).alias("sentences"),
                       F.when(F.size("_lines") > 0, matched(joined(F.col("_lines")))).alias("_a"),
                       F.when(F.size("_wrapped") > 0, matched(joined(F.col("_wrapped")))).alias("_b"))
    names = F.array_sort(F.array_distinct(F.concat(F.coalesce("_a.names", none), F.coalesce("_b.names", none))))
    names = F.when(F.size(names) > 1, F.array_remove(names, "All-Rights-Reserved")).otherwise(names)
    left = F.coalesce(F.when(F.size(F.coalesce("_b.names", none)) > 0, F.col("_b.run")), F.col("_a.run"), F.lit(""))
    return rows.select("doc_id", names.alias("licences"), "sentences",
                       F.filter(F.split(left, ";"), lambda x: x != "").alias("leftover"))
