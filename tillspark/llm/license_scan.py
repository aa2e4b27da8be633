"""Operator 8 -- licence scans by sentence rules, in SQL functions only.

A text is cut into sentences at sentence ends, blank lines and wherever a known
long sentence begins (so that flattened texts and headings do not hide it), after
comment marks and list items are taken off and wrapped lines joined.  Each
sentence is normalised, with a place for the names of holders, and looked up by
hash in a table of known licence sentences; the identifiers of the known ones,
in order, are matched against ordered licence rules.  Longer rules are matched
first and consume what they match.  SPDX tags give one identifier for each
licence of their expression.  Every step works inside a row; nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.llm.common import text_or_empty, without

# Normalised sentences of short notices.
SENTENCES = {
    "licensed under the apache license version 2.0": "apache-notice",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at http www.apache.org licenses license-2.0": "apache-copy",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-include",
    "the software is provided as is without warranty of any kind": "mit-warranty",
    "this work is licensed under the gnu general public license version 3": "gpl3-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-free",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-hope",
    "licensed under cc by-nc 4.0": "cc-by-nc-4-notice",
    "licensed under cc by 4.0": "cc-by-4-notice",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-grant",
    "redistributions of source code must retain the above copyright notice": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software": "bsd-endorse",
    "all rights reserved": "all-rights",
}
# Whole sentences of published licence texts and headers, and their variants.
PUBLISHED = [
    ("apache-notice", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    ("apache-notice", "Licensed under the Apache License, Version 2.0 (the License)"),
    ("apache-notice", 'The ASF licenses this file to You under the Apache License, Version 2.0 (the "License")'),
    ("apache-notice", "Licensed under the Apache License 2.0"),
    ("apache-notice", "This project is licensed under the Apache License 2.0"),
    ("apache-copy", "You may obtain a copy of the License at"),
    ("apache-copy", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-title", "Apache License Version 2.0, January 2004"),
    ("apache-title", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("apache-title", "Apache License Version 2.0, January 2004 https://www.apache.org/licenses/"),
    ("mit-notice", "This project is licensed under the MIT License"),
    ("mit-notice", "Licensed under the MIT License"),
    ("mit-notice", "Distributed under the MIT License"),
    (
        "mit-grant",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    ("mit-include", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"),
    (
        "mit-warranty",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    ),
    (
        "mit-warranty",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NON-INFRINGEMENT",
    ),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted (subject to the limitations in the disclaimer below) provided that the following conditions are met"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    (
        "bsd-binary",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution",
    ),
    ("bsd-advertising", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    (
        "isc-grant",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "isc-grant",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies",
    ),
    ("0bsd-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl2-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense-grant", "This is free and unencumbered software released into the public domain"),
    (
        "zlib-grant",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions",
    ),
    ("bsl-title", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("bsl-notice", "Distributed under the Boost Software License, Version 1.0"),
    ("epl2-notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("cc0-title", "CC0 1.0 Universal"),
    ("gpl2-title", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("gpl3-title", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("lgpl21-title", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("lgpl3-title", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("agpl3-title", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("gpl3-notice", "This work is licensed under the GNU General Public License v3.0"),
    (
        "mit0-grant",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    ("mit0-title", "MIT No Attribution"),
    ("ofl-notice", "This Font Software is licensed under the SIL Open Font License, Version 1.1"),
    ("ofl-title", "SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007"),
    ("eupl-title", "EUROPEAN UNION PUBLIC LICENCE v. 1.2"),
    (
        "eupl-notice",
        'Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the "Licence")',
    ),
    ("perl-terms", "you can redistribute it and/or modify it under the same terms as Perl itself"),
    ("perl-terms", "This library is free software; you may redistribute it and/or modify it under the same terms as Perl itself"),
    ("perl-terms", "you may redistribute it and/or modify it under the same terms as Perl itself"),
    ("perl-terms", "same terms as Perl"),
]
# Names under which short notices cite a licence.
CITED = {
    "MIT": ["MIT License", "MIT license (MIT)"],
    "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License", "Apache License v2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-clause BSD License", "New BSD License"],
    "ISC": ["ISC License"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "MPL 2.0"],
    "GPL-2.0": ["GNU General Public License v2.0", "GNU General Public License version 2", "GPLv2"],
    "GPL-3.0": ["GNU General Public License v3.0", "GNU General Public License version 3", "GNU GPLv3", "GPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License v2.1", "GNU Lesser General Public License version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License v3.0", "GNU Lesser General Public License version 3"],
    "AGPL-3.0": ["GNU Affero General Public License v3.0", "GNU Affero General Public License version 3"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License - v 2.0"],
    "EUPL-1.2": ["EUPL", "EUPL 1.2", "European Union Public Licence 1.2"],
    "OFL-1.1": ["SIL Open Font License 1.1", "SIL Open Font License, Version 1.1"],
    "Unlicense": ["Unlicense"],
    "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0"],
    "MIT-0": ["MIT No Attribution License", "MIT-0 License"],
}
NOTICE_ID = {"MIT": "mit-notice", "Apache-2.0": "apache-notice", "GPL-3.0": "gpl3-notice", "OFL-1.1": "ofl-notice", "BSL-1.0": "bsl-notice", "EUPL-1.2": "eupl-notice"}
for _name, _ways in CITED.items():
    for _way in _ways:
        for _verb in ("Licensed", "Released", "Distributed", "Available", "Published"):
            PUBLISHED.append((NOTICE_ID.setdefault(_name, f"{_name.lower()}-notice"), f"{_verb} under the {_way}"))
#: the Free Software Foundation's headers; a semicolon parts sentences, a colon or comma does not
GNU = [("gpl", "GNU General Public License"), ("lgpl", "GNU Lesser General Public License"), ("agpl", "GNU Affero General Public License")]
GNU_VERSIONS = {"gpl": ("2", "3"), "lgpl": ("2.1", "3"), "agpl": ("3",)}
for _key, _name in GNU:
    for _what in ("", *[f"This {x} is free software: " for x in ("program", "library", "software", "file")]):
        _terms = f"{_what}you can redistribute it and/or modify it under the terms of the {_name} as published by the Free Software Foundation"
        PUBLISHED.append((f"{_key}-terms", _terms))
        for _version in GNU_VERSIONS[_key]:
            PUBLISHED.append((f"{_key}{_version}-later", f"{_terms}, either version {_version} of the License, or (at your option) any later version"))
            PUBLISHED.append((f"{_key}{_version}-only", f"{_terms}, version {_version} of the License"))
            PUBLISHED.append((f"{_key}{_version}-only", _terms.replace(" as published", f" version {_version} as published")))
            PUBLISHED.append((f"{_key}{_version}-only", _terms.replace(" as published", f", version {_version}, as published")))
for _version in ("2", "2.1", "3"):
    PUBLISHED.append((f"either-{_version}-later", f"either version {_version} of the License, or (at your option) any later version"))
    PUBLISHED.append((f"only-{_version}", f"version {_version} of the License"))
for _what in ("library", "software", "file"):
    PUBLISHED.append(("gpl-hope", f"This {_what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"))
CC = {"CC-BY-4.0": "Attribution 4.0", "CC-BY-SA-4.0": "Attribution-ShareAlike 4.0", "CC-BY-NC-4.0": "Attribution-NonCommercial 4.0", "CC-BY-ND-4.0": "Attribution-NoDerivatives 4.0", "CC-BY-NC-SA-4.0": "Attribution-NonCommercial-ShareAlike 4.0", "CC-BY-NC-ND-4.0": "Attribution-NonCommercial-NoDerivatives 4.0"}
CC_ID = {"CC-BY-4.0": "cc-by-4-notice", "CC-BY-NC-4.0": "cc-by-nc-4-notice"}
for _name, _words in CC.items():
    _id = CC_ID.setdefault(_name, _name.lower().replace("-4.0", "-4-notice"))
    for _text in (f"This work is licensed under a Creative Commons {_words} International License", f"This work is licensed under the Creative Commons {_words} International License", f"Licensed under {_name[:-4].replace('-', ' ', 1)} 4.0", f"This work is licensed under {_name[:-4].replace('-', ' ', 1)} 4.0", f"Creative Commons {_words} International", f"Creative Commons {_words} International Public License"):
        PUBLISHED.append((_id, _text))
SPDX = [
    "Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "MPL-2.0", "Unlicense", "Zlib", "BSL-1.0", "EPL-2.0", "CC0-1.0", "MIT-0", "OFL-1.1", "EUPL-1.2", *CC,
    *[f"{k}-{v}{end}" for k, v in [("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0")] for end in ("", "-only", "-or-later")],
]
# Licence rules, an ordered sequence of sentence identifiers each.
RULES = [
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-notice", "apache-compliance", "apache-copy"]),
    ("MIT", ["mit-grant", "mit-include", "mit-warranty"]),
    ("GPL", ["gpl-free", "gpl-hope"]),
    ("Apache-2.0", ["apache-notice"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-grant"]),
    ("GPL-3.0", ["gpl3-notice"]),
    ("GPL", ["gpl-free"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-notice"]),
    ("CC-BY-4.0", ["cc-by-4-notice"]),
    ("Apache-2.0", ["apache-title"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant"]),
    ("MPL-2.0", ["mpl2-notice"]),
    ("Unlicense", ["unlicense-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["bsl-title"]),
    ("BSL-1.0", ["bsl-notice"]),
    ("EPL-2.0", ["epl2-notice"]),
    ("CC0-1.0", ["cc0-title"]),
    ("GPL-2.0", ["gpl2-title"]),
    ("GPL-3.0", ["gpl3-title"]),
    ("LGPL-2.1", ["lgpl21-title"]),
    ("LGPL-3.0", ["lgpl3-title"]),
    ("AGPL-3.0", ["agpl3-title"]),
    *[(name, [CC_ID[name]]) for name in CC if name not in ("CC-BY-4.0", "CC-BY-NC-4.0")],
    *[(name, [f"spdx-{name.lower()}"]) for name in SPDX],
    *[(name, [i]) for name, i in NOTICE_ID.items() if name not in ("MIT", "Apache-2.0", "GPL-3.0", "BSL-1.0")],
    ("MIT-0", ["mit0-grant"]),
    ("MIT-0", ["mit0-grant", "mit-warranty"]),
    ("MIT-0", ["mit0-title"]),
    ("OFL-1.1", ["ofl-title"]),
    ("EUPL-1.2", ["eupl-title"]),
    ("Artistic-1.0-Perl OR GPL-1.0-or-later", ["perl-terms"]),
]
for _key, _versions in GNU_VERSIONS.items():
    for _version in _versions:
        _name = f"{_key.upper()}-{_version if '.' in _version else _version + '.0'}"
        RULES += [
            (f"{_name}-or-later", [f"{_key}-terms", f"either-{_version}-later"]),
            (f"{_name}-or-later", [f"{_key}{_version}-later"]),
            (_name, [f"{_key}-terms", f"only-{_version}"]),
            (_name, [f"{_key}{_version}-only"]),
        ]
    RULES.append((_key.upper(), [f"{_key}-terms"]))
#: a line that holds nothing but comment marks is blank
MARKS = r"[ \t]*(?:(?:/\*+|\*+/?|//+|#+|;+|%+|--+|<!--|-->|!|\|)|(?i:dnl|rem)(?=[ \t\n]))?[ \t]*"
#: comment marks at the start of a line, at its end, list items, copyright lines
LINE_START = rf"(?m)^{MARKS}"
LINE_END = r"(?m)[ \t]*(?:\*+/|-->)[ \t]*$"
ITEM = r"(?m)^(?:[0-9]{1,2}[.)]|\([a-z0-9]{1,3}\)|[a-z]\)|[-*\u2022])[ \t]+"
COPYRIGHT = r"(?mi)^(copyright\b.*|\(c\) .*)$"
#: a sentence ends at a blank line or after . ! ? ; before white space (not inside "v. 2.0")
BREAK = r"\n\s*\n|(?<=[.!?;])(?<!\bv\.)\s+"
#: SPDX tags, wherever they stand in a line
SPDX_PLUS = r"(?i)(SPDX-License-Identifier:[^\n]*?[0-9])\+"
SPDX_TAG = r"(?i)\bSPDX-License-Identifier:[ \t]*([^\n]*)"
TAG = "spdx-license-identifier "
#: the sentence that stands for its kind, whoever is named
ENDORSE = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"
#: (words inside, pattern, replacement) of normalised sentences that name a holder, or what is licensed
PLACES = [
    (" endorse or promote ", r"^(?:neither )?the names? of .+ may (?:not )?be used to endorse or promote products derived from this software(?: without specific prior written permission)?$", ENDORSE),
    (" under ", r"^(?:(?:this|the) )?(?:[a-z0-9-]+ ){1,3}(?:is|are) (?:made )?(licensed|released|available|distributed|published) under (?:the )?(?:terms of )?(?:the )?", "$1 under the "),
]
#: known sentences of so many words may begin anywhere in a text
LONG_WORDS = 12
#: known sentences are parted by hash into so many maps
MAPS = 128


def normalised(sentence: Column) -> Column:
    """Lower case; everything but letters, digits, inner dots and hyphens becomes one space."""
    kept = F.regexp_replace(F.lower(sentence), r"[^a-z0-9.-]+", " ")
    return F.regexp_replace(kept, r"^[ .-]+|[ .-]+$|(?<= )[.-]+ |[.-]+(?= )", "")


def _normal(sentence: str) -> str:
    """``normalised`` of a fixed sentence."""
    kept = re.sub(r"[^a-z0-9.-]+", " ", sentence.lower())
    return re.sub(r"^[ .-]+|[ .-]+$|(?<= )[.-]+ |[.-]+(?= )", "", kept)


SENTENCES |= {_normal(text): name for name, text in PUBLISHED}
SENTENCES |= {TAG + name.lower(): f"spdx-{name.lower()}" for name in SPDX}


def beginnings(sentences: dict[str, str]) -> list[str]:
    """First words of the long known sentences: as few (four at least) as neither
    occur inside a known sentence nor begin a short one."""
    out = set()
    short = [s for s in sentences if s.count(" ") + 1 < LONG_WORDS]
    for s in sentences:
        words = s.split(" ")
        for n in range(4, LONG_WORDS + 1) if len(words) >= LONG_WORDS else ():
            start = " ".join(words[:n])
            if not any(f" {start} " in f"{other} " for other in sentences) and not any(f"{x} ".startswith(f"{start} ") for x in short):
                out.add(start)
                break
    return sorted(out)


def triggers(sentences: dict[str, str]) -> list[str]:
    """Long words of which every known sentence holds one: a text without any has none to find."""
    left = {s: set(re.findall(r"[a-z]{6,}", s)) or {s} for s in sentences}
    out = []
    while left:
        best = max(sorted({w for ws in left.values() for w in ws}), key=lambda w: (sum(w in ws for ws in left.values()), len(w)))
        out.append(best)
        left = {s: ws for s, ws in left.items() if best not in ws}
    return out


def sentences_of(text: Column, starts: list[str] = ()) -> Column:
    """Sentences, with the line breaks inside them; without comment marks and list items."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    tagged = F.regexp_replace(F.regexp_replace(text, SPDX_PLUS, "$1-or-later"), SPDX_TAG, "\n\n" + TAG + "$1\n\n")
    text = F.when(F.contains(F.lower(text), F.lit(TAG.strip())), tagged).otherwise(text)
    text = F.regexp_replace(F.regexp_replace(text, LINE_END, ""), LINE_START, "")
    text = F.regexp_replace(F.regexp_replace(text, ITEM, "\n\n"), COPYRIGHT, "\n\n$1\n\n")
    if starts:
        first: dict[str, list[str]] = {}
        for s in starts:
            word, *rest = s.split(" ")
            first.setdefault(word, []).append(r"\W+".join(map(re.escape, rest)))
        begins = "|".join(rf"{re.escape(w)}\W+(?:{'|'.join(v)})" for w, v in sorted(first.items()))
        text = F.regexp_replace(text, rf"(?i)\s+(?=(?:{begins})\b)", "\n\n")
    return F.filter(F.split(text, BREAK, -1), lambda s: F.length(F.trim(s)) > 0)


def _lookup(sentences: dict[str, str]):
    """Normalised sentence -> identifier or null, by hash and a map of a few entries."""
    import xxhash

    parts: list[list[tuple[str, str]]] = [[] for _ in range(MAPS)]
    for s, name in sentences.items():
        h = xxhash.xxh64_intdigest(s.encode(), 42)  # F.xxhash64
        parts[(h - (1 << 64) if h >= 1 << 63 else h) % MAPS].append((s, name))
    maps = F.array(*[F.create_map(*[F.lit(x) for pair in (p or [("", "")]) for x in pair]) for p in parts])

    def of(n: Column) -> Column:
        return F.nullif(F.element_at(F.get(maps, F.pmod(F.xxhash64(n), F.lit(MAPS)).cast("int")), n), F.lit(""))

    def placed(n: Column) -> Column:
        out = F.lit(None).cast("string")
        for inside, pattern, to in reversed(PLACES):
            out = F.when(F.contains(n, F.lit(inside)), of(F.regexp_replace(n, pattern, to))).otherwise(out)
        return out

    def looked_up(n: Column) -> Column:
        # a list number that ended the sentence before the next item; a holder's name
        return F.coalesce(of(n), F.when(n.rlike(" (?:[0-9]{1,2}|[a-z])$"), of(F.regexp_replace(n, " [a-z0-9]+$", ""))), placed(n))

    return looked_up


def scan_licenses(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list | None = None) -> DataFrame:
    """All rows of ``docs`` with ``n_sentences`` (long), ``sentence_ids`` (array,
    in text order) and ``licenses`` (distinct licence names, sorted).

    A rule matches a run of consecutive known sentences (unknown sentences in
    between do not break a run).  Rules are tried longest first, then in list
    order; matched identifiers are used up.  A sentence that is not known as a whole
    is read line by line, and by pairs of lines.  Null and empty texts have no
    sentence; texts are read whole, whatever their length; repeated rows are
    scanned alike; an empty table gives an empty result; input columns named like
    the outputs are replaced.
    """
    sentences, rules = sentences or SENTENCES, rules or RULES
    rows = without(docs, "n_sentences", "sentence_ids", "licenses", "__cut", "__seq", "__any", "__norm", "__whole")
    text = text_or_empty("text")
    words = "|".join(map(re.escape, triggers(sentences)))
    step = rows.withColumn("__any", text.rlike(rf"(?i)(?:{words})"))
    step = step.withColumn("__cut", F.when(F.col("__any"), sentences_of(text, beginnings(sentences))).otherwise(sentences_of(text)))
    look_up = _lookup(sentences)
    known = lambda found: F.filter(found, lambda i: i.isNotNull())
    none = F.array().cast("array<string>")

    def by_lines(sentence: Column) -> Column:
        lines = F.split(sentence, "\n", -1)
        pairs = F.transform(F.sequence(F.lit(1), F.size(lines) - 1), lambda n: F.array_join(F.slice(lines, n, 2), " "))
        each, both = (known(F.transform(F.transform(x, normalised), look_up)) for x in (lines, pairs))
        return F.when(F.size(each) > 0, each).otherwise(both)

    def ids_of(sentence: Column, i: Column) -> Column:
        whole, n = F.get("__whole", i), F.get("__norm", i)
        tags = F.transform(F.split(F.substr(n, F.lit(len(TAG) + 1)), " "), lambda t: look_up(F.concat(F.lit(TAG), t)))
        return (
            F.when(whole.isNotNull(), F.array(whole))
            .when(F.startswith(n, F.lit(TAG)), known(tags))
            .when(F.instr(sentence, "\n") > 0, by_lines(sentence))
            .otherwise(none)
        )

    # one column a step: inside a lambda, an expression is evaluated wherever it is written
    step = step.withColumn("__norm", F.when(F.col("__any"), F.transform("__cut", normalised)))
    step = step.withColumn("__whole", F.transform("__norm", look_up))
    step = step.withColumn("sentence_ids", F.when(F.col("__any"), F.flatten(F.transform("__cut", ids_of))).otherwise(none))
    # each identifier is written ",id;" so that a rule is a plain substring
    seq = F.array_join(F.transform("sentence_ids", lambda i: F.concat(F.lit(","), i, F.lit(";"))), "")
    step = step.withColumn("__seq", seq)
    found = []
    seq = F.col("__seq")
    for name, parts in sorted(rules, key=lambda r: -len(r[1])):
        as_text = "".join(f",{p};" for p in parts)
        found.append(F.when(F.instr(seq, as_text) > 0, F.lit(name)))
        if len(parts) > 1:
            seq = F.replace(seq, F.lit(as_text), F.lit("|"))  # used up; what is left and right does not join
    licenses = F.array_sort(F.array_distinct(known(F.array(*found))))
    step = step.withColumn("licenses", F.when(F.size("sentence_ids") > 0, licenses).otherwise(none))
    step = step.withColumn("n_sentences", F.size("__cut").cast("long"))
    return step.select(*[F.col(f"`{c}`") for c in rows.columns], "n_sentences", "sentence_ids", "licenses")
