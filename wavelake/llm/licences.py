"""Licence scans by sentence rules.

A text is normalised to its run of words (A-Z lower-cased; anything but a-z and 0-9 divides words), in which an
Aho-Corasick automaton finds every known licence sentence in one pass. So wrapping, comment marks, case, punctuation
and text before or behind a sentence do not matter. What is left is a short sequence of sentence identifiers, and a
licence is found where its rule's identifiers occur in their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

from .common import id_text, utf8, with_id_of

#: Identifier -> sentence, as the licences and their customary notices have it. Families are built below.
SENTENCES = {
    "arr": "All rights reserved.",
    "mit-release": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-as-is": "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-names": "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-as-is": 'AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "apache-may-not": "you may not use this file except in compliance with the License.",
    "apache-obtain": "You may obtain a copy of the License at",
    "apache-url": "www.apache.org/licenses/LICENSE-2.0",
    "apache-title": "Apache License Version 2.0, January 2004",
    "apache-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "gnu-verbatim": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "gpl-2.0-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl-3.0-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl-2.1-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl-3.0-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl-3.0-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-title": "Mozilla Public License Version 2.0",
    "mpl-contributor": "means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
    "epl-available": "are made available under the terms of the Eclipse Public License 2.0",
    "epl-title": "Eclipse Public License - v 2.0",
    "epl-terms": 'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT").',
    "bsl-distributed": "Distributed under the Boost Software License, Version 1.0.",
    "bsl-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "zlib-altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "cc0-title": "CC0 1.0 Universal",
    "cc0-purpose": "The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = {"1.0": "", "2.0": "", "2.5": "", "3.0": " Unported", "4.0": " International"}
GNU = {"gpl": "GNU General Public License", "lgpl": "GNU Lesser General Public License", "agpl": "GNU Affero General Public License"}
GNU_VERSIONS = ("2", "2.1", "3")
SPDX = (
    "MIT", "MIT-0", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "Apache-1.1", "Apache-2.0", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib", "CC0-1.0", "Unlicense",
    *[f"{g.upper()}-{v}{end}" for g, v in (("gpl", "2.0"), ("gpl", "3.0"), ("lgpl", "2.1"), ("lgpl", "3.0"), ("agpl", "3.0")) for end in ("", "-only", "-or-later")],
    *[f"CC-{k}-{v}" for k, v in product(CC, ("3.0", "4.0"))],
)
SENTENCES |= {f"cc-{k.lower()}-{v}": f"Licensed under CC {k} {v}." for k, v in product(CC, CC_VERSIONS)}
SENTENCES |= {f"cc-{k.lower()}-{v}-name": f"licensed under a Creative Commons {CC[k]} {v}{CC_VERSIONS[v]} License" for k, v in product(CC, CC_VERSIONS)}
SENTENCES |= {f"{k}-{v}": f"This work is licensed under the {name}, version {v}." for (k, name), v in product(GNU.items(), GNU_VERSIONS)}
SENTENCES |= {f"{k}-{v}-later": f"redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version." for (k, name), v in product(GNU.items(), GNU_VERSIONS)}
SENTENCES |= {f"{k}-{v}-only": f"under the terms of the {name} version {v} as published by the Free Software Foundation" for (k, name), v in product(GNU.items(), GNU_VERSIONS)}
SENTENCES |= {f"apache-{v}": f"Licensed under the Apache License, Version {v}." for v in ("1.1", "2.0")}
SENTENCES |= {f"spdx-{x.lower()}": f"SPDX-License-Identifier: {x}" for x in SPDX}


def _dotted(v: str) -> str:
    return v if "." in v else f"{v}.0"


#: (licence, sentence identifiers in order).
RULES = [
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")), ("MIT-0", ("mit-grant", "mit-as-is")), ("MIT", ("mit-release",)), ("MIT", ("mit-licensed",)),
    ("ISC", ("isc-grant", "isc-as-is")), ("ISC", ("isc-grant-and", "isc-as-is")), ("0BSD", ("0bsd-grant", "isc-as-is")),
    ("BSD-4-Clause", ("bsd-source", "bsd-binary", "bsd-advertising", "bsd-names")), ("BSD-3-Clause", ("bsd-source", "bsd-binary", "bsd-names")), ("BSD-2-Clause", ("bsd-source", "bsd-binary")),
    *[(f"Apache-{v}", (f"apache-{v}",)) for v in ("1.1", "2.0")], ("Apache-2.0", ("apache-may-not", "apache-obtain", "apache-url")), ("Apache-2.0", ("apache-title", "apache-terms")),
    *[(f"{k.upper()}-{_dotted(v)}", (f"{k}-{v}",)) for k, v in product(GNU, GNU_VERSIONS)],
    *[(f"{k.upper()}-{_dotted(v)}-or-later", (f"{k}-{v}-later",)) for k, v in product(GNU, GNU_VERSIONS)],
    *[(f"{k.upper()}-{_dotted(v)}-only", (f"{k}-{v}-only",)) for k, v in product(GNU, GNU_VERSIONS)],
    *[(x, (f"{x.lower()}-title", "gnu-verbatim")) for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")],
    ("MPL-2.0", ("mpl-subject",)), ("MPL-2.0", ("mpl-title", "mpl-contributor")), ("EPL-2.0", ("epl-available",)), ("EPL-2.0", ("epl-title", "epl-terms")),
    ("BSL-1.0", ("bsl-distributed",)), ("BSL-1.0", ("bsl-title", "bsl-grant")), ("Zlib", ("zlib-as-is", "zlib-origin", "zlib-altered")),
    ("CC0-1.0", ("cc0",)), ("CC0-1.0", ("cc0-title", "cc0-purpose")), ("Unlicense", ("unlicense",)),
    *[(f"CC-{k}-{v}", (f"cc-{k.lower()}-{v}{end}",)) for k, v, end in product(CC, CC_VERSIONS, ("", "-name"))],
    *[(x, (f"spdx-{x.lower()}",)) for x in SPDX],
    ("all-rights-reserved", ("arr",)),
]
#: A licence is left out beside those that have all of its sentences and more.
COVERED = {"BSD-2-Clause": ("BSD-3-Clause", "BSD-4-Clause"), "BSD-3-Clause": ("BSD-4-Clause",), "MIT-0": ("MIT",)}


def _wrapped(words: list[str]) -> str:
    """Every word between spaces of its own: neighbouring sentences share none."""
    return "".join(f" {w} " for w in words)


_KEPT = bytes(b if chr(b).isalnum() and b < 128 else 32 for b in range(256)).lower()


def normalised(raw: bytes) -> str:
    """The words of UTF-8 bytes, each between two spaces."""
    return _wrapped(raw.translate(_KEPT).decode("ascii").split())


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for name, sentence in SENTENCES.items():
        key = normalised(sentence.encode())
        if key in found:
            raise ValueError(f"{name} and {found.get(key)[0]} are the same sentence")
        found.add_word(key, (name, len(key)))
    found.make_automaton()
    return found


def sentence_ids(text: str, found: ahocorasick.Automaton) -> list[str]:
    """Identifiers of the known sentences in a normalised text, in order of their begins. A sentence inside a longer known one is not told."""
    seen = sorted((end - n + 1, -(end + 1), name) for end, (name, n) in found.iter(text))
    out, reach = [], 0
    for _, end, name in seen:
        if -end > reach:
            out.append(name)
            reach = -end
    return out


def licences_of(ids: list[str]) -> list[str]:
    """The licences whose rules' identifiers occur in their order, in name order."""
    found = set()
    for name, rule in RULES:
        left = iter(ids)
        if name not in found and all(x in left for x in rule):
            found.add(name)
    return sorted(x for x in found if not found.intersection(COVERED.get(x, ())))


def scan_licences(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, sentence_ids ('<id>' each, in order), licences (joined by ';', in name order), licensed.

    Null and empty texts have no sentences and no licence. Long texts are read whole, one at a time. Where two
    sentences begin at one place the longer one counts. Repeated rows repeat; only doc_id and text are read, whatever
    other columns are called; an empty table gives an empty one. Sentences and rules are fixed tables, so nothing
    that grows with the input is shared.
    """

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = automaton()
        for batch in batches:
            ids = [sentence_ids(normalised(utf8(t)), found) for t in batch["text"]]
            named = [licences_of(x) if x else [] for x in ids]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "sentence_ids": ["".join(f"<{i}>" for i in x) for x in ids], "licences": [";".join(x) for x in named], "licensed": [bool(x) for x in named]})

    return with_id_of(docs.select(id_text(docs).alias("doc_id"), "text").mapInPandas(scanned, "doc_id string, sentence_ids string, licences string, licensed boolean"), docs)


def licences_sql() -> str:
    """DuckDB SQL for scan_licences over documents."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(normalised(s.encode()))}, {quoted(k)})" for k, s in SENTENCES.items())
    rules = ", ".join(f"({quoted(n)}, {quoted('%' + '%'.join(f'<{i}>' for i in ids) + '%')})" for n, ids in RULES)
    covered = " OR ".join(f"(f.name = {quoted(a)} AND EXISTS (FROM f g WHERE g.k = f.k AND g.name = {quoted(b)}))" for a, more in COVERED.items() for b in more)
    return rf"""
WITH known(s, id) AS (VALUES {known}), rules(name, pattern) AS (VALUES {rules}),
doc AS (SELECT row_number() OVER () AS k, doc_id, regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]*([a-z0-9]+)[^a-z0-9]*', ' \1 ', 'g') AS t FROM documents),
hit AS (SELECT k, id, length(s) AS n, string_split(t, s) AS parts FROM doc JOIN known ON contains(t, s)),
occ AS (SELECT k, id, n, unnest(list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda p: length(p))) + (i - 1) * n)) AS begin_at FROM hit),
top AS (SELECT * FROM occ o WHERE NOT EXISTS (FROM occ p WHERE p.k = o.k AND p.n > o.n AND p.begin_at <= o.begin_at AND p.begin_at + p.n >= o.begin_at + o.n)),
ids AS (SELECT k, string_agg('<' || id || '>', '' ORDER BY begin_at) AS ids FROM top GROUP BY k),
f AS (SELECT DISTINCT k, name FROM ids JOIN rules ON ids LIKE pattern),
l AS (SELECT k, string_agg(name, ';' ORDER BY name) AS licences FROM f WHERE NOT ({covered}) GROUP BY k)
SELECT doc_id, coalesce(ids, '') AS sentence_ids, coalesce(licences, '') AS licences, licences IS NOT NULL AS licensed
FROM doc LEFT JOIN ids USING (k) LEFT JOIN l USING (k)"""
