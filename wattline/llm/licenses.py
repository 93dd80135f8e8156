"""Licence scans by sentence rules.

1. Comment marks at line starts go, as source files carry licences in comments.  Texts are
   cut into sentences, once by line and once with line breaks inside a paragraph undone
   (licence texts are often wrapped).
2. A sentence is normalised (A-Z lower-cased, everything but letters and digits
   one blank) and looked up in the table of known licence sentences, then in a few
   patterns for those that name a year or a holder; all others are unknown.  Item
   numbers ("2.") are no sentences.  An SPDX line is one sentence for each licence of its
   expression, whatever joins them; exceptions after WITH are unknown.
3. Ordered rules, long before short, are matched against the sequence of
   identifiers.  A rule claims the sentences it matches; later rules see only
   the rest, so a full text is not also reported as its own short notice.

Everything is built-in expressions inside the row; there is no shuffle.  Texts
without any of the words in ``TRIGGERS`` cannot hold a known sentence (checked
when the module loads) and skip the steps above.

Defined results
* Null or blank text: no licences, 0 sentences, status "none".
* Null ids and repeated rows are scanned like any other.  Empty table: no rows.
* A licence found by both cuts is reported once; licences are in rule order.
* Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm.text import let

#: Identifier to the wordings of a known licence sentence.
SENTENCES: dict[str, tuple[str, ...]] = {
    "mit_title": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "mit_short": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."),
    "mit_grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ),
    "mit_notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",),
    "as_is": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    ),
    "no_liability": (
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "apache2_short": ("Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0."),
    "apache2_comply": ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',),
    "apache2_copy": (
        "You may obtain a copy of the License at",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    ),
    "apache2_url": ("http://www.apache.org/licenses/LICENSE-2.0", "https://www.apache.org/licenses/LICENSE-2.0"),
    "apache2_as_is": (
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    "apache2_see": ("See the License for the specific language governing permissions and limitations under the License.",),
    "gpl3_short": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."),
    "gpl2_short": ("This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."),
    "gpl3_redistribute": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "gpl2_redistribute": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "lgpl21_redistribute": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "lgpl3_redistribute": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "agpl3_redistribute": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "gpl_no_warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "gpl_see": (
        "See the GNU General Public License for more details.",
        "See the GNU Lesser General Public License for more details.",
        "See the GNU Affero General Public License for more details.",
    ),
    "mpl2_subject": ("This Source Code Form is subject to the terms of the Mozilla Public License, v.",),
    "mpl2_copy": (
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "epl2_available": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    "isc_grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "isc_as_is": (
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    ),
    "isc_no_liability": (
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "zlib_as_is": ("This software is provided 'as-is', without any express or implied warranty.",),
    "zlib_no_liability": ("In no event will the authors be held liable for any damages arising from the use of this software.",),
    "zlib_grant": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1.",
    ),
    "unlicense_free": ("This is free and unencumbered software released into the public domain.",),
    "cc_by_nc4": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."),
    "cc_by4": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."),
    "cc_by_sa4": ("Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."),
    "cc0": ("Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "bsd_redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1.",
    ),
    "bsd_source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",),
    "bsd_binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "all_rights": ("All rights reserved.",),
}
#: Identifier to a pattern of normalised sentences that name a year or a holder.
PATTERNS: dict[str, str] = {
    "copyright": "^copyright c |^copyright .*(19|20)[0-9]{2}|^c (19|20)[0-9]{2} ",
    "bsd_endorse": "^neither the names? of .* may be used to endorse or promote products derived from this software without specific prior written permission$",
    "bsd_as_is": "^this software is provided by .* as is and any express or implied warranties .* are disclaimed$",
    "bsd_no_liability": "^in no event shall .* be liable for any direct .* even if advised of the possibility of such damage$",
}
#: Licences by the SPDX line that names them.
SPDX = ("MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "BSL-1.0")
#: A licence text's own title, as a paragraph of its file.
TITLES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Apache License Version 2.0, January 2004", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Apache License Version 2.0, January 2004 https://www.apache.org/licenses/"),
    "GPL-2.0": ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991",),
    "GPL-3.0": ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "LGPL-2.1": ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",),
    "LGPL-3.0": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "AGPL-3.0": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",),
    "MPL-2.0": ("Mozilla Public License Version 2.0", "Mozilla Public License, version 2.0"),
    "EPL-2.0": ("Eclipse Public License - v 2.0",),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003",),
}
#: The licences of Creative Commons, version 4.0, by what they ask.
CREATIVE_COMMONS = {
    "CC-BY-4.0": "Attribution", "CC-BY-SA-4.0": "Attribution-ShareAlike", "CC-BY-NC-4.0": "Attribution-NonCommercial", "CC-BY-ND-4.0": "Attribution-NoDerivatives",
    "CC-BY-NC-SA-4.0": "Attribution-NonCommercial-ShareAlike", "CC-BY-NC-ND-4.0": "Attribution-NonCommercial-NoDerivatives",
}
SENTENCES |= {f"title {n}": w for n, w in TITLES.items()}
SENTENCES |= {
    f"title {n}": (
        f"{w} 4.0 International", f"Creative Commons {w} 4.0 International", f"Creative Commons {w} 4.0 International License", f"Creative Commons {w} 4.0 International Public License",
        f"This work is licensed under a Creative Commons {w} 4.0 International License.", f"This work is licensed under the Creative Commons {w} 4.0 International License.",
        f"Licensed under a Creative Commons {w} 4.0 International License.", f"Licensed under the Creative Commons {w} 4.0 International License.",
    )
    for n, w in CREATIVE_COMMONS.items()
}
SENTENCES |= {
    "boost_short": ("Distributed under the Boost Software License, Version 1.0.", "Licensed under the Boost Software License, Version 1.0."),
    "boost_copy": tuple(f"(See accompanying file LICENSE_1_0.txt or copy at {h}://www.boost.org/LICENSE_1_0.txt)" for h in ("http", "https")),
    "boost_grant": (
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    ),
}
SENTENCES |= {f"spdx {x}": (f"SPDX-License-Identifier: {x}",) for x in SPDX}

_BSD, _BSD_END = ("bsd_redistribution", "bsd_source", "bsd_binary"), ("bsd_as_is", "bsd_no_liability")
_APACHE = ("apache2_comply", "apache2_copy"), ("apache2_as_is", "apache2_see")
#: Licence and the sentence identifiers it needs, side by side ("_" is a run of unknown
#: ones); a rule takes what it matches, so the longer of two comes first.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit_title", "copyright", "mit_grant", "mit_notice", "as_is", "no_liability")),
    ("MIT", ("mit_title", "copyright", "mit_grant", "mit_notice", "as_is")),
    ("MIT", ("mit_grant", "mit_notice", "as_is", "no_liability")),
    ("MIT", ("mit_grant", "mit_notice", "as_is")),
    ("Unlicense", ("unlicense_free", "_", "as_is", "no_liability")),
    ("Unlicense", ("unlicense_free",)),
    ("ISC", ("isc_grant", "isc_as_is", "isc_no_liability")),
    ("ISC", ("isc_grant",)),
    ("BSD-3-Clause", (*_BSD, "bsd_endorse", *_BSD_END)),
    ("BSD-3-Clause", (*_BSD, "bsd_endorse")),
    ("BSD-2-Clause", (*_BSD, *_BSD_END)),
    ("BSD-2-Clause", _BSD),
    ("Zlib", ("zlib_as_is", "zlib_no_liability", "zlib_grant")),
    ("Apache-2.0", (*_APACHE[0], "apache2_url", *_APACHE[1])),
    ("Apache-2.0", (*_APACHE[0], *_APACHE[1])),
    ("Apache-2.0", (*_APACHE[0], "apache2_url")),
    ("Apache-2.0", _APACHE[0]),
    ("Apache-2.0", ("apache2_comply",)),
    *(
        (name, (first, *rest))
        for name, first in (("AGPL-3.0-or-later", "agpl3_redistribute"), ("LGPL-3.0-or-later", "lgpl3_redistribute"), ("LGPL-2.1-or-later", "lgpl21_redistribute"), ("GPL-3.0-or-later", "gpl3_redistribute"), ("GPL-2.0-or-later", "gpl2_redistribute"))
        for rest in (("gpl_no_warranty", "gpl_see"), ("gpl_no_warranty",), ())
    ),
    ("MPL-2.0", ("mpl2_subject", "_", "mpl2_copy")),
    ("MPL-2.0", ("mpl2_subject", "mpl2_copy")),
    ("MPL-2.0", ("mpl2_subject",)),
    ("EPL-2.0", ("epl2_available",)),
    ("BSL-1.0", ("boost_short", "boost_copy")),
    ("BSL-1.0", ("boost_short",)),
    ("BSL-1.0", ("boost_copy",)),
    ("BSL-1.0", ("boost_grant",)),
    *((n, (f"title {n}",)) for n in (*TITLES, *CREATIVE_COMMONS)),
    ("MIT", ("mit_short",)),
    ("Apache-2.0", ("apache2_short",)),
    ("GPL-3.0-only", ("gpl3_short",)),
    ("GPL-2.0-only", ("gpl2_short",)),
    ("CC-BY-NC-4.0", ("cc_by_nc4",)),
    ("CC-BY-SA-4.0", ("cc_by_sa4",)),
    ("CC-BY-4.0", ("cc_by4",)),
    ("CC0-1.0", ("cc0",)),
    ("BSD-like", ("bsd_redistribution",)),
    ("MIT", ("mit_title",)),
    *((x, (f"spdx {x}",)) for x in SPDX),
    ("all-rights-reserved", ("all_rights",)),
)
#: Every known sentence has one of these.
TRIGGERS = ("licens", "permission", "copyright", "warrant", "redistribut", "rights reserved", "liable", "public domain", "mozilla", "4 0 international")
#: Item numbers stand alone after the cut into sentences.
ITEM = "^([0-9]{1,2}|[a-z])$"

BREAK = r"(?<=[.!?])[\x20\x09-\x0D]+"
LINE = r"[\n\r]+"
#: Comment marks with which a line begins, and the first line of a script.
COMMENT = r"^[\x20\x09]*(#![^\n]*|/\*+|\*+/|\*+|//+|#+|;+|--+|%+|<!--)[\x20\x09]*"
SPDX_LINE, SPDX_JOINTS = "spdx license identifier ", " (or|and|with) "
PARAGRAPH = r"\n[\x20\x09-\x0D]*\n"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _normal(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.translate(str.maketrans(UPPER, LOWER))).strip()


#: Normalised wording to identifier.
KNOWN: dict[str, str] = {}
for _name, _wordings in SENTENCES.items():
    for _wording in _wordings:
        if len(re.split(BREAK, _wording)) > 1:
            raise ValueError(f"more than one sentence: {_wording!r}")
        KNOWN[_normal(_wording)] = _name
for _key in KNOWN:
    if not any(t in _key for t in TRIGGERS):
        raise ValueError(f"no trigger word in the known sentence {_key!r}")


def normal(sentence: Column) -> Column:
    lower = F.translate(sentence, UPPER, LOWER)
    return F.trim(F.regexp_replace(lower, "[^a-z0-9]+", " "))


def _spdx(sentence: Column) -> Column:
    """A normalised sentence as array: an SPDX line as one line for each of its licences."""
    # The "or" of "or later" joins nothing.
    parts = F.split(F.replace(F.substring(sentence, len(SPDX_LINE) + 1, 1 << 30), F.lit(" or later"), F.lit(" orlater")), SPDX_JOINTS)
    each = F.transform(parts, lambda p: F.concat(F.lit(SPDX_LINE), F.replace(p, F.lit(" orlater"), F.lit(" or later"))))
    return F.when(F.startswith(sentence, F.lit(SPDX_LINE)), each).otherwise(F.array(sentence))


def _identify(sentences: Column) -> Column:
    """",a,,_,,b,": identifiers in order, each between commas of its own, so that equal
    sequences side by side share none; runs of unknown sentences are one "_"."""
    table = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])

    def one(sentence):
        like = [F.when(sentence.rlike(pattern), F.lit(name)) for name, pattern in PATTERNS.items()]
        return F.coalesce(F.try_element_at(table, sentence), *like, F.lit("_"))

    said = F.filter(F.transform(sentences, normal), lambda s: (s != "") & ~s.rlike(ITEM))
    joined = F.concat(F.lit(","), F.array_join(F.transform(F.flatten(F.transform(said, _spdx)), one), ",,"), F.lit(","))
    return F.regexp_replace(joined, "(,_,)+", ",_,")


def _claim(sequence: Column) -> Column:
    """struct(rest, found): the rules in order, each taking what it matches."""
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit("," + ",,".join(ids) + ",").alias("ids")) for n, ids in RULES])

    def step(acc, rule):
        rest = F.replace(acc["rest"], rule["ids"], F.lit(",#,"))
        found = F.when(rest != acc["rest"], F.array_append(acc["found"], rule["name"])).otherwise(acc["found"])
        return F.struct(rest.alias("rest"), found.alias("found"))

    zero = F.struct(sequence.alias("rest"), F.array().cast("array<string>").alias("found"))
    # Most texts hold no known sentence.
    return F.when(sequence.rlike("[a-z]"), F.aggregate(rules, zero, step)).otherwise(zero)


def _known(sequence: Column) -> Column:
    return F.size(F.filter(F.split(sequence, ","), lambda s: ~s.isin("", "_", "#")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, licenses array<string>, n_known, n_unclaimed, status.

    n_known counts the known sentences (the larger of the two cuts) and n_unclaimed
    those that no rule took; status is none, licensed or unclaimed.
    """
    raw = F.coalesce(F.col(text_col), F.lit(""))
    may = F.translate(raw, UPPER, LOWER).rlike("|".join(TRIGGERS).replace(" ", r"[^a-z0-9]+"))
    text = F.regexp_replace(raw, f"(?md){COMMENT}", "")
    empty = F.array().cast("array<string>")
    by_line = F.split(text, f"{LINE}|{BREAK}")
    by_paragraph = F.flatten(F.transform(F.split(text, PARAGRAPH), lambda p: F.split(F.regexp_replace(p, LINE, " "), BREAK)))
    pieces = docs.select(F.col(id_col).alias("doc_id"), F.when(may, by_line).otherwise(empty).alias("lines"), F.when(may, by_paragraph).otherwise(empty).alias("joined"))
    cuts = pieces.select("doc_id", *[let(_identify(F.col(c)), lambda s: F.struct(_claim(s).alias("claim"), _known(s).alias("n"))).alias(c) for c in ("lines", "joined")])
    names = list(dict.fromkeys(n for n, _ in RULES))
    both = F.array_union("lines.claim.found", "joined.claim.found")
    ordered = F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.array_contains(both, n))
    unclaimed = F.least(_known(F.col("lines.claim.rest")), _known(F.col("joined.claim.rest")))
    found = cuts.select("doc_id", ordered.alias("licenses"), F.greatest("lines.n", "joined.n").cast("long").alias("n_known"), unclaimed.cast("long").alias("n_unclaimed"))
    status = F.when(F.size("licenses") > 0, "licensed").when(F.col("n_known") > 0, "unclaimed").otherwise("none")
    return found.withColumn("status", status)
