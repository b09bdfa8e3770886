"""Licence scans by sentence rules.

A text is cut into sentences, at marks that end one and at blank lines, comment marks aside; an SPDX tag at the end of its
line is a sentence for each of its one or two licences. Each is normalised (A-Z
lower-cased, all but letters and digits to single spaces, so line breaks and comment marks don't matter) and the known
licence sentences in it are named: usually it is one as a whole, but a title or copyright line without a full stop may
stand before it, or an address after it. The identifiers in text order are then matched against ordered rules: a rule is
a run of identifiers, earlier rules go first and use up what they match. A licence of ``BARRED`` isn't named where what follows its run says that
the text goes on: an unknown clause, then one of a longer licence. Sentences that speak of a licence but hold no
known one are counted.

Everything is one projection of built-in functions: no shuffle, no Python. Texts and sentences without any cue word,
which every known sentence has, are passed over.

Defined results: a null or empty text has no sentences and no licences. Repeated rows are scanned one by one. Only
doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Known licence sentences, normalised, by identifier (fixed values).
SENTENCES = {
    "ApacheTitle": "apache license version 2 0 january 2004",
    "ApacheLic": "licensed under the apache license version 2 0",
    "ApacheLicWkVer": "licensed under the apache license version 2 0 the license",
    "ApacheNotUse": "you may not use this file except in compliance with the license",
    "ApacheObtain": "you may obtain a copy of the license at",
    "ApacheUrl": "http www apache org licenses license 2 0",
    "ApacheUnless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "ApacheSee": "see the license for the specific language governing permissions and limitations under the license",
    "MITrel": "released under the mit license",
    "MITlic": "licensed under the mit license",
    "MITthis": "this software is released under the mit license",
    "MITperm": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "MITnotice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "MITasis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "ISCperm": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "GPL2title": "gnu general public license version 2 june 1991",
    "GPL3title": "gnu general public license version 3 29 june 2007",
    "GPL3work": "this work is licensed under the gnu general public license version 3",
    "GPL3lic": "licensed under the gnu general public license version 3",
    "GPLfree": "this program is free software",
    "GPLterms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "GPLv2later": "either version 2 of the license or at your option any later version",
    "GPLv3later": "either version 3 of the license or at your option any later version",
    "GPLnoWarranty": "this program is distributed in the hope that it will be useful but without any warranty",
    "GPLreceived": "you should have received a copy of the gnu general public license along with this program",
    "AGPLterms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "LGPL21title": "gnu lesser general public license version 2 1 february 1999",
    "LGPL3title": "gnu lesser general public license version 3 29 june 2007",
    "LGPLfree": "this library is free software",
    "LGPLterms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "LGPLv21later": "either version 2 1 of the license or at your option any later version",
    "MPLtitle": "mozilla public license version 2 0",
    "MPLform": "this source code form is subject to the terms of the mozilla public license v",
    "MPLobtain": "if a copy of the mpl was not distributed with this file you can obtain one at",
    "CCBYNC4": "licensed under cc by nc 4 0",
    "CCBY4": "licensed under cc by 4 0",
    "CCBYSA4": "licensed under cc by sa 4 0",
    "BSDredist": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "BSDsource": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "BSDbinary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "BSDendorse": "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "Unlicense": "this is free and unencumbered software released into the public domain",
    "AllRights": "all rights reserved",
    "BSDadvert": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "BSDadvertUS": "all advertising materials mentioning features or use of this software must display the following acknowledgment",
    "BSDasIs": "this software is provided by the copyright holders and contributors as is",
    "BSDasIsOne": "this software is provided by the copyright holder and contributors as is",
    "ApacheOrMIT": "licensed under the apache license version 2 0 or the mit license",
    "MITorApache": "licensed under the mit license or the apache license version 2 0",
    "ZlibPerm": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "BoostTitle": "boost software license version 1 0",
    "BoostPerm": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
    "EPL2made": "made available under the terms of the eclipse public license 2 0",
    "EPL2madeV": "made available under the terms of the eclipse public license v 2 0",
    "EPL2title": "eclipse public license v 2 0",
    "CC0title": "cc0 1 0 universal",
    "AGPL3title": "gnu affero general public license version 3 19 november 2007",
    "GPL2only": "under the terms of the gnu general public license version 2 as published by the free software foundation",
    "GPL3only": "under the terms of the gnu general public license version 3 as published by the free software foundation",
}
#: Licences that an SPDX tag may name (fixed values); those with a version alone are the older names of "only".
SPDX = [
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "CC-BY-4.0",
    "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only",
    "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
]
SENTENCES |= {f"SPDX:{x}": f"spdx license identifier {x.lower().replace('-', ' ').replace('.', ' ')}" for x in SPDX}

#: Ordered rules: licence, and the run of identifiers that states it (fixed values).
RULES = [
    ("Apache-2.0", ["ApacheLicWkVer", "ApacheNotUse", "ApacheObtain", "ApacheUrl", "ApacheUnless", "ApacheSee"]),
    ("MIT", ["MITperm", "MITnotice", "MITasis"]),
    ("BSD-4-Clause", ["BSDredist", "BSDsource", "BSDbinary", "BSDadvert"]),
    ("BSD-4-Clause", ["BSDredist", "BSDsource", "BSDbinary", "BSDadvertUS"]),
    ("BSD-3-Clause", ["BSDredist", "BSDsource", "BSDbinary", "BSDendorse"]),
    ("BSD-2-Clause", ["BSDredist", "BSDsource", "BSDbinary"]),
    ("ISC", ["ISCperm"]),
    ("GPL-3.0-or-later", ["GPLfree", "GPLterms", "GPLv3later"]),
    ("GPL-2.0-or-later", ["GPLfree", "GPLterms", "GPLv2later"]),
    ("AGPL-3.0-or-later", ["GPLfree", "AGPLterms", "GPLv3later"]),
    ("LGPL-2.1-or-later", ["LGPLfree", "LGPLterms", "LGPLv21later"]),
    ("LGPL-3.0-or-later", ["LGPLfree", "LGPLterms", "GPLv3later"]),
    ("LGPL-3.0-or-later", ["GPLfree", "LGPLterms", "GPLv3later"]),
    ("MPL-2.0", ["MPLform", "MPLobtain"]),
    ("MIT", ["MITperm"]),
    ("Apache-2.0", ["ApacheTitle"]),
    ("Apache-2.0", ["ApacheLicWkVer"]),
    ("Apache-2.0", ["ApacheLic"]),
    ("GPL-2.0", ["GPL2title"]),
    ("GPL-3.0", ["GPL3title"]),
    ("LGPL-2.1", ["LGPL21title"]),
    ("LGPL-3.0", ["LGPL3title"]),
    ("MPL-2.0", ["MPLtitle"]),
    ("MIT", ["MITthis"]),
    ("MIT", ["MITrel"]),
    ("MIT", ["MITlic"]),
    ("GPL-3.0-only", ["GPL3work"]),
    ("GPL-3.0-only", ["GPL3lic"]),
    ("CC-BY-NC-4.0", ["CCBYNC4"]),
    ("CC-BY-SA-4.0", ["CCBYSA4"]),
    ("CC-BY-4.0", ["CCBY4"]),
    ("Unlicense", ["Unlicense"]),
    ("Apache-2.0 OR MIT", ["ApacheOrMIT"]),
    ("Apache-2.0 OR MIT", ["MITorApache"]),
    ("Zlib", ["ZlibPerm"]),
    ("BSL-1.0", ["BoostTitle"]),
    ("BSL-1.0", ["BoostPerm"]),
    ("EPL-2.0", ["EPL2made"]),
    ("EPL-2.0", ["EPL2madeV"]),
    ("EPL-2.0", ["EPL2title"]),
    ("CC0-1.0", ["CC0title"]),
    ("AGPL-3.0", ["AGPL3title"]),
    ("GPL-2.0-only", ["GPL2only"]),
    ("GPL-3.0-only", ["GPL3only"]),
    *((x, [f"SPDX:{x}"]) for x in SPDX),
]

#: Licences that longer ones begin with, and what after their run bars them, ``?`` being an unknown sentence (fixed values).
BARRED = {"BSD-2-Clause": [["?", "BSDendorse"], ["?", "?", "BSDendorse"]]}


def steps(rules: list[tuple[str, list[str]]] = RULES) -> list[tuple[str, str]]:
    """(licence, run as one text) in the order in which they are tried; runs that are barred name no licence, but are used up."""
    out = []
    for name, run in rules:
        out += [("", "".join(f"<{i}>" for i in [*run, *more])) for more in BARRED.get(name, [])]
        out.append((name, "".join(f"<{i}>" for i in run)))
    return out


#: Words that a licence sentence has one of (fixed values).
CUES = ["licen", "permission", "copyright", "redistribut", "free software", "without warranty", "any warranty", "rights reserved", "of the mpl", "unencumbered", "advertising materials", "cc0"]
#: Words of which a text with any cue has one, however its lines are broken (fixed values).
CUE_WORDS = ["licen", "permission", "copyright", "redistribut", "software", "warranty", "reserved", "mpl", "cc0"]
#: SPDX tags of two licences and of one, up to the end of the line or comment; what is put in their place.
TAGS = [
    (r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.-]+) (?:OR|AND) ([A-Za-z0-9.-]+)[ \t]*(\r?\n|$|\*/|-->)", "\u0001SPDX License Identifier {1}\u0001SPDX License Identifier {2}\u0001{3}"),
    (r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.-]+)[ \t]*(\r?\n|$|\*/|-->)", "\u0001SPDX License Identifier {1}\u0001{2}"),
]
#: A blank line, comment marks aside, and the end of a sentence.
BLANK, END = r"\n[ \t\r#*/;%>|!-]*\n", r"([.!?;:])[ \t\r\n]+"


def doubled(sentence: str) -> str:
    """Spaces doubled: two known sentences side by side then both have a space of their own around them."""
    return sentence.replace(" ", "  ")


def any_known(sentences: dict[str, str] = SENTENCES) -> str:
    """Pattern of a known sentence, the longest first, in a doubled one."""
    return " (" + "|".join(doubled(x) for x in sorted(sentences.values(), key=lambda x: (-len(x), x))) + ") "


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(sentence), "[^a-z0-9]+", " "))


def _cued(lowered: Column, cues: list[str] = CUES) -> Column:
    out = F.lit(False)
    for cue in cues:
        out = out | lowered.contains(cue)
    return out


def identifiers(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """Identifiers of a text's licence sentences in order, ``?`` for those that aren't known."""
    names = F.create_map(*(F.lit(x) for k, v in sentences.items() for x in (doubled(v), k)))
    for pattern, put in TAGS:
        text = F.regexp_replace(text, pattern, put.format("", "$1", "$2", "$3"))
    cut = F.regexp_replace(F.regexp_replace(text, BLANK, "\u0001"), END, "$1\u0001")
    cued = F.filter(F.transform(F.split(cut, "\u0001"), normalised), lambda s: _cued(s))
    wide = F.transform(cued, lambda s: F.concat(F.lit(" "), F.replace(s, F.lit(" "), F.lit("  ")), F.lit(" ")))
    found = F.transform(wide, lambda s: F.regexp_extract_all(s, F.lit(any_known(sentences)), F.lit(1)))
    ids = F.transform(found, lambda f: F.when(F.size(f) > 0, F.transform(f, lambda x: F.try_element_at(names, x))).otherwise(F.array(F.lit("?"))))
    return F.when(_cued(ascii_lower(text), CUE_WORDS), F.flatten(ids)).otherwise(F.array().cast("array<string>"))


def licences(ids: Column, rules: list[tuple[str, list[str]]] = RULES) -> Column:
    """Distinct licences that the rules find in a sequence of identifiers, in rule order."""
    table = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(run).alias("run")) for name, run in steps(rules)))
    start = F.struct(F.concat(F.lit("<"), F.array_join(ids, "><"), F.lit(">")).alias("seq"), F.array().cast("array<string>").alias("found"))
    end = F.aggregate(
        table,
        start,
        lambda acc, rule: F.struct(
            F.replace(acc["seq"], rule["run"], F.lit("|")).alias("seq"),
            F.when((rule["name"] != "") & acc["seq"].contains(rule["run"]), F.array_append(acc["found"], rule["name"])).otherwise(acc["found"]).alias("found"),
        ),
    )
    return F.when(F.size(ids) > 0, F.array_distinct(end["found"])).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, sentences, licences, n_unknown) of every document."""
    rows = docs.select("doc_id", identifiers(F.coalesce("text", F.lit(""))).alias("ids"))
    known = F.filter("ids", lambda i: i != "?")
    return rows.select(
        "doc_id",
        known.alias("sentences"),
        licences(F.col("ids")).alias("licences"),
        (F.size("ids") - F.size(known)).cast("bigint").alias("n_unknown"),
    )
