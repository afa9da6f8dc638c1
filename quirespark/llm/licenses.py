"""Licence recognition by sentence rules.

Texts are normalised: line ends inside a paragraph, comment marks and all but
letters, digits and dots or hyphens inside words become one blank; a stop before
white space and an empty line become the mark of a cut. Known licence sentences have
an identifier and may stand anywhere between two cuts; titles must fill a whole
piece or stand before a copyright line. Some carry the version in the text. A
document is then a sequence of identifiers, held as one string, and ordered rules
(regular expressions over that string) turn stretches of it into licences: the first
rule that matches claims its stretch, so a full text is not also reported as its parts.

What a sentence itself says goes into its identifier: the GNU licences' notices carry family,
version and whether later ones may be taken, and SPDX lines their names, as ``<name>``. A
version that is not there is not guessed: the GPL without one means any (GPL-1.0-or-later),
and a mere reference to it grants nothing. "X or Y" after a verb of licensing is two
sentences, and a verb that is denied is none.

The dimension of known sentences is fixed and small, a map inside the expression:
no join, no shuffle, no Python.

``SENTENCES`` are those of the query's SQL, which states its own rules for whole
sentences on lines of their own. ``PHRASES`` and ``CLAIMS`` hold them and the forms of
real licences; on texts with only the former, rows are the same.

Rows: a null or empty text, and a text without known sentences, has empty arrays.
Repeated rows are scanned each.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.llm.common import text_of

#: An identifier, and the normalised sentence that it stands for.
SENTENCES = (
    ("a", "licensed under the apache license version 2.0"),
    ("b", "you may not use this file except in compliance with the license"),
    ("c", "you may obtain a copy of the license at http www.apache.org licenses license-2.0"),
    ("g", "this work is licensed under the gnu general public license version 3"),
    ("h", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("i", "see the gnu general public license for more details"),
    ("m", "released under the mit license"),
    ("n", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("o", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("p", "the software is provided as is without warranty of any kind"),
    ("q", "licensed under cc by-nc 4.0"),
    ("r", "licensed under cc by 4.0"),
    ("s", "licensed under cc by-sa 4.0"),
    ("t", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("u", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("w", "all rights reserved"),
)

#: Families of the GNU licences, and SPDX identifiers, as they are written.
FAMILIES = {"gpl": "general", "lgpl": "(?:lesser|library) general", "agpl": "affero general"}
SPDX = (
    "0BSD", "AFL-3.0", "AGPL-1.0-only", "AGPL-1.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "APSL-2.0", "Artistic-1.0", "Artistic-2.0", "BlueOak-1.0.0", "BSD-1-Clause", "BSD-2-Clause", "BSD-2-Clause-Patent",
    "BSD-3-Clause", "BSD-3-Clause-Clear", "BSD-4-Clause", "BSL-1.0", "BUSL-1.1", "CC-BY-2.0", "CC-BY-2.5", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-NC-3.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-3.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-2.0",
    "CC-BY-SA-2.5", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "CDDL-1.1", "CECILL-2.1", "CPL-1.0", "ECL-2.0", "EFL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.1", "EUPL-1.2", "GFDL-1.2-only", "GFDL-1.2-or-later", "GFDL-1.3-only", "GFDL-1.3-or-later",
    "GPL-1.0-only", "GPL-1.0-or-later", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-1.1",
    "MPL-2.0", "MS-PL", "MS-RL", "MulanPSL-2.0", "NCSA", "ODbL-1.0", "OFL-1.1", "OpenSSL", "OSL-3.0", "PostgreSQL", "Python-2.0", "Ruby", "SSPL-1.0", "Unicode-DFS-2016", "Unlicense", "UPL-1.0", "Vim", "W3C", "WTFPL", "X11", "Zlib", "ZPL-2.1",
)
#: Deprecated names that leave out what the licence's version alone allows.
OLDER = {x.removesuffix("-only").lower(): x for x in SPDX if x.endswith("-only")}

VERSION = "([0-9](?:[.][0-9])?)(?:[.]0)?"
LATER = r"( or (?:[|] )?(?:at your option )?(?:[|] )?any later version| or (?:any )?later(?: version)?| only)?"
VERBS = "licensed|released|distributed|available|covered|governed"


def notices() -> list[tuple[str, str]]:
    """Rewrites of the GNU licences' notices to one word, ``gnu_family_version_later``."""
    out = []
    for family, name in FAMILIES.items():
        whole = f"(?:the )?gnu {name} public license(?: {family})?"
        short = f"(?:{whole}|(?:the )?gnu {family}|(?:the )?{family})"
        out.append((rf"(?<= )(?:(?:this program|this library|it) is free software )?(?:you (?:can|may) redistribute (?:it )?and or modify it )?under (?:the )?terms (?:and conditions )?of (?:the )?version {VERSION}{LATER} of {whole}(?= )", f"gnu_{family}_$1_$2_"))
        out.append((rf"(?<= )(?:(?:this program|this library|it) is free software )?(?:you (?:can|may) redistribute (?:it )?and or modify it )?under (?:the )?terms (?:and conditions )?of {short}(?: as published by the free software foundation(?: inc[.]?)?)?(?: either)? (?:version |v)?{VERSION}(?: of the license)?{LATER}(?: of the license)?(?= )", f"gnu_{family}_$1_$2_"))
        out.append((rf"(?<= )((?:this work is )?)(?:{VERBS}) under {short} (?:version |v)?{VERSION}{LATER}(?= )", f"gnu_{family}_$2_$3_$1"))
    return out


#: Names of licences that may stand in a list after a verb of licensing.
NAMES: list[str] = []


def forms() -> dict[str, str]:
    """Short forms: a verb and a name, SPDX lines and Creative Commons' names and links."""
    names = {
        "a": ("apache license version 2.0", "apache license 2.0", "apache 2.0 license", "apache-2.0 license", "apache license v2.0", "apache 2.0"),
        "m": ("mit license", "mit x11 license", "mit open source license"),
        "H": ("bsd 3-clause license", "3-clause bsd license", "bsd-3-clause license", "new bsd license", "modified bsd license"),
        "I": ("mozilla public license version 2.0", "mozilla public license 2.0", "mpl 2.0", "mpl-2.0"),
        "U": ("eclipse public license version 2.0", "eclipse public license v2.0", "eclipse public license 2.0", "eclipse public license v 2.0", "epl 2.0"),
        "X": ("eclipse public license version 1.0", "eclipse public license v1.0", "eclipse public license 1.0", "eclipse public license v 1.0", "epl 1.0"),
        "W": ("artistic license 2.0", "artistic license version 2.0"), "Y": ("sil open font license version 1.1", "open font license version 1.1", "sil open font license 1.1"),
        "Z": ("cc0 1.0 universal", "creative commons zero v1.0 universal", "creative commons cc0 1.0 universal"), "E": ("isc license",), "F": ("zlib license",), "G": ("boost software license version 1.0", "boost software license 1.0"), "T": ("unlicense",),
        "J": ("bsd 2-clause license", "2-clause bsd license", "bsd-2-clause license", "simplified bsd license"),
    }
    verbs = ("licensed under", "released under", "distributed under", "available under", "under the terms of")
    NAMES.extend(sorted({n for own in names.values() for n in own}, key=lambda n: (-len(n), n)))
    found = {f"{verb} {the}{name}": i for i, own in names.items() for name in own for verb in verbs for the in ("the ", "")}
    for i, kind, name in (("R", "by", "attribution"), ("S", "by-sa", "attribution-sharealike"), ("Q", "by-nc", "attribution-noncommercial")):
        for who in ("creative commons ", "cc "):
            found |= {f"{who}{name} {v}": i for v in ("4.0 international", "4.0")}
        found |= {f"{www}creativecommons.org licenses {kind} 4.0": i for www in ("", "www.")}
        found |= {f"licensed under cc-{kind}-4.0": i, f"licensed under creative commons {kind} 4.0": i, f"licensed under cc {kind} 4.0 international": i}
    return found


#: Identifier of a phrase, also of the SQL's sentences.
PHRASES = {
    **forms(), **{s: i for i, s in SENTENCES},
    **{f"you may obtain a copy of the license at {bar}{http} www.apache.org licenses license-2.0{txt}": "c" for bar in ("", "| ") for http in ("http", "https") for txt in ("", ".txt", ".html")},
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "d",
    **{f"apache license {bar}version 2.0 {bar2}january 2004": "e" for bar in ("", "| ") for bar2 in ("", "| ")},
    "terms and conditions for use reproduction and distribution": "f",
    "each contributor hereby grants to you a perpetual worldwide non-exclusive no-charge royalty-free irrevocable copyright license": "j",
    "each contributor hereby grants to you a perpetual worldwide non-exclusive no-charge royalty-free irrevocable except as stated in this section patent license": "k",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "o",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "x",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "y",
    "as is and any express or implied warranties including but not limited to": "z",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "E",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted": "E",
    "this software is provided as-is without any express or implied warranty": "F", "this software is provided as is without any express or implied warranty": "F",
    "the origin of this software must not be misrepresented": "F",
    **{f"boost software license {bar}version 1.0": "G" for bar in ("", "| ")},
    "this source code form is subject to the terms of the mozilla public license v": "I",
    **{f"mozilla public license {v}": "I" for v in ("version 2.0", "2.0")},
    "this is free and unencumbered software released into the public domain": "T",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "V",
    **{f"{nor} may be used to endorse or promote products": "u" for nor in ("nor the names of its contributors", "nor the names of their contributors", "nor the names of contributors", "nor the names of other contributors", "names of its contributors", "names of contributors")},
    **{f"the name of the {who} may not be used to endorse or promote products": "u" for who in ("author", "authors", "copyright holder", "company")},
    **{f"gnu general public license {bar}version {v}": i for bar in ("", "| ") for v, i in (("3 29 june 2007", "O"), ("2 june 1991", "P"), ("3 | 29 june 2007", "O"), ("2 | june 1991", "P"))},
}

#: Titles: a whole piece, or before a copyright line.
TITLES = {
    **dict.fromkeys(("mit license", "the mit license", "mit license mit", "the mit license mit"), "v"),
    **dict.fromkeys(("bsd 3-clause license", "the 3-clause bsd license", "3-clause bsd license", "the bsd 3-clause license", "bsd 3-clause new or revised license"), "H"),
    **dict.fromkeys(("bsd 2-clause license", "the 2-clause bsd license", "2-clause bsd license", "the bsd 2-clause license", "bsd 2-clause simplified license"), "J"),
}

#: Not within a carried name.
OUTSIDE = "(?![^<]*>)"

#: Licence (none: the name that the identifier carries) and its pattern over the identifiers, in order: full texts with a title, a
#: copyright line and their appendix first; then notices; then short forms.
CLAIMS = (
    ("GPL-3.0-only", f"{OUTSIDE}O(?:<GPL-3[.]0-or-later>i?)?"),
    ("GPL-2.0-only", f"{OUTSIDE}P(?:<GPL-2[.]0-or-later>i?)?"),
    (None, f"(?:{OUTSIDE}w)*<[^>]+>i?"),
    ("MIT", "[mv]*w*[mv]*nw*ow*p"),
    ("MIT", "v+|m|no?|op"),
    ("Apache-2.0", "ef?j*k*(?:w*abcd?)?"),
    ("Apache-2.0", "w*abcd?|w*bcd?|fj+k*|a|e+|c"),
    ("BSD-4-Clause", "w*t+x?y?Vy?u*z?"),
    ("BSD-3-Clause", "H*w*H*t+x?y?u+z?"),
    ("BSD-3-Clause", "H+"),
    ("BSD-2-Clause", "J+w*tx?y?z?|w*J*tx?y?z?|J+"),
    ("GPL-3.0-only", "gi?"),
    ("GPL-1.0-or-later", "hi?"),
    ("CC-BY-NC-4.0", "q|Q+"),
    ("CC-BY-SA-4.0", "s|S+"),
    ("CC-BY-4.0", "r|R+"),
    ("ISC", "w*E+"), ("Zlib", "w*F+"), ("BSL-1.0", "G+"), ("MPL-2.0", "I+"), ("Unlicense", "T+"), ("CC0-1.0", "Z+"), ("OFL-1.1", "Y+"), ("EPL-2.0", "U+"), ("EPL-1.0", "X+"), ("Artistic-2.0", "W+"),
    ("Proprietary", "w"),
)

LEADS = r"(?m)^[\x{9}\x{20}]*(?:rem|dnl)[\x{9}\x{20}]"
CUTS = r"""[.!?]+["'\)\]]*(?=[\x{9}-\x{D}\x{20}]|$)|\x{A}[^a-z0-9\x{A}]*\x{A}"""
LOOSE = r"[^a-z0-9.|-]+|(?<![a-z0-9])[.-]+|-+(?![a-z0-9])"
#: An SPDX line's further licences get its mark, too; what is excepted goes.
EXCEPTED = r"(spdx-license-identifier [^|]*?[a-z0-9.-]+) with [a-z0-9.-]+exception[a-z0-9.-]*"
MORE = r"((?:spdx-license-identifier |\G(?!^))[a-z0-9.-]+ )(?:or|and) "
#: What is denied, and lists after a verb.
DENIED = rf"(?<= )(not|never|no longer|isn t|aren t|wasn t|cannot be|nor) ((?:being |been |be )?)({VERBS}) under(?= )"
EITHER = rf"(?<= )({VERBS}) under (?:either|any|one|both) (?:of )?(?:the )?(?:following )?"
NAMED = "(?:" + "|".join(re.escape(n).replace("\\ ", " ") for n in NAMES) + r"|(?:gnu )?[al]?gpl (?:version |v)?[23](?:[.][01])?)"
LISTED = rf"(?<= )((?:{VERBS}) under (?:the )?{NAMED}(?: or later)?) (?:or|and) (?:under )?(?:the )?(?={NAMED} )"
STYLE = r"(?<= )governed by (?:a |the )?([a-z0-9]+)-style license(?= )"


def any_of(phrases) -> str:
    """The longest first, by their first words."""
    by: dict[str, list[str]] = {}
    for s in sorted(phrases, key=lambda s: (-len(s), s)):
        first, _, rest = s.partition(" ")
        by.setdefault(first, []).append(re.escape(rest).replace("\\ ", " "))
    return "(?:" + "|".join(f"{re.escape(first)} (?:{'|'.join(rest)})" for first, rest in by.items()) + ")"


CARRIED = r"(?<= )(?:gnu_[a-z]+_[0-9.]*_[a-z |]*_(?:this work is)?|spdx-license-identifier [a-z0-9.-]+|style_[a-z0-9]+)(?= )"
FOUND = f"{CARRIED}|(?<=[|] ){any_of(TITLES)}(?= (?:[|]|copyright ))|(?<= ){any_of(PHRASES)}(?= )"


def normalised(text: Column) -> Column:
    """Words with one blank between them, and ``|`` for a cut, also at both ends."""
    whole = F.regexp_replace(F.translate(F.lower(text), "|\r", " "), r"\b((?:[al]?gpl|gfdl)-[0-9.]+[0-9])[+]", "$1-or-later")
    for pattern, to in ((LEADS, " "), (CUTS, " | "), (LOOSE, " ")):
        whole = F.regexp_replace(whole, pattern, to)
    whole = F.regexp_replace(F.concat(F.lit(" | "), whole, F.lit(" | ")), r"\x{20}+", " ")
    rewrites = [(EXCEPTED, "$1"), (MORE, "$1spdx-license-identifier "), (DENIED, "$1 $2un$3 under"), (EITHER, "$1 under "), (LISTED, "$1 licensed under "), (LISTED, "$1 licensed under "), (STYLE, "style_$1"), *notices()]
    for pattern, to in rewrites:
        whole = F.regexp_replace(whole, pattern, to)
    return whole


def triggers() -> list[str]:
    """A few long words of which every known sentence holds one: a text without any has none."""
    left, out = [*PHRASES, *TITLES, "spdx-license-identifier", "-style license", "public license", "gpl"], []
    while left:
        long = {w for s in left for w in s.split() if len(w) > 5} or {w for s in left for w in s.split()}
        out.append(max(sorted(long), key=lambda w: (sum(w in s for s in left), len(w))))
        left = [s for s in left if out[-1] not in s]
    return out


def carried(found: Column) -> Column:
    """The identifier of a sentence that carries its name, or null."""
    part = lambda k: F.regexp_extract(found, r"^gnu_([a-z]+)_([0-9.]*)_([a-z |]*)_(.*)$", k)
    version = F.when(F.instr(part(2), ".") > 0, part(2)).otherwise(F.concat(part(2), F.lit(".0")))
    gnu = F.concat(F.lit("<"), F.upper(part(1)), F.lit("-"), version, F.when(F.instr(part(3), "later") > 0, "-or-later").otherwise("-only"), F.lit(">"))
    named = F.create_map(*(F.lit(x) for k, v in {**OLDER, **{x.lower(): x for x in SPDX}}.items() for x in (k, v)))
    spdx = F.element_at(named, F.regexp_extract(found, "^spdx-license-identifier (.*)$", 1))
    work = (found == "gnu_gpl_3__this work is")  # a sentence of the query's SQL
    return (
        F.when(work, "g").when(found.startswith("gnu_"), gnu).when(found.startswith("spdx-"), F.coalesce(F.concat(F.lit("<"), spdx, F.lit(">")), F.lit("")))
        .when(found.startswith("style_"), F.concat(F.lit("<LicenseRef-"), F.regexp_extract(found, "^style_(.*)$", 1), F.lit("-style>")))
    )


def sequence(text: Column) -> Column:
    """The identifiers of the known sentences, in order. Texts without any word of them, as
    most are, are not rewritten."""
    known = F.create_map(*(F.lit(x) for s, i in {**PHRASES, **TITLES}.items() for x in (s, i)))
    found = F.array_join(F.transform(F.regexp_extract_all(normalised(text), F.lit(FOUND), F.lit(0)), lambda s: F.coalesce(carried(s), F.element_at(known, s))), "")
    lowered = F.lower(text)
    return F.when(reduce(or_, (F.contains(lowered, F.lit(w)) for w in triggers())), found).otherwise("")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, sentence_ids, licenses (in the rules' order), n_matches,
    evidence (of each match the licence and the identifiers that it claimed)."""
    found = docs.select(F.col(id_col).alias("doc_id"), sequence(text_of(text_col)).alias("sentence_ids"))
    own = lambda name, ids: F.regexp_extract(ids, "<([^>]+)>", 1) if name is None else F.lit(name)
    claim = lambda name: lambda ids: F.struct(own(name, ids).alias("license"), ids.alias("sentence_ids"))
    rest, claims = F.col("sentence_ids"), []
    for name, pattern in CLAIMS:  # the matched stretch is replaced, so later rules do not see it
        hits = F.regexp_extract_all(rest, F.lit(f"({pattern})"), 1)
        claims.append(F.transform(hits, claim(name)))
        rest = F.regexp_replace(rest, pattern, "-")
    found = found.withColumn("evidence", F.when(F.col("sentence_ids") != "", F.flatten(F.array(*claims))).otherwise(F.array().cast("array<struct<license:string,sentence_ids:string>>")))
    names = F.array_distinct(F.transform("evidence", lambda e: e["license"]))
    return found.select("doc_id", "sentence_ids", names.alias("licenses"), F.size("evidence").cast("long").alias("n_matches"), "evidence")
