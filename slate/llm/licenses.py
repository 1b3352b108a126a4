"""Licence scans by sentence rules, with DataFrame functions only.

A text is normalised (letters and digits only, ASCII lower case, single spaces) with its breaks kept: hard ones (``.``,
``!``, ``?`` before white space, and blank lines) and soft ones (line ends, and ``;``, ``:`` before white space). What leads a
line (``//``, ``*``, ``#``, ``rem`` and the like) is dropped, and a line of nothing else is blank. A known licence
sentence of ``ANYWHERE`` words or more holds wherever its words stand in a row, whatever is before and behind; a shorter one holds
where it stands between two breaks; no hard break may be inside either. So sentences are found on a line of their own, wrapped over lines, in comments, and run into
a title or a copyright line. ``SPDX-License-Identifier`` tags count as sentences, one for each identifier of their
expression. Of several sentences that start at one place the longest holds, and shorter ones that end at a break inside it.

What remains of a text is its sequence of identifiers, in text order; a licence rule is an ordered sequence of identifiers and holds
if they occur in that order, whatever stands between; sentences that a licence can do without are left out of its shorter rule. A rule gives way to one that holds too and contains it (the two
clauses of a licence to its three). The scan is one pass without a shuffle, and the table of known sentences is a
constant of this module. Sentences are counted by line ends and ``.``, ``!``, ``?`` alone.

Cases: a null or empty text has no sentences and no licence; a rule counts once however often it holds; texts
are never cut; each row is scanned by itself, so repeated rows give repeated results; an empty table gives an
empty table. Only the id and text columns are read.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised sentences of public licence texts and notices, with their identifiers.
SENTENCES = {
    "agpl notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license",
    "agpl title": "gnu affero general public license version 3 19 november 2007",
    "apache conditions": "you may not use this file except in compliance with the license",
    "apache grant": "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    "apache notice": "licensed under the apache license version 2 0 the license",
    "apache short": "licensed under the apache license version 2 0",
    "apache title": "apache license version 2 0 january 2004",
    "apache warranty": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "artistic title": "the artistic license 2 0",
    "boost grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "boost short": "distributed under the boost software license version 1 0",
    "boost title": "boost software license version 1 0 august 17th 2003",
    "bsd acknowledgement": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "cc0 short": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "ccby notice": "this work is licensed under a creative commons attribution 4 0 international license",
    "ccby short": "licensed under cc by 4 0",
    "ccbync notice": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "ccbync short": "licensed under cc by nc 4 0",
    "ccbyncnd notice": "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license",
    "ccbyncsa notice": "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    "ccbysa notice": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "ccbysa short": "licensed under cc by sa 4 0",
    "cddl notice": "the contents of this file are subject to the terms of the common development and distribution license",
    "epl notice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "epl title": "eclipse public license v 2 0",
    "gpl notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl short": "this work is licensed under the gnu general public license version 3",
    "gpl title": "gnu general public license version 3 29 june 2007",
    "gpl warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl2 notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl2 only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl2 title": "gnu general public license version 2 june 1991",
    "isc grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl2 notice": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl2 title": "gnu lesser general public license version 2 1 february 1999",
    "lgpl3 notice": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl3 title": "gnu lesser general public license version 3 29 june 2007",
    "mit grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit short": "released under the mit license",
    "mit warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mpl notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl title": "mozilla public license version 2 0",
    "unlicense notice": "this is free and unencumbered software released into the public domain",
    "wtfpl title": "do what the fuck you want to public license",
    "zlib grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
}

#: Other wordings of known sentences.
WORDINGS = (
    ("bsd endorse", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd endorse", "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("ccby notice", "this work is licensed under the creative commons attribution 4 0 international license"),
    ("ccbync notice", "this work is licensed under the creative commons attribution noncommercial 4 0 international license"),
    ("ccbysa notice", "this work is licensed under the creative commons attribution sharealike 4 0 international license"),
    ("epl notice", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0"),
    ("epl notice", "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0"),
    ("isc grant", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl2 notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl3 notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl warranty", "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("mit notice", "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"),
    ("mit warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non infringement"),
)
#: What licences are called for short, and the short lines that name one.
SHORT = (
    ("apache short", "apache 2 0"),
    ("apache short", "apache2"),
    ("bsd2 short", "bsd 2 clause"),
    ("bsd3 short", "bsd 3 clause"),
    ("gpl short", "gpl 3 0"),
    ("gpl short", "gplv3"),
    ("gpl2 short", "gpl 2 0"),
    ("gpl2 short", "gplv2"),
    ("isc short", "isc"),
    ("mit short", "mit"),
    ("mpl short", "mpl 2 0"),
)
LINES = ("{} licensed", "this project is {} licensed", "this software is {} licensed", "license {}", "licence {}", "see license {}", "see the license file {}", "{} license see license")
#: The Creative Commons family by terms and version, and what follows the version in a notice.
CC_TERMS = {"by": "attribution", "by sa": "attribution sharealike", "by nc": "attribution noncommercial", "by nd": "attribution noderivatives", "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives"}
CC_VERSIONS = {"2 0": "generic", "2 5": "generic", "3 0": "unported", "4 0": "international"}
#: How short notices begin, and what the licences are called in them.
OPENINGS = ("released under", "licensed under", "distributed under", "available under", "this project is licensed under", "this software is licensed under", "this work is licensed under", "this file is licensed under", "this code is released under")
CALLED: tuple[tuple[str, str], ...] = (
    ("agpl short", "gnu affero general public license version 3"),
    ("apache short", "apache license version 2 0"),
    ("apache short", "apache license 2 0"),
    ("apache short", "apache 2 0 license"),
    ("boost short", "boost software license version 1 0"),
    ("bsd2 short", "bsd 2 clause license"),
    ("bsd3 short", "bsd 3 clause license"),
    ("ccby short", "cc by 4 0"),
    ("ccbync short", "cc by nc 4 0"),
    ("ccbysa short", "cc by sa 4 0"),
    ("gpl short", "gnu general public license version 3"),
    ("gpl short", "gnu general public license v3 0"),
    ("gpl2 short", "gnu general public license version 2"),
    ("gpl2 short", "gnu general public license v2 0"),
    ("isc short", "isc license"),
    ("mit short", "mit license"),
    ("mpl short", "mozilla public license version 2 0"),
    ("mpl short", "mozilla public license 2 0"),
)
#: Identifiers of SPDX tags, with the names of licences here and their kinds. ``-only`` and ``-or-later`` go with the GNU ones.
TAGS = (
    ("0BSD", "0BSD", "permissive"),
    ("AGPL-3.0", "AGPL-3.0", "copyleft"),
    ("Apache-2.0", "Apache-2.0", "permissive"),
    ("Artistic-2.0", "Artistic-2.0", "permissive"),
    ("BSD-2-Clause", "BSD-2-Clause", "permissive"),
    ("BSD-3-Clause", "BSD-3-Clause", "permissive"),
    ("BSL-1.0", "BSL-1.0", "permissive"),
    ("CC-BY-4.0", "CC-BY-4.0", "permissive"),
    ("CC-BY-NC-4.0", "CC-BY-NC-4.0", "restricted"),
    ("CC-BY-SA-4.0", "CC-BY-SA-4.0", "copyleft"),
    ("CC0-1.0", "CC0-1.0", "permissive"),
    ("CDDL-1.0", "CDDL-1.0", "copyleft"),
    ("EPL-2.0", "EPL-2.0", "copyleft"),
    ("GPL-2.0", "GPL-2.0", "copyleft"),
    ("GPL-3.0", "GPL-3.0", "copyleft"),
    ("ISC", "ISC", "permissive"),
    ("LGPL-2.1", "LGPL-2.1", "copyleft"),
    ("LGPL-3.0", "LGPL-3.0", "copyleft"),
    ("MIT", "MIT", "permissive"),
    ("MIT-0", "MIT-0", "permissive"),
    ("MPL-2.0", "MPL-2.0", "copyleft"),
    ("Unlicense", "Unlicense", "permissive"),
    ("WTFPL", "WTFPL", "permissive"),
    ("Zlib", "Zlib", "permissive"),
)
TAG = "spdx license identifier"
#: This "or" does not join two identifiers.
LATER = " or later"

#: Licence rules, as (rule, licence, kind, identifiers in order).
RULES: tuple[tuple[str, str, str, tuple[str, ...]], ...] = (
    ("agpl-3.0 line", "AGPL-3.0", "copyleft", ("agpl short",)),
    ("agpl-3.0 notice", "AGPL-3.0", "copyleft", ("agpl notice",)),
    ("agpl-3.0 text", "AGPL-3.0", "copyleft", ("agpl title",)),
    ("apache-2.0 header", "Apache-2.0", "permissive", ("apache notice", "apache conditions", "apache warranty")),
    ("apache-2.0 line", "Apache-2.0", "permissive", ("apache short",)),
    ("apache-2.0 text", "Apache-2.0", "permissive", ("apache title", "apache grant")),
    ("artistic-2.0 text", "Artistic-2.0", "permissive", ("artistic title",)),
    ("bsd-2 clauses", "BSD-2-Clause", "permissive", ("bsd source", "bsd binary")),
    ("bsd-2 line", "BSD-2-Clause", "permissive", ("bsd2 short",)),
    ("bsd-3 clauses", "BSD-3-Clause", "permissive", ("bsd source", "bsd binary", "bsd endorse")),
    ("bsd-3 line", "BSD-3-Clause", "permissive", ("bsd3 short",)),
    ("bsd-4 clauses", "BSD-4-Clause", "permissive", ("bsd source", "bsd binary", "bsd acknowledgement", "bsd endorse")),
    ("bsl-1.0 line", "BSL-1.0", "permissive", ("boost short",)),
    ("bsl-1.0 text", "BSL-1.0", "permissive", ("boost grant",)),
    ("cc0 line", "CC0-1.0", "permissive", ("cc0 short",)),
    ("cc-by-4.0 line", "CC-BY-4.0", "permissive", ("ccby short",)),
    ("cc-by-4.0 notice", "CC-BY-4.0", "permissive", ("ccby notice",)),
    ("cc-by-nc-4.0 line", "CC-BY-NC-4.0", "restricted", ("ccbync short",)),
    ("cc-by-nc-4.0 notice", "CC-BY-NC-4.0", "restricted", ("ccbync notice",)),
    ("cc-by-nc-nd-4.0 notice", "CC-BY-NC-ND-4.0", "restricted", ("ccbyncnd notice",)),
    ("cc-by-nc-sa-4.0 notice", "CC-BY-NC-SA-4.0", "restricted", ("ccbyncsa notice",)),
    ("cc-by-sa-4.0 line", "CC-BY-SA-4.0", "copyleft", ("ccbysa short",)),
    ("cc-by-sa-4.0 notice", "CC-BY-SA-4.0", "copyleft", ("ccbysa notice",)),
    ("cddl-1.0 notice", "CDDL-1.0", "copyleft", ("cddl notice",)),
    ("epl-2.0 notice", "EPL-2.0", "copyleft", ("epl notice",)),
    ("epl-2.0 text", "EPL-2.0", "copyleft", ("epl title",)),
    ("gpl-2.0 header", "GPL-2.0", "copyleft", ("gpl2 notice", "gpl warranty")),
    ("gpl-2.0 line", "GPL-2.0", "copyleft", ("gpl2 short",)),
    ("gpl-2.0 notice", "GPL-2.0", "copyleft", ("gpl2 notice",)),
    ("gpl-2.0 only", "GPL-2.0", "copyleft", ("gpl2 only",)),
    ("gpl-2.0 text", "GPL-2.0", "copyleft", ("gpl2 title",)),
    ("gpl-3.0 header", "GPL-3.0", "copyleft", ("gpl notice", "gpl warranty")),
    ("gpl-3.0 line", "GPL-3.0", "copyleft", ("gpl short",)),
    ("gpl-3.0 notice", "GPL-3.0", "copyleft", ("gpl notice",)),
    ("gpl-3.0 text", "GPL-3.0", "copyleft", ("gpl title",)),
    ("isc grant", "ISC", "permissive", ("isc grant",)),
    ("isc line", "ISC", "permissive", ("isc short",)),
    ("lgpl-2.1 notice", "LGPL-2.1", "copyleft", ("lgpl2 notice",)),
    ("lgpl-2.1 text", "LGPL-2.1", "copyleft", ("lgpl2 title",)),
    ("lgpl-3.0 notice", "LGPL-3.0", "copyleft", ("lgpl3 notice",)),
    ("lgpl-3.0 text", "LGPL-3.0", "copyleft", ("lgpl3 title",)),
    ("mit grant and warranty", "MIT", "permissive", ("mit grant", "mit warranty")),
    ("mit line", "MIT", "permissive", ("mit short",)),
    ("mit text", "MIT", "permissive", ("mit grant", "mit notice", "mit warranty")),
    ("mpl-2.0 line", "MPL-2.0", "copyleft", ("mpl short",)),
    ("mpl-2.0 notice", "MPL-2.0", "copyleft", ("mpl notice",)),
    ("mpl-2.0 text", "MPL-2.0", "copyleft", ("mpl title",)),
    ("unlicense notice", "Unlicense", "permissive", ("unlicense notice",)),
    ("wtfpl text", "WTFPL", "permissive", ("wtfpl title",)),
    ("zlib grant", "Zlib", "permissive", ("zlib grant",)),
)



def _cc() -> tuple[list[tuple[str, str]], list[tuple[str, str]], list[tuple[str, str, str, tuple[str, ...]]]]:
    """Notices and short names of the Creative Commons family as (identifier, words), and their rules where none is there yet."""
    notices, names, rules = [], [], []
    for (terms, words), (version, area) in product(CC_TERMS.items(), CC_VERSIONS.items()):
        name = "cc" + terms.replace(" ", "") + ("" if version == "4 0" else version.replace(" ", ""))
        licence = f"CC-{terms.upper().replace(' ', '-')}-{version.replace(' ', '.')}"
        kind = "restricted" if {"nc", "nd"} & set(terms.split()) else "copyleft" if "sa" in terms else "permissive"
        full = f"creative commons {words} {version}"
        notices += [(f"{name} notice", f"this work is licensed under {article} {full}{end}") for article in ("a", "the") for end in (f" {area} license", " license", f" {area}")]
        names += [(f"{name} short", f"cc {terms} {version}")] + [(f"{name} short", full + end) for end in ("", f" {area}", " license", f" {area} license")]
        rules += [(f"{licence.lower()} {what}", licence, kind, (f"{name} {what}",)) for what in ("line", "notice")]
    return notices, names, [(rule, licence, kind, (names_[0].replace(" line", " short"),)) for rule, licence, kind, names_ in rules]


CC_NOTICES, CC_NAMES, CC_RULES = _cc()
RULES += tuple(rule for rule in CC_RULES if rule[0] not in {r[0] for r in RULES})
CALLED += SHORT + tuple((name, words) for name, words in CC_NAMES if words.startswith("cc "))
ANYWHERE = 10
CUT = r"\n|[.!?][\x20\x09-\x0D]+"
WORD = "[A-Za-z0-9]"
KINDS = ("restricted", "copyleft", "permissive")

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Steps of the normal form of a text in ASCII lower case, with line ends around it: capitals are free then, and stand for hard (H) and soft (S)
#: breaks; at the end these are ``||`` and ``//``, so that sentences can share one. No step repeats a group or can fail after a long run, so none
#: needs a deep stack or more than linear time, however long a text is.
BREAKS = (
    (r"\n[^\p{L}\p{N}\n]*\n[^\p{L}\p{N}]*", "H"),
    (r"\n[^\p{L}\p{N}]*", "S"),
    (r"([^a-z0-9])v[.][\x20\x09-\x0DS]+", "<1>v "),
    (r"[.!?][\x20\x09-\x0DSH]+", "H"),
    (r"[;:][\x20\x09-\x0D]+", "S"),
    ("[^a-z0-9HS]+", " "),
    ("([HS])(?:rem|dnl|c) ?S", "<1>H"),
    ("([HS])(?:rem|dnl|c) ?S", "<1>H"),
    ("([HS])(?:rem|dnl|c) ", "<1>"),
    ("H", "||"),
    ("S", "//"),
)
#: Every known sentence has one of these, so texts without them are not read for sentences.
ANCHORS = ("licen", "warrant", "copyright", "permission", "unencumbered", "advertising", "creative commons", "cc by", "cc-by", "released under", "distributed under", "available under")


def _tag(identifier: str) -> str:
    return identifier.lower().replace("-", " ").replace(".", " ")


def _tags() -> list[tuple[str, str, str, str]]:
    """(normalised identifier, name, licence, kind) of the SPDX tags, with the endings of the GNU ones."""
    out = []
    for identifier, licence, kind in TAGS:
        for ending in ("", "-only", "-or-later") if "GPL" in identifier else ("",):
            out.append((_tag(identifier + ending), f"spdx {_tag(identifier)}", licence, kind))
    return out


def _sentences() -> dict[str, str]:
    """Identifiers by normalised sentence, other wordings and short notices included."""
    known = {sentence: name for name, sentence in SENTENCES.items()}
    known |= {sentence: name for name, sentence in WORDINGS}
    for name, sentence in [*CC_NOTICES, *CC_NAMES, *((name, line.format(short)) for name, short in SHORT for line in LINES)]:
        known.setdefault(sentence, name)
    for sentence, name in list(known.items()):
        if sentence.startswith(("this program is free software", "this library is free software")):
            known[sentence.split(" ", 2)[2]] = name  # whatever it is that is free software
    for opening, (name, called), the in product(OPENINGS, CALLED, ("the ", "")):
        made = f"{opening} {the}{called}"
        if any(anchor in made for anchor in ANCHORS):
            known.setdefault(made, name)
    return known


KNOWN = _sentences()
TAGGED = {f"{TAG} {tag}": name for tag, name, _, _ in _tags()}
ALL_RULES = RULES + tuple((f"tag {identifier}", licence, kind, (f"spdx {_tag(identifier)}",)) for identifier, licence, kind in TAGS)


def _wrapped(sentence: str) -> str:
    """A known sentence in the normal form, with any soft breaks between its words."""
    return sentence.replace(" ", "[ /]+")


def _any(sentences: list[str]) -> str:
    return "|".join(_wrapped(s) for s in sorted(sentences, key=lambda s: (-len(s), s)))


def _find() -> str:
    long = [s for s in KNOWN if s.count(" ") + 1 >= ANYWHERE]
    made = {f"{o} {t}{c}" for o, (_, c), t in product(OPENINGS, CALLED, ("the ", ""))}
    short = [s for s in KNOWN if s.count(" ") + 1 < ANYWHERE and s not in made]
    notice = f"(?:{_any(list(OPENINGS))})[ /]+(?:the[ /]+)?(?:{_any([c for _, c in CALLED])})"
    tags = _any([tag for tag, *_ in _tags()])
    tag = rf"{_wrapped(TAG)}[ /]+(?:{tags})\b(?: (?:or|and) (?:{tags})\b)*"
    return rf"(?:[|/] ?)?\b(?:{tag}|(?:{_any(long)})\b)|[|/] ?(?:{_any(short)}|{notice}) ?[|/]"


FIND = _find()
#: Short sentences with which a known sentence begins; both hold if there is a break between.
HEADS = sorted((s for s in KNOWN if s.count(" ") + 1 < ANYWHERE and any(x.startswith(s + " ") for x in KNOWN)), key=lambda s: (len(s), s))
HEADS = [s for s in HEADS if any(x.startswith(s + " ") and x.count(" ") + 1 >= ANYWHERE for x in KNOWN)]


def _in_order(identifiers: tuple[str, ...]) -> str:
    """Over identifiers written as ``;a;;b;``: these, in this order, without trying again what has been passed."""
    return "^" + "".join(f"(?>.*?;{name};)" for name in identifiers)


def _contains(long: tuple[str, ...], short: tuple[str, ...]) -> bool:
    rest = iter(long)
    return long != short and all(name in rest for name in short)


WIDER = {rule: [other for other, _, _, more in ALL_RULES if _contains(more, names)] for rule, _, _, names in ALL_RULES}


def _marked(text: Column) -> Column:
    """The normal form of a text in ASCII lower case."""
    out = F.concat(F.lit("\n"), text, F.lit("\n"))
    for pattern, by in BREAKS:
        out = F.regexp_replace(out, pattern, by.replace("<1>", "$1"))
    return out


def _names(text: Column) -> Column:
    """Identifiers of the known sentences of a text, by where they start; of two at one place the shorter is first."""
    lowered = F.translate(text, CAPITALS, CAPITALS.lower())
    found = F.regexp_extract_all(_marked(lowered), F.lit(FIND), 0)
    # one literal that is read once, where a map of literals would be thousands of expressions
    known = F.from_json(F.lit(json.dumps({**KNOWN, **TAGGED})), "map<string,string>")

    def named(hit: Column) -> Column:
        words = F.trim(F.regexp_replace(hit, "[ |/]+", " "))
        heads = [F.when((words != s) & hit.rlike(f"^[|/ ]*{_wrapped(s)} ?/"), F.lit(KNOWN[s])) for s in HEADS]
        tags = F.transform(F.split(F.replace(F.substring(words, F.lit(len(TAG) + 2), F.length(words)), F.lit(LATER), F.lit("")), " (?:or|and) "), lambda t: F.element_at(known, F.concat(F.lit(TAG + " "), t)))
        return F.when(words.startswith(TAG + " "), tags).otherwise(F.filter(F.array(*heads, F.element_at(known, words)), lambda x: x.isNotNull()))

    # this lower case is faster, and finds at least as many texts
    may = reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(x)) for x in ANCHORS])
    return F.when(may, F.flatten(F.transform(found, named))).otherwise(F.array().cast("array<string>"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, sentence count, known sentence identifiers in order, rules that hold, licences and the strictest kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sentences = F.filter(F.split(text, CUT), lambda s: s.rlike(WORD))
    named = df.select(F.col(id_col), F.size(sentences).cast("long").alias("n_sentences"), _names(text).alias("l_names"))
    sequence = F.concat(F.lit(";"), F.array_join("l_names", ";;"), F.lit(";"))
    rules = F.array(*[F.when(sequence.rlike(_in_order(names)), F.lit(rule)) for rule, _, _, names in ALL_RULES])
    none = F.array().cast("array<string>")
    held = named.select("*", F.when(F.size("l_names") == 0, none).otherwise(F.filter(rules, lambda x: x.isNotNull())).alias("l_all"))
    wider = F.create_map(*[x for rule, by in WIDER.items() if by for x in (F.lit(rule), F.array(*map(F.lit, by)))])
    matched = held.select(
        id_col,
        "n_sentences",
        F.size("l_names").cast("long").alias("n_known"),
        F.array_join("l_names", ";").alias("sentence_ids"),
        F.filter("l_all", lambda r: ~F.coalesce(F.arrays_overlap(F.element_at(wider, r), F.col("l_all")), F.lit(False))).alias("l_held"),
    )
    licence_of, kind_of = (F.create_map(*[F.lit(x) for r in ALL_RULES for x in (r[0], r[k])]) for k in (1, 2))
    kinds = F.transform("l_held", lambda r: F.element_at(kind_of, r))
    kind = F.coalesce(*[F.when(F.array_contains(kinds, k), F.lit(k)) for k in KINDS], F.lit("none"))
    return matched.select(
        id_col,
        "n_sentences",
        "n_known",
        "sentence_ids",
        F.array_join(F.sort_array("l_held"), ";").alias("rules"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("l_held", lambda r: F.element_at(licence_of, r)))), ";").alias("licences"),
        kind.alias("kind"),
    )


def query(documents: DataFrame) -> DataFrame:
    """op6: the licence scan of every document."""
    return scan(documents)


def _values(rows: list[tuple[str, ...]]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in rows)


def _sql_marked(column: str) -> str:
    out = f"chr(10) || {column} || chr(10)"
    for pattern, by in BREAKS:
        out = f"regexp_replace({out}, '{pattern}', '{by.replace('<1>', chr(92) + '1')}', 'g')"
    return out


SQL = r"""
WITH known(sentence, name) AS (VALUES %s),
rules(rule, licence, kind, pattern) AS (VALUES %s),
wider(rule, by_rule) AS (VALUES %s),
heads(sentence, pattern) AS (VALUES %s),
lowered AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS body,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM documents
), counted AS (
  SELECT k, doc_id, len(list_filter(regexp_split_to_array(body, '%s'), lambda s: regexp_matches(s, '%s'))) AS n_sentences FROM lowered
), found AS (
  SELECT k, regexp_extract_all(%s, '%s') AS hits FROM lowered WHERE regexp_matches(low, '%s')
), matches AS (
  SELECT k, unnest(hits) AS hit, unnest(range(len(hits))) AS place FROM found
), plain AS (
  SELECT k, place, hit, trim(regexp_replace(hit, '[ |/]+', ' ', 'g')) AS words FROM matches
), tags AS (
  SELECT k, place, string_split_regex(replace(substr(words, %d), '%s', ''), ' (?:or|and) ') AS t FROM plain WHERE starts_with(words, '%s ')
), sentences AS (
  SELECT k, place, length(sentence) AS part, sentence FROM plain JOIN heads ON regexp_matches(hit, pattern) AND words <> sentence
  UNION ALL SELECT k, place, 1000000, words FROM plain WHERE NOT starts_with(words, '%s ')
  UNION ALL SELECT k, place, unnest(range(len(t))), '%s ' || unnest(t) FROM tags
), named AS (
  SELECT k, count(*) AS n, string_agg(name, ';' ORDER BY place, part) AS names FROM sentences JOIN known USING (sentence) GROUP BY k
), all_held AS (
  SELECT k, rule, licence, kind FROM named JOIN rules ON regexp_matches(';' || replace(names, ';', ';;') || ';', pattern)
), held AS (
  SELECT k, string_agg(rule, ';' ORDER BY rule) AS rules, array_to_string(list_sort(list_distinct(list(licence))), ';') AS licences,
         CASE WHEN bool_or(kind = 'restricted') THEN 'restricted' WHEN bool_or(kind = 'copyleft') THEN 'copyleft' ELSE 'permissive' END AS kind
  FROM all_held AS a
  WHERE NOT EXISTS (SELECT 1 FROM wider JOIN all_held AS b ON b.rule = by_rule WHERE wider.rule = a.rule AND b.k = a.k)
  GROUP BY k
)
SELECT doc_id, CAST(n_sentences AS BIGINT) AS n_sentences, CAST(coalesce(n, 0) AS BIGINT) AS n_known, coalesce(names, '') AS sentence_ids,
       coalesce(rules, '') AS rules, coalesce(licences, '') AS licences, coalesce(kind, 'none') AS kind
FROM counted LEFT JOIN named USING (k) LEFT JOIN held USING (k)
""" % (
    _values([*KNOWN.items(), *TAGGED.items()]),
    _values([(rule, licence, kind, ".*".join(f";{name};" for name in names)) for rule, licence, kind, names in ALL_RULES]),
    _values([(rule, by) for rule, more in WIDER.items() for by in more]),
    _values([(s, f"^[|/ ]*{_wrapped(s)} ?/") for s in HEADS]),
    CUT,
    WORD,
    _sql_marked("low"),
    FIND,
    "|".join(ANCHORS),
    len(TAG) + 2,
    LATER,
    TAG,
    TAG,
    TAG,
)
