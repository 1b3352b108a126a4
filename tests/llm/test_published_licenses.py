"""Licences in the layout in which they are published, run into one line, and behind comment marks; and SPDX tags."""

import duckdb
import pytest

from slate.llm import licenses
from tests.llm.test_wrapped_licenses import APACHE, BSD, GPL, LEADERS, MIT, scanned

COPYRIGHT = "Copyright (c) 2021 Some Body and others\n\n"
BSD3 = """\n\n3. Neither the name of {} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.\n"""
LGPL = GPL.replace("This program is", "Some name is").replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1")
PUBLISHED = {
    "MIT": ("The MIT License (MIT)\n\n" + COPYRIGHT + MIT, "MIT"),
    "Apache-2.0": ("Copyright 2021 Some Body\n\n" + APACHE, "Apache-2.0"),
    "Apache-2.0 title": ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   2. Grant of Copyright License. Subject to the terms and conditions of\n      this License, each Contributor hereby grants to You a perpetual,\n      worldwide, non-exclusive, no-charge, royalty-free, irrevocable\n      copyright license to reproduce, prepare Derivative Works of,\n      publicly display, publicly perform, sublicense, and distribute the\n      Work and such Derivative Works in Source or Object form.\n", "Apache-2.0"),
    "BSD-2": (COPYRIGHT + BSD, "BSD-2-Clause"),
    "BSD-3": (COPYRIGHT + BSD + BSD3.format("the copyright holder"), "BSD-3-Clause"),
    "BSD-3 named": (COPYRIGHT + BSD + BSD3.format("Some Organisation"), "BSD-3-Clause"),
    "GPL-2": (GPL.replace("version 3", "version 2"), "GPL-2.0"),
    "GPL-2 title": ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991", "GPL-2.0"),
    "GPL-3": (COPYRIGHT + GPL, "GPL-3.0"),
    "GPL-3 title": ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007", "GPL-3.0"),
    "LGPL-2.1": (LGPL, "LGPL-2.1"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    "EPL-2.0": ("This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/", "EPL-2.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy", "Unlicense"),
    "Zlib": ("Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:", "Zlib"),
    "ISC": ("Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC"),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt)", "BSL-1.0"),
    "CC-BY-SA-4.0": ("This work is licensed under a\nCreative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    "short": ("A tool.\n\nThis project is licensed under the MIT License.", "MIT"),
    "tag": ("SPDX-License-Identifier: MIT", "MIT"),
    "tag of a choice": ("(SPDX-License-Identifier: (GPL-2.0-only OR BSD-3-Clause)) text", "BSD-3-Clause;GPL-2.0"),
    "tag with an exception": ("SPDX-License-Identifier: GPL-3.0-or-later WITH Classpath-exception-2.0", "GPL-3.0"),
}
CLEAN = ["It is said that the MIT license is short", "SPDX-License-Identifier: Something-1.0", "Permission is hereby granted, free of charge. To any person obtaining a copy", "licensed under a tree", "Redistributions of source code must retain\n\nthe above copyright notice, this list of conditions and the following disclaimer"]


#: A title or short notice is none inside a line; these stand anywhere.
RUN_IN = ("MIT", "Apache-2.0", "BSD-2", "BSD-3", "BSD-3 named", "GPL-2", "GPL-3", "LGPL-2.1", "MPL-2.0", "EPL-2.0", "Unlicense", "Zlib", "ISC", "CC-BY-SA-4.0", "tag")


def cases():
    made = [("\n".join((lead + line).rstrip() for line in text.split("\n")), licence) for text, licence in PUBLISHED.values() for lead in LEADERS]
    made += [("Some words and " + " ".join(PUBLISHED[name][0].split()), PUBLISHED[name][1]) for name in RUN_IN]
    made += [(text, "") for text in CLEAN]
    return [t for t, _ in made], [x for _, x in made]


def test_published_texts(spark):
    texts, wanted = cases()
    assert [(i, r.licences) for i, r in enumerate(scanned(spark, texts))] == list(enumerate(wanted))


def test_sql_reads_them_alike(spark):
    texts, _ = cases()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, t in enumerate(texts)] + [(len(texts), None)])
    theirs = sorted(con.execute(licenses.SQL).fetchall())
    ours = [tuple(r) for r in scanned(spark, [*texts, None])]
    assert ours == theirs


@pytest.mark.parametrize("unit", ["...", "\n", "released under the mit license\n", "a;", "// ", "spdx license identifier mit or "])
def test_hostile_texts_take_linear_time(spark, unit):
    text = "licence " + unit * (600_000 // len(unit))
    assert len(scanned(spark, [text])) == 1
