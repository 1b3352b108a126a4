"""Licence sentences that are wrapped over lines, in plain texts and in comments."""

import pytest

from slate.llm import licenses

APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
BSD = """1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE"""
WHOLE = [(APACHE, "apache-2.0 header"), (GPL, "gpl-3.0 header"), (BSD, "bsd-2 clauses"), (MIT, "mit text")]
LEADERS = ["", "// ", " * ", "# ", ";; ", "dnl ", "REM "]


def scanned(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r for _, r in sorted((r.doc_id, r) for r in rows)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_wrapped_texts_hold_under_any_leader(spark, end):
    made = [(end.join((lead + line).rstrip() for line in text.split("\n")), rule) for text, rule in WHOLE for lead in LEADERS]
    assert [(r.rules, r.sentence_ids) for r in scanned(spark, [t for t, _ in made])] == [(rule, ";".join(next(x[3] for x in licenses.RULES if x[0] == rule))) for _, rule in made]


def test_both_readings_count_once_in_text_order(spark):
    short = "Licensed under the Apache License, Version 2.0"
    texts = [short, f'{short}\n(the "License");', f"{short}\n{short}.", f"Released under the\nMIT license\n{short}", "Released under the\n\nMIT license", "Released under. the\nMIT license", "It is released\nunder the MIT license"]
    assert [r.sentence_ids for r in scanned(spark, texts)] == ["apache short", "apache short;apache notice", "apache short;apache short", "mit short;apache short", "", "", ""]


def test_every_sentence_has_an_anchor_and_holds_alone(spark):
    assert all(any(a in s for a in licenses.ANCHORS) for s in licenses.SENTENCES.values())
    alone = scanned(spark, list(licenses.SENTENCES.values()))
    wrapped = scanned(spark, [s.replace(" ", "\n") for s in licenses.SENTENCES.values()])
    assert [r.sentence_ids for r in alone] == list(licenses.SENTENCES)
    assert [r.sentence_ids.split(";")[-1] for r in wrapped] == list(licenses.SENTENCES)


def test_long_runs_of_breaks(spark):
    assert [r.sentence_ids for r in scanned(spark, ["\n" * 200_000 + MIT + ". " * 200_000 + "\n//" * 200_000])] == ["mit grant;mit notice;mit warranty"]
