"""Short forms, the Creative Commons family, and a licence text without one of its sentences."""

import pytest

from slate.llm import licenses
from tests.llm.test_wrapped_licenses import MIT, scanned

SHORT = {
    "This project is MIT licensed.": "MIT",
    "Licensed under MIT.": "MIT",
    "License: MIT": "MIT",
    "See LICENSE (Apache-2.0).": "Apache-2.0",
    "CC BY 4.0": "CC-BY-4.0",
    "Creative Commons Attribution-ShareAlike 4.0": "CC-BY-SA-4.0",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 3.0 Unported License.": "CC-BY-NC-3.0",
    "This work is licensed under the Creative Commons\n Attribution-NoDerivatives 2.5 Generic License": "CC-BY-ND-2.5",
    "Text.\n\nCC-BY-NC-SA 2.0\n\nMore.": "CC-BY-NC-SA-2.0",
    "BSD-3-Clause licensed": "BSD-3-Clause",
    "Released under the GPLv3.": "GPL-3.0",
    MIT: "MIT",
    MIT.replace("permission notice shall", "permission notice (including the next paragraph) shall"): "MIT",
    MIT.replace("The above copyright notice", "A copyright notice"): "MIT",
    "We met at MIT. The license of the driver was lost.": "",
    "A card by cc by 4 people": "",
    "the creative commons of the village": "",
    "Permission to park is licensed by the town.": "",
}


def test_short_forms(spark):
    assert [(text, r.licences) for text, r in zip(SHORT, scanned(spark, list(SHORT)), strict=True)] == list(SHORT.items())


@pytest.mark.parametrize("version", ["2.0", "2.5", "3.0", "4.0"])
def test_family_by_terms(spark, version):
    terms = ["BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"]
    assert [r.licences for r in scanned(spark, [f"CC {t} {version}" for t in terms])] == [f"CC-{t}-{version}" for t in terms]


def test_every_identifier_of_a_rule_has_a_sentence():
    names = set(licenses.KNOWN.values()) | set(licenses.TAGGED.values())
    assert all(name in names for _, _, _, more in licenses.ALL_RULES for name in more)
    assert len({r[0] for r in licenses.ALL_RULES}) == len(licenses.ALL_RULES)
