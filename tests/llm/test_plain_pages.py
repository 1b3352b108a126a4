"""Pages of text without block elements, and formulas within sentences."""

import pytest

from slate.llm import htmltext
from tests.llm.test_layouts_by_hand import MENU, A, B

MATH = "<math><mi>a</mi><mo>+</mo><mrow><mi>b</mi></mrow></math>"
PAGES = {
    "just text &amp; more": "just text & more",
    " two\n\n lines <b>bold</b><br>x ": "two lines bold x",
    "<html><body>Text of a page</body></html>": "Text of a page",
    "<!-- note -->": "",
    "<script>x</script>": "",
    f"<html><body><nav><ul>{MENU}</ul></nav><article><h1>Flood</h1><p>{A}</p><p>Here {MATH} is a sum, and {B}</p></article></body></html>": f"Flood\n{A}\nHere a+b is a sum, and {B}",
}


@pytest.mark.parametrize("html", PAGES)
def test_plain_pages(model, html):
    assert model.text(html) == PAGES[html]


@pytest.fixture(scope="module")
def model(spark):
    return htmltext.fit(htmltext.labelled_pages(spark))
