"""Pages written by hand, in layouts and languages that the training pages do not have, with the text that belongs to them."""

import time

import pytest

from slate.llm import htmltext

#: Invented prose, long enough to be told from a menu.
A = "The river rose in the night, and by morning the lower meadow was under water; nobody had seen that in forty years."
B = "We carried what we could to the upper floor, then sat on the stairs and waited for the boat, which came at noon."
C = "Later that week the mayor thanked everyone who had helped. The bill, she said, would be shared between the three parishes."
SHORT = "It ended there."
MENU = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Start", "News", "Sport", "Contact"))
NOSE = "<!DOCTYPE html><html><head><title>T</title></head><body>"
PAGES = {
    "preformatted text in main": (f"{NOSE}<nav><ul>{MENU}</ul></nav><main><h1>How to build</h1><p>{A}</p><pre>make clean\n  make all</pre><p>{B}</p></main><footer>&copy; 2020 X</footer>", f"How to build\n{A}\nmake clean make all\n{B}"),
    "button in an article": (f"{NOSE}<article><h1>Flood</h1><p>{A}</p><button type=button>Share this</button><p>{B}</p></article>", f"Flood\n{A}\n{B}"),
    "German names": (
        f'{NOSE}<div id="kopfzeile"><div id="hauptmenue"><ul>{MENU}</ul></div></div><div id="inhalt"><h1>Die Flut</h1><p>{A}</p><p>{B}</p><p>{C}</p></div>'
        f'<div id="seitenleiste"><h3>Mehr dazu</h3><ul><li><a href="/1">Wetter</a></li><li><a href="/2">Pegel</a></li><li><a href="/3">Bilder</a></li></ul></div><div id="fusszeile">&copy; 2021 Tagblatt <a href="/i">Impressum</a></div></body></html>',
        f"Die Flut\n{A}\n{B}\n{C}",
    ),
    "table layout": (
        f'{NOSE}<table width="100%"><tr><td colspan=2><a href="/">Home</a> | <a href="/n">News</a> | <a href="/c">Contact</a></td></tr><tr><td width=120><a href="/a">One</a><br><a href="/b">Two</a><br><a href="/c">Three</a></td><td><h2>The flood</h2><p>{A}</p><p>{B}</p></td></tr></table>',
        f"The flood\n{A}\n{B}",
    ),
    "hashed names": (
        f'{NOSE}<div class="x1a9f"><div class="k_77c"><a href="/">Home</a><a href="/n">News</a><a href="/s">Sport</a><a href="/w">Weather</a></div><div class="b_0e1"><div class="q9"><h1>Flood</h1><p>{A}</p><p>{B}</p><p>{SHORT}</p></div></div><div class="k_78d">&copy; 2022 Some Paper. All rights reserved.</div></div>',
        f"Flood\n{A}\n{B}\n{SHORT}",
    ),
    "text between line breaks": (f"{NOSE}<div class='nav'><ul>{MENU}</ul></div><div class='content'><h1>Flood</h1>{A}<br><br>{B}<br><br>{C}</div><div class='footer'>&copy; X</div>", f"Flood\n{A} {B} {C}"),
    "no names and no article element": (f"{NOSE}<div><ul>{MENU}</ul></div><div><h1>Flood</h1><p>{A}</p><p>{B}</p><ul><li>{SHORT}</li><li>It rained.</li></ul><p>{C}</p></div><div><p>&copy; 2019 X</p></div>", f"Flood\n{A}\n{B}\n{SHORT}\nIt rained.\n{C}"),
    "an advert among the text": (f"{NOSE}<article><h1>Flood</h1><p>{A}</p><div class='ad-slot'><p>Buy new boots, now at half the price!</p></div><p>{B}</p></article>", f"Flood\n{A}\n{B}"),
    "reader comments": (f"{NOSE}<article><h1>Flood</h1><p>{A}</p><p>{B}</p></article><section id='comments'><h2>3 comments</h2><div class='comment'><p>Ann</p><p>I was there, it was worse than they say.</p></div><div class='comment'><p>Bob</p><p>Same here.</p></div></section>", f"Flood\n{A}\n{B}"),
    "form and notice": (f"{NOSE}<div class='cookie-banner'>We use cookies to make this site better. <button>OK</button></div><form action='/s'><label>Search</label><input name=q><select><option>All<option>News</select></form><article><h1>Flood</h1><p>{A}</p></article>", f"Flood\n{A}"),
    "unclosed drawing": (f"{NOSE}<article><h1>Flood</h1><svg viewBox='0 0 1 1'><p>{A}</p><p>{B}</p></article>", f"Flood\n{A}\n{B}"),
    "many short paragraphs": (f"{NOSE}<article><h1>Words</h1>" + f"<p>{SHORT}</p>" * 60 + "</article><footer>&copy; X</footer>", "\n".join(["Words"] + [SHORT] * 60)),
    "a very long paragraph": (f"{NOSE}<article><h1>Words</h1><p>{(A + ' ') * 300}</p><p>Les.</p><p>{B}</p></article>", f"Words\n{' '.join([A] * 300)}\nLes.\n{B}"),
    "definitions and a table": (f"{NOSE}<article><h1>Terms</h1><p>{A}</p><dl><dt>Weir</dt><dd>{B}</dd></dl><table><tr><th>Day</th><th>Level</th></tr><tr><td>Monday</td><td>3 m</td></tr></table></article>", f"Terms\n{A}\nWeir\n{B}\nDay\nLevel\nMonday\n3 m"),
    # these were written after the training pages were settled
    "Spanish names": (f'{NOSE}<div class="cabecera"><a href="/">El Diario</a></div><div class="cuerpo"><h1>La riada</h1><p>{A}</p><p>{B}</p><p>{C}</p></div><div class="barra-lateral"><p><a href="/1">Lo más leído</a></p><p><a href="/2">Deportes</a></p></div><div class="pie">&copy; 2018 El Diario</div>', f"La riada\n{A}\n{B}\n{C}"),
    "main with sections": (f"{NOSE}<header><a href='/'>Paper</a></header><main><section><h2>First</h2><p>{A}</p></section><section><h2>Second</h2><p>{B}</p></section></main><aside><h4>Related</h4><ul>{MENU}</ul></aside>", f"First\n{A}\nSecond\n{B}"),
    "cut off": (f"{NOSE}<nav><ul>{MENU}</ul></nav><article><h1>Flood</h1><p>{A}</p><p>{B}</p><p>{C}</p><div class='ad", f"Flood\n{A}\n{B}\n{C}"),
}


@pytest.fixture(scope="module")
def model(spark):
    return htmltext.fit(htmltext.labelled_pages(spark))


@pytest.mark.parametrize("name", PAGES)
def test_page_by_hand(model, name):
    html, wanted = PAGES[name]
    assert model.text(html) == wanted


HOSTILE = {
    "open quotes": '<a "' * 250_000,
    "open values": '<a href="' * 120_000,
    "ends in quotes": "<a x='>'" * 120_000,
    "closed and not open": "<div>" * 20_000 + "</p>" * 100_000,
    "deep": "<div>" * 100_000 + "text",
    "lists in no list": "<li>" * 60_000 + "<div>" * 60_000 + "<li>" * 60_000,
    "drawings without an end": "<svg>" * 200_000,
    "ends without an end": "<script></script " * 60_000,
    "comments without an end": "<!--" * 250_000,
    "references": "&amp" * 250_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_markup_takes_linear_time(model, name):
    page = HOSTILE[name]
    seconds = []
    for part in (page[: len(page) // 4], page):
        start = time.perf_counter()
        model.text(part)
        seconds.append(time.perf_counter() - start)
    # a quadratic reading would take sixteen times as long; these take four
    assert seconds[1] < 1 or seconds[1] < 9 * seconds[0]
    if name == "open quotes":
        assert seconds[1] < 1


def test_text_around_hostile_markup(model):
    assert model.text(f"<article><h1>Flood</h1><p title='a > b' class=\"x\">{A}</p><p {'x=' * 1000}>{B}<p title=\"never closed>{C}</article>") == f"Flood\n{A}\n{B}\n{C}"
