"""Links of pages against a plain count of them."""

from slate.plans.listings import asset_ranks
from slate.sources import pages

SF = "/root/testdata/sf0.001"


def scored(spark, *bodies):
    rows = pages.asset_scores(spark.createDataFrame(list(enumerate(bodies)), "source_id long, body string")).collect()
    return {(r.source_id, r.url): r.points for r in rows}


def plain_links(body):
    """Values of href in double quotes, by searching from place to place."""
    found, at = [], 0
    while (at := body.find('href="', at)) >= 0:
        end = body.index('"', at + 6)
        found.append((body[at + 6 : end], body[max(0, at - 400) : end + 401].lower()))
        at = end
    return found


def plain_points(url, near):
    low = url.lower()
    has = lambda text, *words: any(w in text for w in words)
    return 3 * has(low, "schedule", "calendar", "hours", "page") - 4 * has(low, "logo", "icon", "banner") + 2 * low.endswith((".pdf", ".png", ".jpg", ".jpeg")) + has(near, "schedule", "public", "open")


def test_neighbouring_links_are_all_read(spark):
    body = "".join(f'<a href="/schedule/{i}">x</a>' for i in range(50))
    assert scored(spark, body) == {(0, f"/schedule/{i}"): 4 for i in range(50)}


def test_quotes_attributes_and_surroundings(spark):
    body = "<a HREF = '/hours'>a</a><img src='/a.png?v=1'><img data-src=\"/b.jpg\"><meta content=\"https://x/c.pdf\"><meta content='a page of words'>"
    assert scored(spark, body, None, "", "open" + " " * 390 + '<a href="/x">', "open" + " " * 400 + '<a href="/x">', '<a href="/y">' + " " * 390 + "public") == {
        (0, "/hours"): 3, (0, "/b.jpg"): 2, (0, "https://x/c.pdf"): 2, (3, "/x"): 1, (5, "/y"): 1,
    }


def test_matches_a_plain_count_on_pages(spark):
    wanted = {}
    for page in spark.read.parquet(f"{SF}/pages.parquet").collect():
        for url, near in plain_links((page.html or "").replace('href="/th', 'href="/schedule/th')):
            key = (page.page_id, url)
            wanted[key] = max(wanted.get(key, -9), plain_points(url, near))
    best = {}
    for (page, url), points in wanted.items():
        if points >= 1:
            best.setdefault(page, []).append((-points, url))
    five = {(page, n + 1, url, -points) for page, links in best.items() for n, (points, url) in enumerate(sorted(links)[:5])}
    assert five
    assert {(r.source_id, r.n, r.url, r.points) for r in asset_ranks(spark, SF).collect()} == five
