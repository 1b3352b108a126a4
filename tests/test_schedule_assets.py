"""Files of pages that may hold a schedule."""

from slate.sources import pages

BASE = "https://rink.example.com/a/b"
BODY = (
    "<meta content='/og.jpg?x=1'>" + "." * 500 + '<img src="logo.png">' + "." * 500 + "<a href=\"../files/Skating-2024.PDF\">x</a><img data-src='flyer&amp;1.webp'>" + "." * 500
    + '<a href="/plain.pdf">q</a>' + "." * 500 + '<a href="/plain.gif">x</a> opening hours' + "." * 500 + '<a href="/schedule">no file</a><a href="sponsor-calendar.jpg">s</a>' + "." * 500
    + '<a href="/plain.gif">x</a>'
)


def test_points_and_order(spark):
    rows = [(1, BASE, BODY), (2, None, '<a href="x/hours.pdf">'), (3, BASE, None), (4, BASE, ""), (5, "http://[bad", '<a href="hours.pdf">')]
    found = pages.schedule_assets(spark.createDataFrame(rows, "source_id int, url string, body string")).collect()
    got = {r.source_id: [] for r in found}
    for r in sorted(found, key=lambda r: (r.source_id, r.place)):
        got[r.source_id].append((r.url.removeprefix("https://rink.example.com"), r.points))
    assert got == {1: [("/files/Skating-2024.PDF", 6), ("/a/flyer&1.webp", 5), ("/plain.gif", 2), ("/plain.pdf", 1), ("/a/sponsor-calendar.jpg", 1)], 2: [("x/hours.pdf", 6)]}


def test_many_links_and_no_pages(spark):
    body = "".join(f'<a href="/s{i}.pdf">schedule</a>' for i in range(3000))
    found = pages.schedule_assets(spark.createDataFrame([(1, BASE, body)], "source_id int, url string, body string"))
    assert found.count() == 3000 and found.agg({"place": "max"}).first()[0] == 3000
    assert pages.schedule_assets(spark.createDataFrame([], "source_id int, url string, body string")).count() == 0
