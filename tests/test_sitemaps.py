from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.sources import sitemaps

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="i"'
H = "https://h/"


def index(*locs):
    return f'<?xml version="1.0"?>\n<sitemapindex {NS}>' + "".join(f"<sitemap><loc> {x}\n</loc></sitemap>" for x in locs) + "</sitemapindex>"


def urls(*locs, more=""):
    return f"<n:urlset xmlns:n='x' {NS}>" + "".join(f"<n:url><n:loc>{x}</n:loc><image:image><image:loc>{H}clanci/picture.html</image:loc></image:image></n:url>" for x in locs) + more + "</n:urlset>"


FILES = {
    H + "sitemap.xml": index(H + "sitemap_1.xml", H + "sitemap_2.xml", "https://other/sitemap_9.xml", H + "sitemap_1.txt"),
    H + "sitemap_1.xml": index(H + "sitemap_3.xml", H + "sitemap.xml", H + "sitemap_1.xml"),
    H + "sitemap_2.xml": urls(H + "clanci/b.html", H + "clanci/a.html?x=1&amp;y=2.html", H + "news/c.html", H + "clanci/d.pdf", more=f"<loc>{H}clanci/shallow.html</loc><url><a><loc>{H}clanci/deep.html</loc></a></url>"),
    H + "sitemap_3.xml": index(H + "sitemap_2.xml", H + "sitemap_4.xml", H + "sitemap_5.xml", H + "sitemap_gone.xml"),
    H + "sitemap_4.xml": f"<urlset><url><loc><![CDATA[{H}clanci/q?r=1&s=2.html]]></loc></url><url><loc/></url></urlset>",
    H + "sitemap_5.xml": "<urlset><url>",
    H + "sitemap_unasked.xml": urls(H + "clanci/unasked.html"),
}


def plainly(start):
    import xml.etree.ElementTree as ET

    seen, rest, pages = {}, [start], set()
    while rest:
        loc = rest.pop()
        if loc in seen:
            continue
        try:
            root = ET.fromstring(FILES[loc])
        except KeyError:
            seen[loc] = None
            continue
        except ET.ParseError:
            seen[loc] = "unreadable"
            continue
        found = [(e.text or "").strip() for a in root for e in a if e.tag.endswith("loc")]
        seen[loc] = "index" if "<sitemapindex" in FILES[loc] else "page"
        if seen[loc] == "index":
            rest += [x for x in found if x.startswith(H + "sitemap_") and x.endswith(".xml")]
        else:
            pages |= {x for x in found if x.startswith(H + "clanci/") and x.endswith(".html")}
    return pages, seen


def test_indexes_are_followed_to_the_end(spark):
    files = spark.createDataFrame([(k, v, "x") for k, v in FILES.items()], "loc string, xml string, kind string")
    pages, maps = sitemaps.expanded(files, H + "sitemap.xml", H + "sitemap_", H + "clanci/")
    want, seen = plainly(H + "sitemap.xml")
    assert {r["loc"] for r in pages.collect()} == want and len(want) == 3 and pages.count() == 3
    assert {r["loc"]: r["kind"] for r in maps.collect()} == seen
    assert max(r["round"] for r in maps.collect()) == 3
    few, asked = sitemaps.expanded(files, H + "sitemap.xml", H + "sitemap_", H + "clanci/", most=2)
    assert sorted(r["loc"] for r in asked.collect()) == [H + "sitemap.xml", H + "sitemap_1.xml"] and few.count() == 0
    none, asked = sitemaps.expanded(files.limit(0), H + "sitemap.xml", H, H)
    assert none.count() == 0 and [r["kind"] for r in asked.collect()] == [None]


def test_pages_that_are_fetched_are_left_out(spark):
    pages = spark.createDataFrame([(H + "clanci/sluzbeni/1990_01_3_7.html",), (H + "clanci/sluzbeni/1990_02_4_8.html",), (H + "eli/sluzbeni/1991/5/9",), (H + "other.html",)], "loc string")
    acts = spark.createDataFrame([("1990", "3", "7"), ("1991", "5", "9"), ("1991", "5", "9")], "year string, issue string, document string")
    assert sorted(r["loc"] for r in sitemaps.not_fetched(pages, acts).collect()) == [H + "clanci/sluzbeni/1990_02_4_8.html", H + "other.html"]
    assert [r["loc"] for r in sitemaps.not_fetched(pages, acts, 2).collect()] == [H + "clanci/sluzbeni/1990_02_4_8.html"]
    assert [r["k"] for r in pages.select(sitemaps.path_key(F.col("loc")).alias("k")).collect()] == ["1990/3/7", "1990/4/8", "1991/5/9", None]


def test_the_configuration_bounds_a_crawl(spark):
    from lexspark.config import Config

    files = spark.createDataFrame([(k, v) for k, v in FILES.items()], "loc string, xml string")
    acts = spark.createDataFrame([], "year string, issue string, document string")
    fetch = lambda **more: [r["loc"] for r in sitemaps.to_fetch(files, acts, H + "sitemap.xml", H + "sitemap_", H + "clanci/", Config(**more)).orderBy("loc").collect()]
    want = sorted(plainly(H + "sitemap.xml")[0])
    assert fetch() == fetch(document_limit=0) == want and fetch(document_limit=2) == want[:2] and fetch(max_requests_per_crawl=1) == []
