"""Links in other than absolute forms, and several in a page."""

from urllib.parse import urljoin

from folioscope.llm import registry, urls


def test_links_resolve_against_the_page(spark):
    bases = ["http://a.org/x/y.html?q=1#f", "https://a.org", "http://a.org/x/"]
    targets = ["item.html", "next/", "?page=1", "../x", "../../../z", "./", "..", "a/./b/../c?u=../d", "/p/../q", "//b.net/es/1", "http://b.net/es/1", "/go?u=http://c.de/1"]
    rows = [(b, f"<link rel=canonical href='{t}'>") for b in bases for t in targets]
    got = urls.link_edges(spark.createDataFrame(rows, "url string, html string"))
    key = lambda u: u.replace("https://a.org?", "https://a.org/?").rstrip("/")
    assert sorted((r.source, key(r.target)) for r in got.collect()) == sorted((b, key(urljoin(b, t))) for b in bases for t in targets)


def test_all_tags_pass_blocks(spark):
    rows = [
        (1, "http://b.net/es/1", ""),
        (2, "http://b.net/x/2", "<link rel=canonical><link rel=canonical href='../es/1'>"),
        (3, "http://c.org/3", "<meta http-equiv=refresh content=5><meta http-equiv=refresh content='0; url=http://b.net/es/1'>"),
        (4, "http://c.org/4", "<link rel=canonical href=3>"),
        (5, "http://c.org/5", "<link rel=canonical href='#top'><link rel=canonical href='mailto:a@b.net'>"),
    ]
    got = urls.judge(spark.createDataFrame(rows, "page_id int, url string, html string"), registry.RULES).collect()
    assert {r.page_id: r.verdict for r in got} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}
