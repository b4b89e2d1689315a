"""Operators on pages."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from wardspan.llm import page_difference, url_filter  # noqa: E402

SMALL = "/root/testdata/sf0.001"
URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y#z", "https://example.net/de/", "x://example.com/de/?a=1&b=2", "http://notexample.com/de/", "http://a.org/fr/1", "http://org/fr", "ftp://h.net", "http://é.net/" + "a/" * 3000, "http://x.com?q=://b.net/"]


def test_hosts_and_rules(spark):
    rows = [(i, u, "page's own") for i, u in enumerate(URLS + URLS[:3])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string").unionByName(spark.read.parquet(f"{SMALL}/pages.parquet").selectExpr("page_id + 1000 as page_id", "url", "'x' as host"))
    url = {r["page_id"]: r["url"] for r in pages.collect()}
    got = url_filter.verdicts(pages).collect()
    assert len(got) == len(url)
    for r in got:
        host, path = brute.host_path(url[r["page_id"]])
        rule = brute.rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), url[r["page_id"]]
        assert r["verdict"] in ("allow", "block") and (rule is None or r["verdict"] == dict(url_filter.RULES)[rule])
        assert (r["score"] is None) == (rule is not None)


def test_url_trees_learn(spark):
    """Held-out URLs of two plain kinds are told apart."""
    rng = random.Random(4)
    name = lambda a: "".join(rng.choice(a) for _ in range(8))
    rules = (("bad.test/", "block"), ("good.test/", "allow"))
    rows = []
    for i in range(600):
        bad = i % 2 == 0
        site = ("bad" if bad else "good") if i < 400 else "new"
        rows.append((i, f"http://{name('abcdef')}.{site}.test/" + (f"{name('0123456789')}?a=1&b=2&c=3" if bad else f"{name('abcdef')}/{name('abcdef')}/{name('abcdef')}")))
    got = url_filter.verdicts(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).where("rule is null").collect()
    assert len(got) == 200 and sum((r["verdict"] == "block") == (r["page_id"] % 2 == 0) for r in got) >= 190


def test_urls_without_labels(spark):
    none = spark.createDataFrame([(1, "http://x.com/a"), (2, None)], "page_id long, url string")
    assert [r["verdict"] for r in url_filter.verdicts(none).collect()] == ["allow", "allow"]
    assert url_filter.verdicts(none.limit(0)).count() == 0


def test_zones():
    page = """<!doctype html><html><head><title>t</title><style>p{}</style></head><body class="ad"><header>Site</header><div class="cookie-notice">We use</div>
      <article><header><h1>T &amp; t&nbsp;x</h1></header><p>One<br>two<p>Three <b>bo</b>ld<ul><li>a<li>b</ul><aside>no</aside><script>var a="</p>";</script>
      <div id="comments"><p>nice</p></div><table><tr><td>1<td>2</table><form><p>mail</form></article><footer>f</footer>"""
    lines = page_difference.lines_of(page)
    assert page_difference.main_text(lines, set()) == "T & t x\n\nOne two\n\nThree bold\n\na\n\nb\n\n1 2"
    for odd in (None, "", "<", "<p", "<p class='x", "<!--", "<script>x", "a < b", "</p></p>", "<article>" * 50 + "x"):
        page_difference.lines_of(odd)


def test_common_lines():
    rng = random.Random(6)
    for _ in range(60):
        a, b = [[rng.choice("abcde") for _ in range(rng.randrange(25))] for _ in range(2)]
        pairs = page_difference.common_lines(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) == brute.lcs(a, b)
        assert all(p < q for p, q in zip([i for i, _ in pairs], [i for i, _ in pairs[1:]], strict=False)) and all(p < q for p, q in zip([j for _, j in pairs], [j for _, j in pairs[1:]], strict=False))


def test_differencing(spark):
    frame = lambda body: f"<div>Menu of the site</div><div>{body}</div><div>Written by nobody</div>"
    rows = [(i, f"http://h.test/p/{i}", frame(f"Body number {i} which is long enough to be the main text of its page")) for i in range(30)]
    rows += [(100, "http://lone.test/", frame("Alone on its host")), (101, None, frame("No url")), (102, None, None), (103, "http://h.test/p/99", "")]
    rows += [(200, "http://c.test/1", "<p>Copied text of both pages, all of it</p>"), (201, "http://c.test/2", "<p>Copied text of both pages, all of it</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in page_difference.extracted(pages, page_difference.Settings(block_pages=10)).collect()}
    assert len(got) == len(rows)
    assert sum(got[i]["text"] == f"Body number {i} which is long enough to be the main text of its page" for i in range(30)) >= 29
    assert got[100]["text"].startswith("Menu of the site\n\nAlone") and got[101]["text"].startswith("Menu")
    assert got[102]["text"] == got[103]["text"] == "" and got[200]["text"] == got[201]["text"] == "Copied text of both pages, all of it"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert page_difference.extracted(pages.limit(0)).count() == 0


def test_common_lines_of_many_repeats():
    # 4.2 million matching pairs: the short line leads on one side and stands after 100 repeats on the other
    a = ["x"] * 100 + ["s"] + ["x"] * 2000
    b = ["s"] + ["x"] * 2000
    pairs = page_difference.common_lines(a, b)
    assert len(pairs) == 2001
    assert pairs[0] == (100, 0) and all(a[i] == b[j] for i, j in pairs)


def test_neighbours_do_not_depend_on_the_size_of_the_host(spark):
    """Sections of two pages share a banner: the pages meet wherever the host is cut, also next to repeated rows."""
    page = lambda i: f"<div>Banner of section {i // 2}</div><div>Body number {i} which is long enough to be the main text of its page</div>"
    rows = [(i, f"http://h.test/{i // 2:03}/{i % 2}", page(i)) for i in range(300)] + [(None, "http://h.test/a/", "<p>x y</p>")] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {n: sorted(map(tuple, page_difference.extracted(pages, page_difference.Settings(block_pages=n)).collect()), key=str) for n in (3, 7, 1_000)}
    assert got[3] == got[7] == got[1_000] and len(got[7]) == len(rows)
    assert not any("Banner" in text for _, _, text, _ in got[7])
