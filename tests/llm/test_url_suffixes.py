"""Suffix shares of the URL filter."""

from wardspan.llm import url_filter


def test_every_site_keeps_its_share(spark):
    """With thousands of sites, a URL follows the labelled URLs of its own site."""
    rules = (("test/a/xy/", "block"), ("test/a/yx/", "allow"))
    rows = []
    for site in range(4000):
        host = f"http://s{site:04d}.test/a/"
        rows += [(5 * site + i, host + ("xy/" if site % 2 else "yx/") + str(i)) for i in range(4)]
        rows.append((5 * site + 4, host + "zz/4"))
    df = url_filter.verdicts(spark.createDataFrame(rows, "page_id long, url string"), rules=rules)
    got = df.where("rule is null").collect()
    assert len(got) == 4000
    assert sum((r["verdict"] == "block") == (r["page_id"] // 5 % 2 == 1) for r in got) == 4000


def test_shares_joined_by_a_shuffle(spark, monkeypatch):
    """The same scores whether shares are broadcast or not."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url")
    want = sorted(map(tuple, url_filter.verdicts(pages).collect()))
    monkeypatch.setattr(url_filter, "_BROADCAST_ROWS", 0)
    assert sorted(map(tuple, url_filter.verdicts(pages).collect())) == want
