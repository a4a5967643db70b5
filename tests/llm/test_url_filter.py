import random

from auditloom.llm import url_filter
from auditloom.llm.components import connected_components
from auditloom.llm.queries import URL_RULES


def rules(spark):
    return spark.createDataFrame(URL_RULES, "host string, path string, verdict string")


def judged(spark, pages, edges=None):
    rows = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    links = spark.createDataFrame(edges, "from_url string, to_url string") if edges else None
    return {r.page_id: r for r in url_filter.filter_urls(rows, rules(spark), links).collect()}


def test_hosts_paths_and_rules(spark):
    found = judged(spark, [
        (1, "http://WWW.Example.NET/en/x?q#f", None), (2, "https://a.net", ""), (3, "http://a.net/?x", ""), (4, None, None),
        (5, "no scheme", ""), (6, "http://notexample.com/de/", ""), (7, "http://m.example.com/de/1", ""),
        (8, "http://example.com/De/1", ""), (9, "x://org/fr/", ""), (10, "http://h?a://b/c", ""), (11, "http://ÄB.net/Ä", ""),
    ])
    assert (found[1].host, found[1].path, found[1].rule, found[1].verdict) == ("www.example.net", "/en/x", "example.net/en/", "allow")
    assert (found[2].host, found[2].path, found[2].rule) == ("a.net", "", None)
    assert (found[3].rule, found[3].verdict) == ("net/", "block")
    assert (found[4].host, found[4].path, found[4].verdict) == ("", "", "allow")
    assert found[5].host == ""
    assert found[6].rule is None
    assert found[7].verdict == "block"
    assert found[8].rule is None
    assert found[9].rule == "org/fr/"
    assert (found[10].host, found[10].path) == ("h", "")
    assert found[11].host == "Äb.net"


def test_aliases_get_decisions_and_allow_wins(spark):
    canonical = '<link href="http://bad.net/a" rel="canonical">'
    refresh = "<META http-equiv='Refresh' content='0; URL=/old'>"
    found = judged(
        spark,
        [
            (1, "http://one.com/p", canonical), (2, "http://two.com/p", '<link rel=canonical href=http://one.com/p>'),
            (3, "http://three.com/new", refresh), (4, "http://three.com/old", ""), (5, "http://free.com/x", ""),
            (6, "http://kind.com/x", '<link rel="canonical" href="//x.org/fr/y">'), (7, "http://one.com/p#frag", ""),
        ],
        [("http://kind.com/x", "http://worse.net/z"), ("http://three.com/old", "http://m.example.com/de/9"), (None, "x")],
    )
    verdicts = {k: (r.verdict, r.by) for k, r in found.items()}
    assert verdicts[1] == verdicts[2] == verdicts[7] == ("block", "alias")
    assert verdicts[3] == verdicts[4] == ("block", "alias")
    assert verdicts[5] == ("allow", "default")
    assert verdicts[6] == ("allow", "alias")


def test_repeated_rows_and_no_pages(spark):
    page = (1, "http://a.net/", "<p>")
    rows = spark.createDataFrame([page, page], "page_id bigint, url string, html string")
    assert url_filter.filter_urls(rows, rules(spark)).count() == 2
    assert url_filter.filter_urls(rows.where("false"), rules(spark)).count() == 0
    none = rules(spark).where("false")
    assert {r.verdict for r in url_filter.filter_urls(rows, none).collect()} == {"allow"}


def test_components_against_union_find(spark):
    random.seed(5)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 480)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    rows = connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.id: r.component for r in rows} == {x: find(x) for x in list(parent)}
    assert len(rows) == len(parent)
