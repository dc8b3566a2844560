"""URL parsing and rules against plain Python, verdicts of the tree, and the edge cases of the docstring."""

import re

from fluxwarden.llm import url_templates

SF = "/root/testdata/sf0.01"


def plain(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_templates.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, None))
    return host, path, rule, verdict


def test_query(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()}
    rows = url_templates.query(spark, SF).collect()
    assert sorted(r.page_id for r in rows) == sorted(urls)
    for r in rows:
        host, path, rule, verdict = plain(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def test_templates_are_learned(spark):
    rows = []
    for k in range(400):
        rows += [(f"http://a.b/shop/{k}", 0), (f"http://a.b/spam/{k}", 1), (f"http://a.b/news/{k}", 0 if k % 9 else None)]
        rows += [(f"http://bad.b/{k}/x", 1), (f"http://new.b/{k}", None), (f"http://ok.b/{k}", 0)]
    frame = spark.createDataFrame([(k, u, b) for k, (u, b) in enumerate(rows)], "page_id bigint, url string, bad int")
    done = url_templates.filter_urls(frame).collect()
    verdicts = {(r.host, r.template): r.verdict for r in done}
    assert verdicts[("a.b", "/spam/*")] == "block"
    assert verdicts[("bad.b", "/*/*")] == "block"
    assert verdicts[("new.b", "/*")] == "allow"
    others = [v for (h, t), v in verdicts.items() if h == "a.b" and t != "/spam/*"]
    assert others and set(others) == {"allow"}
    assert len(done) == len(rows)


def test_edges(spark):
    deep = "http://d.e/" + "/".join("abcdefghijklmn") + "?q"
    urls = [None, "", "no scheme", "://", "HTTP://ÀB.Net", "x://EXAMPLE.com/de/x://y/de", "a://h?x/y", "a://h#/y", "a://notexample.com/de/", "a://s.org/fr/", deep, deep, "a://h/p q\nr?s"]
    frame = spark.createDataFrame([(k, u, None, "z") for k, u in enumerate(urls)], "page_id bigint, url string, bad int, host string")
    done = {r.page_id: r for r in url_templates.filter_urls(frame).collect()}
    assert sorted(done) == list(range(len(urls)))
    for k, u in enumerate(urls):
        host, path, rule, verdict = plain(u)
        assert (done[k].host, done[k].path, done[k].rule) == (host, path, rule), u
        assert done[k].verdict == (verdict or "allow")
    assert url_templates.filter_urls(frame.filter("page_id < 0")).count() == 0
