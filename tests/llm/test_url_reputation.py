from textloom.llm import url_reputation as U

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
URLS = [
    None, "", "no scheme", "http://A.Example.NET/en/x?y", "http://a.example.net/EN/", "https://net", "https://net/", "http://x.org/fr/1#z", "http://notexample.com/de/",
    "http://sub.example.com/de/", "http://example.com?x=/de/", "ftp://h:80/p?q://r", "http://a//b", "x://\n/y\nz", "http://b.bad.io/1", "http://good.io/1",
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, None)))


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(URLS)], "page_id long, url string, html string, host string")
    # Many bad pages of one host.
    more = spark.createDataFrame([(100 + i, f"http://b.bad.io/{i}", "", "") for i in range(40)] + [(200 + i, f"http://h{i}.good.io/{i}", "", "") for i in range(60)], pages.schema)
    outcomes = spark.createDataFrame([(100 + i, 1) for i in range(40)] + [(200 + i, 0) for i in range(60)] + [(None, 1), (14, None)], "page_id long, bad int")
    got = {r.page_id: r for r in U.judge_urls(pages.union(more), outcomes).collect()}
    assert len(got) == len(URLS) + 100
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        if verdict:
            assert got[i].verdict == verdict
    assert got[14].verdict == "block" and got[15].verdict == "allow" and got[0].verdict == "allow"
    assert got[150 - 40].bound < 1


def test_shrinkage(spark):
    rows = [("a.x.com", 1)] + [("b.x.com", i % 2) for i in range(100)] + [("c.y.com", 0)] * 100
    got = {r.host: r for r in U.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert 0.4 < got["a.x.com"].rate < 1 and got["c.y.com"].rate < 0.1 and abs(got["b.x.com"].rate - 0.5) < 0.05
    assert all(r.bound < r.rate for r in got.values())


def world(bad_domain, bad_suffix, own):
    """Outcomes of good and bad hosts under five suffixes, of the siblings of q.dom.zz, and its own. Nine in ten outcomes of
    a bad part are bad, one in ten of a good one."""
    outcome = lambda bad, k: int((k % 10 < 9) == bad)
    rows = [(f"h{i}.d{i % 7}.s{i % 5}", outcome(i % 5 == 0, 7 * i + k)) for i in range(200) for k in range(6)]
    rows += [(f"x{i}.other{i % 9}.zz", outcome(bad_suffix, 7 * i + k)) for i in range(120) for k in range(6)]
    rows += [(f"y{i}.dom.zz", outcome(bad_domain, 7 * i + k)) for i in range(30) for k in range(6)]
    return rows + [("q.dom.zz", b) for b in own]


def verdict(spark, rows):
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, (h, _) in enumerate(rows)], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(rows)], "page_id long, bad int")
    return {r.verdict for r in U.judge_urls(pages, outcomes).where("host = 'q.dom.zz'").collect()}


def test_host_domain_and_suffix_each_decide(spark):
    """The same host with all else equal: its own outcomes, its domain's or its suffix's turn the verdict."""
    assert verdict(spark, world(False, False, [0])) == {"allow"}
    assert verdict(spark, world(False, False, [1] * 60)) == {"block"}
    assert verdict(spark, world(True, False, [0])) == {"block"}
    assert verdict(spark, [r for r in world(False, True, [1]) if not r[0].startswith("y")]) == {"block"}
    assert verdict(spark, [r for r in world(False, False, [1]) if not r[0].startswith("y")]) == {"allow"}


def test_suffixes_of_two_labels(spark):
    rows = [("www.shop.co.uk", 1), ("shop.co.uk", 0), ("a.b.com", 0), ("co.uk", 1), ("com", 0), (None, 1), ("", 1), ("x.y", None)]
    got = {r.host: (r.domain, r.suffix) for r in U.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got == {"www.shop.co.uk": ("shop.co.uk", "co.uk"), "shop.co.uk": ("shop.co.uk", "co.uk"), "a.b.com": ("b.com", "com"), "co.uk": ("co.uk", "co.uk"), "com": ("com", "com")}


def test_very_long_urls(spark):
    url = "http://" + "a." * 50_000 + "org/fr/" + "x" * 300_000
    pages = spark.createDataFrame([(1, url)], "page_id long, url string")
    r = U.judge_urls(pages, spark.createDataFrame([(1, 1)], "page_id long, bad int")).first()
    assert r.rule == "org/fr/" and r.verdict == "allow" and len(r.path) == 300_004


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    outcomes = spark.createDataFrame([], "page_id long, bad int")
    assert U.judge_urls(pages, outcomes).count() == 0
    one = spark.createDataFrame([(1, "http://a.b/c"), (1, "http://a.b/c")], pages.schema)
    assert [r.verdict for r in U.judge_urls(one, outcomes).collect()] == ["allow", "allow"]
