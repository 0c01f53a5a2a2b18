import re

import pytest

from veracta.llm import url_filters as U

URLS = [
    "http://example.org/es/1", "https://www.Example.ORG/en/12?x=1", "http://example.org/en/2#t", "http://a.com/fr/", "http://a.com/de/x", "http://a.com/en", "http://com/fr/9", "http://org", "http://org/", "ftp://X.net/a?b://c", "no scheme", "", None, "http://notexample.org/es/1", "://h/p",
    "http://sub.a.com/en/1", "http://b.com/de/1", "http://c.b.com/x", "http://t.org/1", "http://q.t.org/x#",
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in U.RULES:
        own, _, tail = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best and best[1], best and best[0]


def ranks(seeds, edges, rounds=U.ROUNDS, d=U.DAMPING):
    out, score = {}, dict(seeds)
    for a, _, w in edges:
        out[a] = out.get(a, 0) + w
    for _ in range(rounds):
        new = {h: (1 - d) * m for h, m in seeds.items()}
        for a, b, w in edges:
            new[b] = new.get(b, 0) + d * score.get(a, 0) * w / out[a]
        score = new
    return score


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, None, "extra") for i, u in enumerate(URLS)], "page_id long, url string, html string, verdict string")
    got = {r.page_id: r for r in U.judged(pages).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        if verdict:
            assert got[i].verdict == verdict
    assert {got[i].verdict for i in (10, 11, 12)} == {"allow"}


def test_scores_are_those_of_the_plain_iteration(spark):
    links = {"http://a.com/de/1": ["b.net", "c.net"], "http://b.net/": ["c.net", "c.net", "a.com"], "http://c.net/": ["a.com"], "http://t.org/": ["d.net", "c.net"], "http://d.net/": [], "http://x.d.net/": ["unknown.net"]}
    pages = spark.createDataFrame([(i, u, "".join(f'<a href="http://{h}/p">' for h in hs)) for i, (u, hs) in enumerate(links.items())], "page_id long, url string, html string")
    got = {r.host: (r.trust, r.distrust, r.verdict) for r in U.judged(pages).collect()}
    known = {brute(u)[0] for u in links}
    weight = {}
    for u, hs in links.items():
        for h in hs:
            if h in known:
                weight[(brute(u)[0], h)] = weight.get((brute(u)[0], h), 0) + 1.0
    for a, b in (("x.d.net", "d.net"), ("d.net", "x.d.net")):
        weight[(a, b)] = weight.get((a, b), 0) + 1.0
    trust = ranks({"t.org": 1.0}, [(a, b, w) for (a, b), w in weight.items()])
    distrust = ranks({"a.com": 1.0}, [(b, a, w) for (a, b), w in weight.items()])
    for h in known:
        assert got[h][0] == pytest.approx(trust.get(h, 0), abs=1e-9) and got[h][1] == pytest.approx(distrust.get(h, 0), abs=1e-9)
    assert got["b.net"][2] == "block" and got["d.net"][2] == "allow"


def test_verdicts_of_reached_hosts_do_not_depend_on_the_size(spark):
    """A host that distrust reaches through its parent stays blocked beside a million blocked pages elsewhere."""
    own = ["http://s.p.com/de/1", "http://p.com/"] + [f"http://t{i}.p.com/en" for i in range(100)]
    few = spark.createDataFrame([(i, u, None) for i, u in enumerate(own)], "page_id long, url string, html string")
    many = few.union(spark.range(1000, 1_001_000).selectExpr("id", "'http://big.com/de/' || id", "cast(null as string)"))
    for pages in (few, many):
        got = {r.host: r for r in U.judged(pages).where("page_id < 1000").collect()}
        assert {got[h].verdict for h in got} == {"block"} and len(got) == 102
    assert 0 < got["t3.p.com"].distrust < 1e-8


def test_empty_tables(spark):
    assert U.judged(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
