from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillmark.llm import reputation
from tillmark.llm.queries import URL_RULES

PAGES = "page_id long, url string, html string, host string, path string, verdict string, n long, bad long, weight double, suffix string"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "<p>", "h", "p", "v", 1, 1, 0.5, "s") for i, u in enumerate(urls)], PAGES)


def outcomes(spark, rows):
    return spark.createDataFrame(rows, "document long, bad int")


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if c < "\x7f" else c for c in host), path


def brute_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "no scheme", "http://", "http:///en/1", "https://Example.COM/en/12", "https://www.example.com/en/12?x=1#y", "https://a.WWW.example.com/en/",
    "https://notexample.com/en/5", "http://shop.net/es/9.html", "http://net/fr/", "http://shop.net/FR/3", "http://example.com", "http://example.com?en/", "http://example.com#/en/",
    "http://user:pw@host.example.com:8080/en/4", "http://a.b://c.com/en/3", "ftp://ÄÖ.com/x?y://z", "http://com/", "http://x.com.au/7", "http://10.1.2.3/8/", "x\n://h\nost.net/es/\n6", "http://com./1",
    "https://www.example.com/EN/1", "https://www.example.com/e", "http://example.com//en/1", "http://nets/es/1",
]


def test_hosts_paths_and_rules_equal_brute_force(spark):
    got = reputation.judge(pages(spark, URLS), outcomes(spark, []), URL_RULES).collect()
    assert len(got) == len(URLS)
    for row in got:
        host, path = brute_parts(URLS[row["page_id"]])
        rule, verdict = brute_rule(host, path)
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == (host, path, rule, verdict or "allow"), URLS[row["page_id"]]


@pytest.mark.parametrize(
    ("host", "domain", "suffix"),
    [("a.b.example.com", "example.com", "com"), ("example.com", "example.com", "com"), ("com", "com", "com"), ("x.y.co.uk", "y.co.uk", "co.uk"), ("u@a.x.org:80", "x.org", "org"),
     ("10.1.2.3:9", "10.1.2.3", "10.1.2.3"), ("a.x.org.", "x.org", "org"), ("", "", "")],
)
def test_domains_and_suffixes(spark, host, domain, suffix):
    found = reputation.domain_and_suffix(F.lit(host))
    assert tuple(spark.range(1).select(*found).first()) == (domain, suffix)


def reference(counts):
    """host -> (share, bound) from (host, domain, suffix, n, bad), level by level in numpy."""
    def weight(rows):
        y, n, m = (np.array(x, float) for x in zip(*rows, strict=True))
        room = (n * (n - 1) * m * (1 - m)).sum()
        low, high = reputation.CORRELATION
        rho = ((y - n * m) ** 2 - n * m * (1 - m)).sum() / room if room else high
        return 1 / min(high, max(low, rho)) - 1

    def total(key):
        out = {}
        for row in counts:
            n, bad = out.get(key(row), (0, 0))
            out[key(row)] = (n + row[3], bad + row[4])
        return out

    overall = (sum(r[4] for r in counts) + reputation.PRIOR) / (sum(r[3] for r in counts) + 1)
    share = {None: overall}
    for key, parent in ((lambda r: r[2], lambda k: None), (lambda r: (r[1], r[2]), lambda k: k[1]), (lambda r: r[:3], lambda k: k[1:3])):
        groups = total(key)
        w = weight([(bad, n, share[parent(k)]) for k, (n, bad) in groups.items()])
        share = share | {k: (bad + w * share[parent(k)]) / (n + w) for k, (n, bad) in groups.items()}
    out = {}
    for host, domain, suffix, n, _ in counts:
        p = share[host, domain, suffix]
        z = np.log(p / (1 - p)) - reputation.BOUND_Z * np.sqrt(1 / (p * (1 - p) * (n + w + 1)))
        out[host] = (p, 1 / (1 + np.exp(-z)))
    return out


def test_levels_shrink_as_the_reference_does_and_bounds_are_near_the_posteriors(spark):
    rng = random.Random(3)
    counts = []
    for suffix, base in (("com", 0.1), ("net", 0.2), ("biz", 0.6)):
        for d in range(12):
            domain, rate = f"d{d}.{suffix}", min(0.98, max(0.02, rng.gauss(base, 0.15)))
            for h in range(rng.randint(1, 6)):
                n = rng.choice([0, 1, 3, 20, 400])
                counts.append((f"h{h}.{domain}", domain, suffix, n, sum(rng.random() < rate for _ in range(n))))
    hosts = spark.createDataFrame([(r[0], r[3], r[4]) for r in counts], "host string, n long, bad long")
    got = {r["host"]: (r["bad_share"], r["bound"]) for r in reputation.reputations(hosts).collect()}
    want = reference(counts)
    assert set(got) == set(want)
    for host in want:
        assert got[host] == pytest.approx(want[host], rel=1e-9)
    # a good many outcomes: the lower bound is the 5 % quantile of the beta posterior, nearly
    draws = np.random.default_rng(1)
    for host, _, _, n, _ in counts:
        if n == 400:
            p, bound = got[host]
            exact = np.quantile(draws.beta(p * n, (1 - p) * n, 200_000), 0.05)
            assert bound == pytest.approx(exact, abs=0.02)


def test_bad_hosts_are_blocked_and_hosts_without_outcomes_follow_their_domain(spark):
    urls, labels = [], []
    for k in range(40):  # one domain all bad, one all good
        urls += [f"http://h{k % 4}.evil.biz/x/{k}", f"http://h{k % 4}.kind.biz/x/{100 + k}"]
        labels += [(k, 1), (100 + k, 0)]
    urls += ["http://new.evil.biz/unlabelled", "http://new.kind.biz/unlabelled", "http://alone.org/9999"]
    got = {r["host"]: r for r in reputation.judge(pages(spark, urls), outcomes(spark, labels), []).collect()}
    assert got["h1.evil.biz"]["verdict"] == "block" and got["h1.kind.biz"]["verdict"] == "allow"
    assert got["new.evil.biz"]["bad_share"] > 0.5 > got["new.kind.biz"]["bad_share"]
    assert got["alone.org"]["verdict"] == "allow"
    assert got["h1.evil.biz"]["bound"] > got["new.evil.biz"]["bound"]  # fewer outcomes, wider bound


def test_one_bad_outcome_does_not_block_a_host(spark):
    urls = [f"http://h{k}.site.com/{k}" for k in range(60)]
    labels = [(k, int(k == 7)) for k in range(60)]
    assert {r["verdict"] for r in reputation.judge(pages(spark, urls), outcomes(spark, labels), []).collect()} == {"allow"}


def test_hot_host_repeated_pages_nulls_and_empty_tables(spark):
    urls = ["http://hot.com/1"] * 500 + ["http://b.com/2", "http://b.com/x", None]
    labels = [(1, 0), (1, 1), (None, 1), (2, None), (2, 1)]
    rows = reputation.judge(pages(spark, urls), outcomes(spark, labels), URL_RULES).collect()
    assert len(rows) == 503 and sorted(r["page_id"] for r in rows) == list(range(503))
    hosts = {r["host"]: (r["n"], r["bad"]) for r in reputation.host_outcomes(
        pages(spark, urls).select("page_id", *(c.alias(n) for c, n in zip(reputation.host_and_path(F.col("url")), ("host", "path"), strict=True))).withColumn("document", reputation.document_of(F.col("path"))),
        outcomes(spark, labels)).collect()}
    assert hosts == {"hot.com": (1000, 500), "b.com": (1, 1), "": (0, 0)}
    assert reputation.judge(pages(spark, []), outcomes(spark, labels), URL_RULES).count() == 0
    assert reputation.judge(pages(spark, ["http://a.com/1", "http://b.org/" + "9" * 5000]), outcomes(spark, []), URL_RULES).count() == 2


@pytest.mark.parametrize(("path", "number"), [("/en/12", 12), ("/en/12/", 12), ("/en/12.html", 12), ("/en/", None), ("", None), ("/12/en", None), ("/" + "1" * 30, None), ("/a12", None)])
def test_document_numbers(spark, path, number):
    assert spark.range(1).select(reputation.document_of(F.lit(path))).first()[0] == number
