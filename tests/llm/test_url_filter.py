"""Rules by re-reading the contract, reputation against a plain computation, edge cases."""

import math
import random
from collections import Counter, defaultdict

from timelens.llm import url_filter as uf

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c, 1)[0]
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in host), path


def rule(host, path):
    fits = [(len(h + p), h + p, does) for does, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def judged(spark, pages, outcomes):
    frame = spark.createDataFrame([(i, u, "x", "y") for i, u in pages], "page_id long, url string, host string, key string")
    return uf.url_filter(frame, spark.createDataFrame(outcomes, "key long, bad int")).collect()


def test_rules_and_parts(spark):
    rng = random.Random(3)
    pieces = ["http", "://", "Example.NET", "example.com", "a.org", "net", "xnet", "/", "/en/", "/de/", "/fr/x", "?", "#", "É", "Ö.net", "7", ".html", "@", ":80", ".", ""]
    pages = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 7)))) for i in range(500)] + [(900, None), (901, ""), (902, "://"), (903, "http://net"), (904, "http://a.EXAMPLE.net/en/1"), (905, "x" * 40_000 + "://net/"), (905, "x" * 40_000 + "://net/"), (None, "http://b.net/")]
    got = judged(spark, pages, [])
    assert len(got) == len(pages)
    urls = defaultdict(set)
    for i, u in pages:
        urls[i].add(u)
    for r in got:
        u = next(iter(urls[r["page_id"]]))
        host, path = parts(u)
        named, does = rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, named), u
        assert r["verdict"] == (does or "allow"), u


def strength(groups):
    groups = [(n, b) for n, b in groups if n]
    if len(groups) < 2:
        return uf.MOST_STRENGTH
    n, bad, g = sum(x[0] for x in groups), sum(x[1] for x in groups), len(groups)
    mean = bad / n
    spread = g * (sum(b * b / m for m, b in groups) - bad * mean) / ((g - 1) * n)
    excess = spread - mean * (1 - mean) * sum(1 / m for m, _ in groups) / g
    return uf.MOST_STRENGTH if excess <= 0 else min(uf.MOST_STRENGTH, max(uf.LEAST_STRENGTH, (mean * (1 - mean) - spread) / excess))


def test_reputation(spark):
    """Verdicts without a rule follow the posterior bounds of a plain computation; some hosts are blocked, and rules still win."""
    rng = random.Random(7)
    hosts = [f"{s}.{d}" for d in ("good.com", "bad.com", "mixed.co.uk", "new.co.uk", "lone.fr") for s in ("a", "b", "c")]
    rate = {h: 0.95 if "bad" in h else 0.5 if "mixed" in h else 0.05 for h in hosts}
    pages = [(i, f"http://{rng.choice(hosts)}/x/{i}") for i in range(900)] + [(2000 + i, f"http://new.host.fr/{i}a") for i in range(3)]
    outcomes = [(i, int(rng.random() < rate[parts(u)[0]])) for i, u in pages if i < 900 and rng.random() < 0.6 and "new" not in u] + [(None, 1), (5000, 1)]
    outcomes += outcomes[:20]
    label = {}
    for k, b in outcomes:
        if k is not None:
            label[k] = max(b, label.get(k, 0))
    n, bad = Counter(), Counter()
    for i, u in pages:
        h = parts(u)[0]
        n[h] += i in label
        bad[h] += label.get(i, 0)
    two = lambda h: ".".join(h.split(".")[-2:])
    suffix = lambda h: two(h) if two(h) in uf.TWO_LABEL_SUFFIXES else h.split(".")[-1]
    domain = lambda h: ".".join(h.split(".")[-3:]) if two(h) in uf.TWO_LABEL_SUFFIXES else two(h)
    levels = {}
    for name, of in (("s", suffix), ("d", domain)):
        sums = defaultdict(lambda: [0, 0])
        for h in {parts(u)[0] for _, u in pages}:
            sums[of(h)][0] += n[h]
            sums[of(h)][1] += bad[h]
        levels[name] = sums
    base = (sum(bad.values()) + 0.5) / (sum(n.values()) + 1)
    ms, md, mh = strength(levels["s"].values()), strength(levels["d"].values()), strength([(n[h], bad[h]) for h in n])
    verdict = {}
    for h in n:
        s, d = levels["s"][suffix(h)], levels["d"][domain(h)]
        ps = (ms * base + s[1]) / (ms + s[0])
        pd = (md * ps + d[1]) / (md + d[0])
        a, b = mh * pd + bad[h], mh * (1 - pd) + n[h] - bad[h]
        verdict[h] = "block" if a / (a + b) - uf.Z * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) > uf.MAX_BAD else "allow"
    got = judged(spark, pages, outcomes)
    assert len(got) == len(pages) and {r["verdict"] for r in got} == {"allow", "block"}
    assert all(r["verdict"] == verdict[r["host"]] and r["host_labels"] == n[r["host"]] for r in got)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert uf.query(spark, str(tmp_path)).collect() == []
