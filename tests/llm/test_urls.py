import math
import zlib

import numpy as np
import pytest

from chronoweave.llm import url_trees
from chronoweave.llm.queries import URL_RULES


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda f: len(f[0]), default=None)


URLS = [
    None, "", "no scheme", "http://", "http://A.Example.COM/en/7x?y=1#z", "https://example.com/en/8", "http://com/en/", "http://xcom/en/", "ftp://a.net/de/8", "http://b.example.net/de/81?x", "http://example.net/de/7", "http://ä.org/es/1",
    "http://ÄB.org/es/", "http://x.org#/es/", "http://x.org?q=http://y.com/en/", "mailto:http://a.com/en/1", "http://a.com\n/en/2", "http://a.org/es/\nq", "://h.com/en/", "http://user@h.com:80/en/", "http://example.com/EN/7",
]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "<p>", 3, 4) for i, u in enumerate(urls)], "page_id long, url string, html string, host int, rule int")


def test_hosts_paths_and_rules(spark):
    got = {r.page_id: r for r in url_trees.judge(pages(spark, URLS), URL_RULES).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule = brute(u)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0]), u
        assert r.verdict == rule[1] if rule else r.verdict in ("allow", "block")
        assert (r.block_score is None) == (rule is not None)


def test_longest_rule_wins(spark):
    rules = [("allow", "com", "/"), ("block", "a.com", "/"), ("allow", "a.com", "/x")]
    urls = ["http://b.com/", "http://a.com/q", "http://z.a.com/x1"]
    assert [r.verdict for r in url_trees.judge(pages(spark, urls), rules).orderBy("page_id").collect()] == ["allow", "block", "allow"]


def test_trees_learn():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    t = url_trees.Trees(depth=2).fit(x[:1000], y[:1000])
    assert ((t.predict(x[1000:]) > 0.5) == y[1000:]).mean() > 0.95


def test_held_out_urls(spark):
    r = np.random.default_rng(4)
    urls = []
    for i in range(600):
        bad = i % 2
        host = f"{'cheap-pills-' if bad else 'site'}{r.integers(1000)}.example.{'com' if bad else 'net'}"
        urls.append(f"http://{host}/{'en' if bad else 'de'}/{r.integers(1000)}{'?a=1&b=2' if bad else ''}")
    rules = [("block", "com", "/en/1"), ("allow", "net", "/de/1")]
    got = url_trees.judge(pages(spark, urls), rules).collect()
    free = [g for g in got if g.rule is None]
    right = sum((g.verdict == "block") == bool(g.page_id % 2) for g in free)
    assert len(free) > 400 and right / len(free) > 0.95


def test_labels_are_not_learned_from_themselves():
    # hosts of their own: a label says nothing about others, and rates that held it would tell
    r = np.random.default_rng(3)
    labelled = [(f"http://h{i}.x{i}.t{i}/{'a' * int(r.integers(9))}", f"h{i}.x{i}.t{i}", "/" + "a" * int(r.integers(9)), bool(r.integers(2))) for i in range(400)]
    filled = url_trees.Filter(labelled[:300])
    assert 0.3 < ((filled.blocked([x[:3] for x in labelled[300:]]) > 0.5) == np.array([x[3] for x in labelled[300:]])).mean() < 0.7
    # hosts that tell all: their rates are used
    told = [(f"http://h{i}.s.{'com' if bad else 'net'}/", f"h{i}.s.{'com' if bad else 'net'}", "/", bad) for i, bad in enumerate([True, False] * 100)]
    assert ((url_trees.Filter(told[:100]).blocked([x[:3] for x in told[100:]]) > 0.5) == np.array([x[3] for x in told[100:]])).all()


def brute_features(url, host, path, labelled, fold):
    """The features one by one; fold: the url's own fold, whose labels it mustn't see, or None."""
    out = [len(url), len(host), len(path)]
    query = url.split("?", 1)[1].split("#", 1)[0] if "?" in url else ""
    out += [len(query), len([p for p in path.split("/") if p]), sum(c.isdigit() for c in url) / max(1, len(url))]
    out += [-sum(s.count(c) / len(s) * math.log2(s.count(c) / len(s)) for c in set(s)) if s else 0 for s in (host, path)]
    out += [len([p for p in query.split("&") if p]), host.count("-"), len(host.split("."))]
    seen = [(h, b) for u, h, _, b in labelled if fold is None or zlib.crc32(u.encode()) % 5 != fold]
    mean = sum(b for _, b in seen) / len(seen)
    for cut in (1, 3):
        same = [b for h, b in seen if h.split(".")[-cut:] == host.split(".")[-cut:]]
        out.append((sum(same) + url_trees.SMOOTH * mean) / (len(same) + url_trees.SMOOTH))
    return out


def brute_boosting(x, y, new, rounds=40, depth=3, rate=0.2, bins=32, least=1.0, ridge=1.0):
    """Scores of new by trees that are grown row by row."""
    base = math.log(sum(y) / len(y) / (1 - sum(y) / len(y)))
    cuts = [sorted({float(np.quantile([r[f] for r in x], k / bins)) for k in range(1, bins)}) for f in range(len(x[0]))]
    score, out = [base] * len(x), [base] * len(new)

    def grow(rows, grad, hess, left):
        g, h = sum(grad[i] for i in rows), sum(hess[i] for i in rows)
        best, at = 1e-6, None
        for f in range(len(x[0])) if left else ():
            for c in cuts[f]:
                own = [i for i in rows if x[i][f] <= c]
                gl, hl = sum(grad[i] for i in own), sum(hess[i] for i in own)
                if hl >= least and h - hl >= least:
                    gain = gl * gl / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g * g / (h + ridge)
                    if gain > best + 1e-9:
                        best, at = gain, (f, c)
        if at is None:
            return lambda r: g / (h + ridge)
        f, c = at
        low, high = (grow([i for i in rows if (x[i][f] <= c) == side], grad, hess, left - 1) for side in (True, False))
        return lambda r: low(r) if r[f] <= c else high(r)

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        tree = grow(range(len(x)), [b - q for b, q in zip(y, p, strict=True)], [q * (1 - q) for q in p], depth)
        score = [s + rate * tree(r) for s, r in zip(score, x, strict=True)]
        out = [s + rate * tree(r) for s, r in zip(out, new, strict=True)]
    return [1 / (1 + math.exp(-s)) for s in out]


def test_verdicts_against_brute_force(spark):
    r = np.random.default_rng(9)
    urls = []
    for i in range(90):
        host = f"{'win-' * int(r.integers(3))}h{r.integers(9)}.example.{r.choice(['com', 'net', 'org'])}"
        urls.append(f"http://{host}/{r.choice(['en', 'de', 'es', 'fr/x'])}/{r.integers(2000)}{r.choice(['', '?q=1', '?q=1&z=22'])}")
    got = {g.page_id: g for g in url_trees.judge(pages(spark, urls), URL_RULES).collect()}
    known = sorted({(u, *brute(u)[:2], brute(u)[2][1] == "block") for u in urls if brute(u)[2]})
    free = [i for i, u in enumerate(urls) if not brute(u)[2]]
    assert len(known) > 15 and len(free) > 30
    x = [brute_features(*k[:3], known, zlib.crc32(k[0].encode()) % 5) for k in known]
    want = brute_boosting(x, [float(k[3]) for k in known], [brute_features(urls[i], *brute(urls[i])[:2], known, None) for i in free])
    assert [got[i].block_score for i in free] == pytest.approx(want, rel=1e-6)
    assert [got[i].verdict for i in free] == ["block" if w > 0.5 else "allow" for w in want]


def test_entropy_and_edges(spark):
    assert url_trees.entropy("") == 0 and url_trees.entropy("aabb") == 1 and url_trees.entropy("abcd") == pytest.approx(math.log2(4))
    assert url_trees.judge(pages(spark, ["x"]).where("false"), URL_RULES).collect() == []
    assert url_trees.judge(pages(spark, ["http://q.info/a", "http://q.info/a"]), URL_RULES).first().verdict == "allow"
    only = url_trees.judge(pages(spark, ["http://a.com/en/1", "http://q.info/a"]), URL_RULES)
    assert {r.verdict for r in only.collect()} == {"block"}
