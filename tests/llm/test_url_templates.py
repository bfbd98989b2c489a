"""The URL filter against a plain tree."""

import math
import random
import re

from stockloom.llm import queries, url_templates
from pyspark.sql import functions as F

PAGES = "page_id bigint, url string, good boolean, host int, path int, template string, segments string, n int"
RULES = queries.URL_RULES


def _table(spark, rows):
    return spark.createDataFrame([(i, u, g, 1, 2, "t", "s", 3) for i, u, g in rows], PAGES)


def _parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host):])[0]


def _rule(host, path):
    fits = [
        (len(r), r, v) for v, r in RULES
        if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])
    ]
    return max(fits)[1:] if fits else (None, None)


def _mask(path, depth):
    if not path:
        return ()
    own = path.split("/")[1:]
    out = []
    for s in own[: depth - 1] if len(own) > depth else own:
        if len(s) >= 8 and re.fullmatch("[0-9a-fA-F-]+", s) and re.search("[0-9]", s) and re.search("[a-fA-F]", s):
            out.append("<hex>")
        else:
            out.append(re.sub("[0-9]+", "#", re.sub("[{}|*<>]", "~", s)))
    return tuple(out + ["**"]) if len(own) > depth else tuple(out)


def _kind(s):
    if s is None:
        return 0
    return 1 if s == "" else 2 if s == "#" else 3 if "#" in s else 4 if s == "<hex>" else 5 if "." in s else 6


def _alike(a, b, alpha):
    width = math.sqrt(0.5 * math.log(2 / alpha))

    def agree(x, n, y, m):
        return not n or not m or abs(x / n - y / m) <= width * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    k, j = a["good"] + a["bad"], b["good"] + b["bad"]
    return agree(a["good"], k, b["good"], j) and all(agree(x, a["n"], y, b["n"]) for x, y in zip(a["goes"], b["goes"]))


def _tree(rows, depth, alpha=0.05, strength=8.0, prior=0.5):
    """Template and purity by host and masked path, one node after the other."""
    leaves = {}
    for _, u, g in rows:
        host, path = _parts(u)
        leaf = leaves.setdefault((host, _mask(path, depth)), [0, 0, 0])
        leaf[0] += 1
        leaf[1] += g is True
        leaf[2] += g is False
    good, bad = sum(x[1] for x in leaves.values()), sum(x[2] for x in leaves.values())
    whole, out = (good + prior * strength) / (good + bad + strength), {}

    def smooth(own, parent):
        return (sum(x[1] for x in own.values()) + parent * strength) / (sum(x[1] + x[2] for x in own.values()) + strength)

    def grow(own, at, template, purity):
        for k in [k for k in own if len(k[1]) <= at]:
            out[k] = (template, purity)
        own = {k: v for k, v in own.items() if len(k[1]) > at}
        children = {}
        for k, (n, g, b) in own.items():
            c = children.setdefault(k[1][at], {"n": 0, "good": 0, "bad": 0, "goes": [0] * 7})
            c["n"], c["good"], c["bad"] = c["n"] + n, c["good"] + g, c["bad"] + b
            c["goes"][_kind(k[1][at + 1] if len(k[1]) > at + 1 else None)] += n
        total = sum(c["n"] for c in children.values())
        groups = []
        for s, c in sorted(children.items(), key=lambda x: (-x[1]["n"], x[0])):
            if c["n"] >= 8 and c["n"] * 64 >= total:
                for names, g in groups:
                    if _alike(g, c, alpha):
                        names.append(s)
                        g.update(n=g["n"] + c["n"], good=g["good"] + c["good"], bad=g["bad"] + c["bad"], goes=[x + y for x, y in zip(g["goes"], c["goes"])])
                        break
                else:
                    groups.append(([s], dict(c)))
        name = {s: names[0] if len(names) == 1 else "{" + "|".join(sorted(names)) + "}" for names, _ in groups for s in names}
        for branch in {name.get(s, "*") for s in children}:
            part = {k: v for k, v in own.items() if name.get(k[1][at], "*") == branch}
            grow(part, at + 1, f"{template}/{branch}", smooth(part, purity))

    for host in {h for h, _ in leaves}:
        own = {k: v for k, v in leaves.items() if k[0] == host}
        grow(own, 0, "", smooth(own, whole))
    return out


def _judged(df, **options):
    return url_templates.judge(df, RULES, good=F.col("good"), **options).collect()


def test_verdicts_equal_a_plain_tree(spark):
    draw = random.Random(9)
    hosts = ["a.example.com", "B.example.net", "c.example.org", "net", "x.net", "notexample.net", "org"]
    rows = []
    for i in range(3000):
        host = hosts[min(int(draw.expovariate(0.7)), 6)]
        kind = draw.random()
        if kind < 0.4:
            path, good = f"/{draw.choice(['en', 'de', 'fr'])}/{draw.randint(1, 900)}{draw.choice(['', '/', '.html'])}", draw.random() < 0.9
        elif kind < 0.6:
            path, good = f"/promo/{draw.choice(['win', 'bet'])}/{draw.randint(1, 99)}", draw.random() < 0.05
        elif kind < 0.8:
            path, good = f"/tag/word{draw.choice('abcdefghij')}{draw.choice('klmnopqrstuv')}x", True
        else:
            path, good = f"/f/{draw.randint(1, 2**48):012x}aa1/{'z/' * draw.randint(0, 6)}", draw.random() < 0.5
        rows.append((i, f"https://{host}{path}{draw.choice(['', '?q=/x', '#/top'])}", good if draw.random() < 0.5 else None))
    rows += [(4000, None, True), (4001, "no host", False), (4002, "http://", None), (4003, "http://net", None), (4004, "http://net/", None),
             (4005, "http://A.Org?x=://b.net/", None), (4006, "http://org/fr/{a|b}*<c>/é\n\t", None), (4007, "http://x.org/" + "s/" * 5000, None),
             (4008, "http://x.org/" + "y" * 200_000, None), (None, "http://a.example.com/en/7", True), (5, rows[5][1], rows[5][2])]
    want = _tree(rows, 5)
    got = _judged(_table(spark, rows).repartition(5), depth=5)
    assert sorted((str(r.page_id), r.host, r.path) for r in got) == sorted((str(i), *_parts(u)) for i, u, _ in rows)
    blocked = 0
    for r in got:
        template, purity = want[(r.host, _mask(r.path, 5))]
        rule, verdict = _rule(r.host, r.path)
        assert (r.template, r.rule) == (template, rule) and abs(r.purity - purity) < 1e-12
        assert r.verdict == (verdict or ("block" if purity < 0.5 else "allow"))
        blocked += rule is None and r.verdict == "block"
        if rule is None and r.path.startswith("/promo") and r.host == "a.example.com":
            assert r.verdict == "block"
    assert blocked and any("{" in t for t, _ in want.values()) and any("*" in t for t, _ in want.values())


def test_without_labels_or_rows(spark):
    rows = [(i, f"http://h{i % 3}.org/a/{i}", None) for i in range(50)]
    assert {(r.verdict, r.purity) for r in url_templates.judge(_table(spark, rows)).collect()} == {("allow", 0.5)}
    assert _judged(_table(spark, [])) == []


def test_longest_rule_wins(spark):
    urls = {"https://q.example.net/en/1": "example.net/en/", "https://q.example.net/de/1": "net/", "https://example.net": None,
            "ftp://EXAMPLE.com/de/": "example.com/de/", "http://myexample.com/de/": None, "http://w.org/fr/x": "org/fr/", "http://worg/fr/x": None}
    got = _judged(_table(spark, [(i, u, None) for i, u in enumerate(urls)]))
    assert {r.page_id: r.rule for r in got} == dict(enumerate(urls.values()))
