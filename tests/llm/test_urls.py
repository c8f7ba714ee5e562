"""Url components against a plain version and against the registered SQL: chains, cycles, a hub, far targets, relative links."""

import random
import re
from html import unescape

import duckdb
import pytest

from paperloom.llm import url_filter

HOSTS = ["a.com", "b.net", "www.c.org", "example.com", "example.net", "deep.example.com", "d.test", "e.test", "f.test"]
PATHS = ["/en/7", "/en/70x", "/de/8", "/es/1", "/x", "/x/y", "", "/", "/en", "/de"]


def pages(seed, n=160):
    rng = random.Random(seed)
    urls = [f"{rng.choice(['http', 'https', 'HTTP'])}://{rng.choice(HOSTS)}{rng.choice(PATHS)}{rng.choice(['', '?id=1', '?id=2', '#f'])}" for _ in range(n)]
    out = []
    for k, u in enumerate(urls):
        target = rng.choice([rng.choice(urls), f"http://far.com{rng.choice(PATHS)}", "/en/7", "?id=9", "#here", "z", "//d.test/q", "http://hub.test/"])
        tag = rng.choice(['<link rel="canonical" href="{}">', "<META http-equiv=refresh content='0;url={}'>", "<a href='{}'>"])
        out.append((k, u, rng.choice([None, "<p>", "<p>", tag.format(target)])))
    # A chain, a cycle, and a hub.
    out += [(500 + k, f"http://chain.test/{k}", f'<link rel=canonical href="http://chain.test/{k + 1}">') for k in range(30)]
    out += [(530, "http://chain.test/30", '<link href="http://z.org/es/" rel="canonical">')]
    out += [(600 + k, f"http://cycle.test/{k}", f'<link rel=canonical href="/{(k + 1) % 9}">') for k in range(9)]
    out += [(700 + k, f"http://spoke.test/{k}", '<link rel=canonical href="http://hub.test/">') for k in range(40)]
    out += [(800, "http://foo.test/a", '<link rel=canonical href="http://foo.com/en">'), (801, "http://b.test/y?id=1", None), (802, "http://b.test/y?id=2", '<link rel=canonical href="http://q.com/en/1">')]
    out += [(810, "http://k.test/a", '<LINK REL="CANONical" HREF="http://z.org/es/1">'), (811, "http://k.test/b?x=1", '<link rel=canonical href="http://z.org/es/?a=1&amp;b=2">')]
    out += [(812, "http://c.test/d/e", '<link rel=canonical href="../f">'), (813, "http://c.test/f", '<link rel=canonical href="http://z.org/x/../es/y">'), (814, "http://bare.test", None), (815, "http://bare.test/q", '<link rel=canonical href="http://bare.test/">'), (816, "http://bare.test/", '<link rel=canonical href="http://z.org/es/9">')]
    out += [(817, "http://base.test/a/b", '<base href="http://z.org/es/"><link rel=canonical href="c">'), (818, "http://base.test/a/c", '<base href="../"><link rel=canonical href="./q">'), (819, "http://base.test/q", '<link rel=canonical href="http://z.org/es/z">')]
    return [*out, (900, None, None), (901, "none", "<p>"), (902, "://x.com/en/1", None), (500, "http://chain.test/0", None)]


def plain(rows):
    def split(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]

    def key(u):
        host, _ = split(u)
        if not host:
            return None
        scheme, rest = u.split("://", 1)
        path, mark, query = rest[len(host) :].split("#")[0].partition("?")
        kept, parts = [], path.split("/")[1:]
        for part in parts:
            if part == "..":
                kept = kept[:-1]
            elif part != ".":
                kept.append(part)
        tail = "/".join([*kept, *([""] if parts and parts[-1] in (".", "..") else [])])
        return f"{scheme.lower()}://{host}/{tail}{mark}{query}"

    def joined(u, target):
        """Dot segments stay, as a rule looks at the path as it is written."""
        site = re.match(r"[^/?#]*://[^/?#]*", u)[0]
        base = re.match(r"[^?#]*", u)[0]
        folder = site + "/" if base == site else base[: base.rindex("/") + 1]
        if "://" in target:
            return target
        if target.startswith("//"):
            return u.split("//")[0] + target
        return u if target[0] == "#" else site + target if target[0] == "/" else base + target if target[0] == "?" else folder + target

    def rule(u):
        host, path = split(u)
        fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: len(r.host + r.path), default=None)

    root, rules = {}, {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for _, u, html in rows:
        for m in re.finditer(r"""<(?:link\b[^>]*canonical[^>]*|meta\b[^>]*refresh[^>]*)>""", html or "", re.I):
            target = unescape(re.search(r"""(?:href|url)\s*=\s*["']?([^"'\s>]+)""", m[0], re.I)[1])
            seat = re.search(r"""<base\b[^>]*href\s*=\s*["']?([^"'\s>]+)""", html, re.I)
            far = joined(joined(u, unescape(seat[1])) if seat else u, target)
            a, b = key(u), key(far)
            if a and b:
                rules.setdefault(a, set()).add(rule(a))
                rules.setdefault(b, set()).add(rule(b))
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    out = []
    for page, u, _ in rows:
        own, k = rule(u), key(u)
        told = {r.verdict for x in root if find(x) == find(k) for r in rules.get(x, ()) if r} if k in root else set()
        verdict = own.verdict if own else "allow" if "allow" in told or not told else "block"
        out.append((page, *split(u), own and own.host + own.path, verdict, find(k) if k in root else k))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_urls(spark, seed):
    rows = pages(seed)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(tuple, url_filter.judge_urls(df).collect()), key=str)
    assert got == plain(rows)
    by = {r[0]: r for r in got}
    assert by[530][4] == by[500][4] == "block" and by[800][4] == by[801][4] == "allow" and by[802][4] == "block"
    assert all(by[k][4] == "block" for k in range(810, 820))
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", rows)
    assert sorted(con.execute(url_filter.ORACLE_SQL).fetchall(), key=str) == got


#: The contract's list, written out on its own.
CONTRACT = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def test_words_of_the_rules(spark):
    assert {r.host + r.path: r.verdict for r in url_filter.RULES} == CONTRACT
    rows = [(1, "http://x.com/en/1", None), (2, "http://example.com/en/71", None), (3, "http://q.net/de/1", None), (4, "http://deep.example.net/de/81", None), (5, "http://z.org/es/", None), (6, "http://example.net/de/7", None)]
    rows += [(7, "http://alias.test/", '<link rel=canonical href="http://q.net/de/1">'), (8, "http://y.org/es/2", '<link rel=canonical href="http://q.net/de/1">')]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(CONTRACT[got[k][0]] == got[k][1] for k in (1, 2, 3, 4, 5, 6, 8))
    assert got[3] == got[6] == ("net/de/", "allow") and got[4] == ("example.net/de/8", "block") and got[7] == (None, "allow")
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", rows)
    assert {r[0]: (r[3], r[4]) for r in con.execute(url_filter.ORACLE_SQL).fetchall()} == got
