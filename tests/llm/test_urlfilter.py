import re
from collections import Counter, defaultdict

from larder.llm import urlfilter


def split_url(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    lower = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return lower, re.match(r"[^?#]*", rest[len(host) :], re.S)[0]


def fit(host, path):
    best = None
    for v, h, p in urlfilter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return best


def brute(pages, rounds=9, d=0.85, threshold=0.075):
    seen, edges, n = defaultdict(Counter), Counter(), Counter()
    for _, url, html in pages:
        h, p = split_url(url)
        if h:
            n[h] += 1
            if f := fit(h, p):
                seen[f[1]][h] += 1
        for link in re.findall(r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'>\s]+)""", html or ""):
            to = split_url(":" + link if link.startswith("//") else link)[0]
            if h and to and h != to:
                edges[h, to] += 1

    def spread(seeds, edges):
        start = {h: (1 - d) * seeds[h] / n[h] for h in seeds}
        total, score = Counter(), dict(start)
        for (a, _), k in edges.items():
            total[a] += k
        for _ in range(rounds):
            new = Counter(start)
            for (a, b), k in edges.items():
                new[b] += d * score.get(a, 0) * k / total[a]
            score = new
        return score

    trust, distrust = spread(seen["allow"], edges), spread(seen["block"], {(b, a): k for (a, b), k in edges.items()})
    out = []
    for i, url, _ in pages:
        h, p = split_url(url)
        t, x = trust.get(h, 0), distrust.get(h, 0)
        f = fit(h, p)
        out.append((i, h, p, f and f[0], f[1] if f else "block" if x >= threshold and x > t else "allow", round(t, 6), round(x, 6)))
    return sorted(out, key=str)


def got(df):
    return sorted(((*tuple(r)[:5], round(r.trust, 6), round(r.distrust, 6)) for r in df.collect()), key=str)


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    assert got(urlfilter.judge(pages)) == brute([tuple(r) for r in pages.collect()])


def test_links_and_odd_rows(spark):
    a = lambda *x: "".join(f'<a HREF = "{u}">x</a>' for u in x)
    pages = [
        (1, "http://Bad.Example.com/de/1", a("//good.example.org/fr/", "/local")), (2, "http://linker.test/x", a("http://bad.example.com/de/", "https://bad.example.com/")),
        (3, "http://farm.test/", a("http://linker.test/?q#f", "x://farm.test/")), (4, "http://good.example.org/fr/a?b", a("http://friend.test", "http://linker.test/")),
        (5, "http://friend.test#top", None), (6, None, a("http://x.test/")), (7, "no scheme", ""), (8, "a://b://c/en/", "<a href=//d.net>"), (9, "http://x.net/en/", "z" * 100000),
        (9, "http://sub.example.net/en/", ""), (None, "http://example.net/en", ""), (11, "http://notnet/", ""), (11, "http://notnet/", ""), (12, "http://bad.example.com/de/2", ""), (13, "http://h.com/\n/x?y", ""),
    ]
    df = spark.createDataFrame([(*p, 1, "v") for p in pages], "page_id long, url string, html string, host int, rule string")
    want = brute(pages)
    assert got(urlfilter.judge(df)) == want
    assert {r[1]: r[4] for r in want if r[3] is None}["linker.test"] == "block"
    assert urlfilter.judge(df.limit(0)).collect() == []


def test_sql(spark):
    from larder.llm.queries import ORACLES, QUERIES

    from .oracle import same

    assert same(spark, QUERIES["op4_url_filter"], ORACLES["op4_url_filter"], "/root/testdata/sf0.01") == 250


def brute_linked(pages):
    """As ``brute``, with a page of every link to a host without pages, which goes again in the end."""
    have, more = {split_url(u)[0] for _, u, _ in pages}, []
    for _, url, html in pages:
        h = split_url(url)[0]
        for link in re.findall(urlfilter.LINK, html or ""):
            url = ":" + link if link.startswith("//") else link
            to = split_url(url)[0]
            if h and to and to != h and to not in have:
                more.append((-1, url, ""))
    return [r for r in brute([*pages, *more]) if r[0] != -1]


def test_linked_hosts_without_pages(spark):
    a = lambda *x: "".join(f'<a href="{u}">x</a>' for u in x)
    pages = [
        (1, "http://linker.test/", a("http://spam.net/1", "http://spam.net/2")), (2, "http://mixed.test/", a("http://shop.example.com/de/", "http://shop.example.com/", "http://shop.example.com/en/", "http://fine.test/")),
        (3, "http://far.test/", a("http://linker.test/")), (4, "http://own.net/x", ""), (5, "http://friend.test/", a("http://own.net/y", "//good.org/fr/")), (6, None, a("http://lost.net/")), (7, "http://proud.test/", a("//Good.org/fr/1")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = brute_linked(pages)
    assert got(urlfilter.judge(df)) == want
    verdicts = {r[1]: r[4] for r in want}
    assert verdicts["linker.test"] == "block" and verdicts["mixed.test"] == verdicts["proud.test"] == "allow"


def test_sql_on_linked_hosts(spark, tmp_path):
    """The registered query and its SQL on pages whose links reach hosts with and without pages."""
    from larder.llm.queries import ORACLES, QUERIES

    from .oracle import same

    a = lambda *x: "".join(f'<a HREF = "{u}">x</a>' for u in x)
    pages = [
        (1, "http://linker.test/", a("http://spam.net/1", "http://spam.net/2", "/local")), (2, "http://mixed.test/", a("http://shop.example.com/de/", "http://shop.example.com/", "http://shop.example.com/en/", "http://fine.test/")),
        (3, "http://far.test/", a("http://linker.test/?q#f")), (4, "http://own.net/x", ""), (5, "http://friend.test/", a("http://own.net/y", "//good.org/fr/")), (6, None, a("http://lost.net/")), (7, "http://proud.test/", a("//Good.org/fr/1")),
        (8, "http://Bad.Example.com/de/1", a("//good.example.org/fr/")), (9, "http://good.example.org/fr/a?b", a("http://friend.test", "http://linker.test/")), (9, "no scheme", None),
    ]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    assert same(spark, QUERIES["op4_url_filter"], ORACLES["op4_url_filter"], str(tmp_path)) == len(pages)
    assert {r.host: r.verdict for r in QUERIES["op4_url_filter"](spark, str(tmp_path)).collect()}["linker.test"] == "block"
