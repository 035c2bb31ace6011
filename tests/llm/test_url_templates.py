import re
from collections import Counter, defaultdict

from onramp.llm import url_templates as U


def brute_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    best = None
    for say, r in U.RULES:
        h, p = r.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r) > len(best[1])):
            best = (say, r)
    return best or (None, None)


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, VERDICT string")


def test_parts_and_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/1", "http://example.net/en", "http://b.example.net/EN/1", "https://xexample.net/en/", "x://y.net",
            "http://net/", "http://É.org/fr/a?b://c/d", "a\nb://c.org/fr/#x", "http://h.example.com/de/1?x", "http://h.example.com#/de/", "http://x.com/a?q", "http://x.net?u"]
    for r in U.judge(frame(spark, urls)).collect():
        host, path = brute_parts(urls[r.page_id])
        say, rule = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule), urls[r.page_id]
        assert r.verdict == (say or "allow")
    assert U.judge(frame(spark, [])).count() == 0


def test_templates_merge_and_reject(spark):
    rules = (("block", "bad.org/spam/"), ("block", "bad.org/junk/"), ("allow", "bad.org/news/"))
    urls = [f"http://bad.org/{s}/{i}/item.html" for s in ("spam", "junk", "news") for i in range(40)]
    # the same host without the rules' exact spelling of the path, alike in template
    urls += [f"http://bad.org/other/{i}" for i in range(30)] + ["http://bad.org/junk"] * 5 + ["http://bad.org/x/" + "deep/" * 30]
    out = U.judge(frame(spark, urls), rules).collect()
    assert len(out) == len(urls)
    by = defaultdict(Counter)
    for r in out:
        by[r.template][r.verdict] += 1
    # spam and junk are merged (both all blocked), news differs and stays
    assert by["*1/~{n}/=item.html"] == Counter(block=80)
    assert by["=news/~{n}/=item.html"] == Counter(allow=40)
    assert by["=other/~{n}"] == Counter(allow=30)
    assert sum(by[t]["allow"] for t in by if t.count("/") >= 30 and "**" not in t) == 1  # every segment is in the template
    purity = {r.template: r.purity for r in out}
    assert purity["*1/~{n}/=item.html"] == 82 / 84 and purity["=other/~{n}"] == 0.5


def test_labels_below_many_levels(spark):
    """Sections that differ only in their twelfth segment are told apart there."""
    deep = "http://far.org/" + "/".join("abcdefghijk")
    rules = (("block", "far.org/" + "/".join("abcdefghijk") + "/spam/a"), ("allow", "far.org/" + "/".join("abcdefghijk") + "/news/a"))
    urls = [f"{deep}/{s}/{k}{i}" for s in ("spam", "news") for k in "ab" for i in range(40)]
    out = U.judge(frame(spark, urls), rules).collect()
    assert Counter((urls[r.page_id].split("/")[14], r.verdict) for r in out) == {("spam", "block"): 80, ("news", "allow"): 80}


def test_method_blocks_unruled_urls_of_rejected_templates(spark):
    rules = (("block", "w.org/a/0"), ("block", "w.org/a/1"), ("block", "w.org/a/2"), ("block", "w.org/a/3"), ("block", "w.org/a/4"))
    urls = [f"http://w.org/a/{i:03d}" for i in range(600)] + [f"http://v.org/a/{i}" for i in range(60)]
    out = U.judge(frame(spark, urls), rules).collect()
    assert all(r.verdict == ("block" if r.host == "w.org" else "allow") for r in out)


def test_query_against_brute_rules(spark):
    sf = "/root/testdata/sf0.01"
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = U.op4_url_templates(spark, sf).collect()
    assert len(out) == len(urls)
    for r in out:
        host, path = brute_parts(urls[r.page_id])
        say, rule = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (say or r.verdict) and r.verdict in ("allow", "block")


def test_unlike_siblings_are_not_folded_together(spark):
    rules = (("block", "few.org/de/"), ("block", "hot.org/s00/"), ("block", "one.org/de/"), ("block", "tiny.org/a"), ("block", "slug.org/de/"))
    few = [f"http://few.org/{s}/{i}" for s, k in (("de", 18), ("en", 40), ("es", 3), ("fr", 1)) for i in range(k)]
    hot = [f"http://hot.org/s{s:02d}/{i}" for s in range(40) for i in range(60)]
    one = [f"http://one.org/de/{i}" for i in range(6)] + ["http://one.org/es/1"]
    # many sections of two paths each: no section stands out, all together do
    tiny = [f"http://tiny.org/{a}{b}/{i}" for a in "ab" for b in "abcdefghijklmnopqrst" for i in range(2)]
    slug = [f"http://slug.org/de/{i}" for i in range(7)] + [f"http://slug.org/{a}{b}" for a in "fgh" for b in "abcdefghij"]
    urls = few + hot + one + tiny + slug
    out = U.judge(frame(spark, urls), rules).collect()
    assert len(out) == len(urls)
    assert all(r.verdict == ("block" if r.rule else "allow") for r in out), [(r.host, r.path, r.template) for r in out if not r.rule and r.verdict == "block"][:5]
    # ids of one path each stay one wildcard
    ids = [f"http://w.org/a/{i:03d}" for i in range(600)]
    some = tuple(("block", f"w.org/a/{i}") for i in range(5))
    assert {r.template for r in U.judge(frame(spark, ids), some).collect()} == {"=a/~{n}"}
