import random

from framewell.llm import url_filters

RULES = [("org", "/", "allow"), ("a.org", "/x", "block"), ("b.a.org", "/x/y", "allow"), ("c.com", "", "block"), ("com", "/é/", "allow"), ("d.com", "/q", "block"), ("com.d", "/q", "allow"), (None, "/", "block"), ("net", "/", "block"), ("net", "/", "block")]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min((rest.index(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [(len(h + p), v == "block", h + p, v) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, "allow")


def test_verdicts_match_brute_force(spark, sf_dir):
    rng = random.Random(1)
    urls = [None, "", "no scheme/x", "://", "http://", "HTTP://A.ORG/x\n/y?z", "http://a.org.", "ftp://u@c.com:80/x", "http://É.org/é", "x://y://z.org/"]
    for _ in range(400):
        host = ".".join(rng.choices(["a", "b", "c", "d", "org", "COM", "net", "com", ""], k=rng.randrange(4)))
        urls.append(f"http://{host}{rng.choice(['', '/', '?', '#'])}{''.join(rng.choices(['x', '/', 'y', 'é', 'q', '?', '#'], k=rng.randrange(6)))}")
    urls += urls[:20] + [r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(df, rules).collect())
    assert got == [(i, *brute(u)) for i, u in enumerate(urls)]
    assert url_filters.judge_urls(df.limit(0), rules).count() == 0
    none = url_filters.judge_urls(df, rules.limit(0), default="block")
    assert none.count() == len(urls) and none.filter("verdict <> 'block' or rule is not null").count() == 0
