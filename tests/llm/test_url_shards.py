"""URL rules in several shards, and hosts with very many labels."""

import random
import tracemalloc

from fathomline.llm import url_filter


def brute(url, rules):
    host, path = url_filter.split_url(url)
    fits = [(len(h) + len(p), len(h), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (best[2], best[3]) if best else (None, "allow")


def test_shards_give_the_same_as_brute_force(spark):
    rng = random.Random(4)
    hosts = [".".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rules = sorted({(h, "/" * rng.randint(0, 1) + rng.choice(["", "x", "x/y"])): rng.choice(["block", "allow"]) for h in hosts[:60]}.items())
    rules = [(a, h, p) for (h, p), a in rules]
    urls = [f"http://{h}/{rng.choice(['', 'x', 'x/y/z', 'q'])}" for h in hosts] + [None, "", "http://", "http://..a/x"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert len(url_filter.compile_rules(rules, 200)) > 3
    for size in (200, url_filter.SHARD_BYTES):
        out = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(frame, rules, shard_bytes=size).collect()}
        assert out == {i: brute(u, rules) for i, u in enumerate(urls)}
    assert url_filter.filter_urls(frame, []).where("verdict = 'allow'").count() == len(urls)


def test_host_of_a_hundred_thousand_labels():
    array = url_filter.DigestArray.of(url_filter.compile_rules([("block", "net", "/"), ("allow", "example.net", "/en/")])[0])
    host = "a." * 100_000 + "example.net"
    tracemalloc.start()
    assert array.judge([host], ["/en/x"]) == [("example.net", "/en/", False)]
    assert tracemalloc.get_traced_memory()[1] < 4 << 20
    tracemalloc.stop()
