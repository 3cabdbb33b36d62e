"""The regression of the URL filter against a plain gradient loop, whole hosts held out, and odd rows."""

import math

import numpy as np
import pytest

from tidemark.llm import url_filter as U


def test_fit_equals_a_plain_gradient_loop():
    rows = [("casino-one.com", "/", 1), ("big-casino.org", "/en/1", 1), ("town-library.org", "/", 0), ("my-garden.net", "/fr/x", 0), ("my-garden.net", "/fr/x", 0)]
    each = []
    for h, p, _ in rows:
        x = {}
        for b in U.buckets(h, p).tolist():
            x[b] = x.get(b, 0) + 1
        norm = math.sqrt(sum(v * v for v in x.values()))
        each.append({**{b: v / norm for b, v in x.items()}, U.BUCKETS: 1.0})
    w = {}
    for _ in range(40):
        slope = {}
        for x, (_, _, y) in zip(each, rows):
            gap = y - 1 / (1 + math.exp(-sum(w.get(b, 0.0) * v for b, v in x.items())))
            for b, v in x.items():
                slope[b] = slope.get(b, 0.0) + gap * v / len(rows)
        w = {b: w.get(b, 0.0) + U.RATE * (slope.get(b, 0.0) - U.DECAY * w.get(b, 0.0)) for b in {*w, *slope}}
    got = U.train(rows, steps=40)
    assert np.allclose([got[b] for b in w], list(w.values()), atol=1e-5) and np.count_nonzero(got) == len(w)


def test_whole_hosts_held_out():
    found = U.error()
    assert found["caught"] >= 0.85 and found["allowed"] >= 0.95
    weights = U.train()
    said = lambda host: U._vector(host, "/") @ weights[:-1] + weights[-1] >= 0
    assert all(map(said, ("poker-stars.example", "viagra-shop.example", "best-loans-now.example", "onlinecasino.example")))
    assert not any(map(said, ("wikipedia.example", "nytimes.example", "lemonde.example", "zorbik.example")))


def test_no_name_of_the_judged_table_is_a_label(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    named = {r.host for r in pages.select(U.host_of(pages["url"]).alias("host")).distinct().collect()}
    core = {h.split(".example.")[0].split(".")[-1] for h in named}
    assert not core & {part for h, _, _ in U.labelled() for part in h.split(".")}


@pytest.mark.parametrize("empty", [True, False])
def test_odd_rows(spark, empty):
    long = "http://" + "a.b" * 50_000 + "/" + "x" * 200_000 + "?q"
    rows = [(1, None, "v"), (2, "", "v"), (3, "no scheme", "v"), (4, "HTTP://A.Net/P?x://y", "v"), (4, "HTTP://A.Net/P?x://y", "v"), (None, "http://b.org/fr/1", "v"), (5, long, "v"), (6, "x://h\ni/p\nq#f", "v")]
    pages = spark.createDataFrame([] if empty else rows, "page_id long, url string, verdict string")
    got = U.judge(pages, U.train()).collect()
    assert len(got) == (0 if empty else 8)
    if not empty:
        by = {}
        for r in got:
            by.setdefault(r.page_id, []).append((r.host, r.path, r.rule))
        assert by[1] == by[2] == by[3] == [("", "", None)]
        assert by[4] == [("a.net", "/P", "net/")] * 2 and by[None] == [("b.org", "/fr/1", "org/fr/")] and by[6] == [("h\ni", "/p\nq", None)]
        assert len(by[5][0][1]) == 200_001
