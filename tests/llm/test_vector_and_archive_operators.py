"""Vector search, vector groups and archives against brute force."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import descent, multiindex, warc
from folioflow.session import scratch_folder

KIND = "panel long, embedding array<float>, n_links int"


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters, equal vectors, and vectors that take no part."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 16))
    x[:60] = x[0] + 0.05 * rng.standard_normal((60, 16))
    x[60:70] = x[60]
    x[70:90] = x[70] + 0.2 * rng.standard_normal((20, 16))
    rows = [(i, [float(np.float32(c)) for c in v], 0) for i, v in enumerate(x)]
    bad = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [1.0] * 15 + [None], 0), (1004, [float("inf")] * 16, 0), (1005, [], 0), (None, rows[0][1], 0)]
    return spark.createDataFrame(rows + bad, KIND), np.array([r[1] for r in rows]), bad


def test_search_has_recall_and_exact_scores(vectors):
    df, x, _ = vectors
    asked = df.where("panel % 20 = 0 or panel is null")
    got = {}
    for r in multiindex.nearest(df, asked, centroids=8).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 600, 20))
    hit = 0
    for q, rows in got.items():
        s = (x * x[q]).sum(1)
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21)) and q not in [r[1] for r in rows]
        assert [r[1] for r in rows] == [v for _, v in sorted((-s[r[1]], r[1]) for r in rows)]
        assert np.allclose([r[2] for r in rows], [s[r[1]] for r in rows], rtol=1e-12)
        hit += len({r[1] for r in rows} & set(sorted((i for i in range(600) if i != q), key=lambda i: (-s[i], i))[:20]))
    assert hit >= 0.9 * 20 * len(got)
    everything = multiindex.nearest(df, asked, k=20, share=1.0, piece=50).where("query_id = 60").orderBy("rank").collect()
    assert [r["vec_id"] for r in everything if 61 <= r["vec_id"] < 70] == list(range(61, 70))  # ties to the smaller key


def test_search_with_few_vectors(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [2.0, 1.0], 0)], KIND)
    assert [tuple(r) for r in multiindex.nearest(one, one).orderBy("query_id").collect()] == [(1, 1, 2, 4.0), (2, 1, 1, 4.0)]
    assert multiindex.nearest(one.limit(0), one).count() == 0


def test_cells_come_in_the_order_of_summed_distance():
    rng = np.random.default_rng(2)
    a, b = rng.random(7), rng.random(5)
    counts = np.ones((7, 5), int)
    order = sorted((a[i] + b[j], i, j) for i in range(7) for j in range(5))
    for wanted in (1, 6, 20, 35):
        got = {(i, j) for i, js in multiindex.traverse(a, b, counts, wanted).items() for j in js}
        assert got == {(i, j) for _, i, j in order[:wanted]}


def test_vector_groups_equal_brute_force(vectors):
    df, x, bad = vectors
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    root = list(range(600))
    for _ in range(600):
        new = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(600)]
        if new == root:
            break
        root = new
    got = {r["panel"]: tuple(r)[1:] for r in descent.near_duplicate_vectors(df, piece=16, k=5, leaf=64).collect()}
    assert {i: got[i] for i in range(600)} == {i: (int(near[i].sum()), root[i], root[i] == i) for i in range(600)}
    assert all(got[b[0]] == (0, b[0], True) for b in bad if b[0] is not None)
    assert got[None] == (0, None, True)
    assert descent.near_duplicate_vectors(df.limit(0)).count() == 0


def test_archives(spark):
    rng = random.Random(3)
    body = ["<p>" + "x" * rng.randrange(50) + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n</p>é" for _ in range(40)] + [None, "", None, "same", "same", "same"]
    hosts = ["http://www.b.example/p?x=1#f", "https://a.example/Q", None, "no address\r\nX: y"]
    rows = [(i, hosts[i % 4], t, 100 + i // 3, "z") for i, t in enumerate(body)] + [(-5, hosts[0], "same", None, "z"), (None, hosts[1], "same", 5, "z")]
    df = spark.createDataFrame(rows, "page long, file string, content string, s long, archive string").withColumn("captured_at", F.timestamp_seconds("s"))
    folder = scratch_folder(spark, "test")
    warc.write_archives(df, folder, records=7)
    runs = warc.read_runs(spark, folder)
    got = warc.capture_histories(runs).collect()
    order = [(r["url_key"], r["captured_at"]) for r in got]
    assert order == sorted(order) and len(got) == len(rows) and got[0]["url_key"]
    by = {r["page"]: r for r in got}
    top = {}
    for i, _, t, *_ in rows:
        if i is not None:
            top[t or ""] = max(top.get(t or "", i), i)
    for i, _, t, *_ in rows:
        data = (t or "").encode()
        r, to = by[i], None if i is None or top[t or ""] == i else top[t or ""]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (
            len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to is None else "revisit", to)
    empty = scratch_folder(spark, "test")
    warc.write_archives(df.limit(0), empty)
    assert warc.capture_histories(warc.read_runs(spark, empty)).count() == 0


def test_small_pages_are_all_responses(spark):
    df = spark.createDataFrame([(i, "u", "ab") for i in range(3)], "page long, file string, content string").withColumn("captured_at", F.lit("2024-01-01"))
    folder = scratch_folder(spark, "test")
    warc.write_archives(df, folder, least=3)
    assert {r["record_type"] for r in warc.read_runs(spark, folder).collect()} == {"response"}


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted([(f"k{rng.randrange(5)}", f"t{rng.randrange(3)}", rng.randrange(9), 0, "", "", None, f"a{i}", j) for j in range(rng.randrange(6))], key=warc._place) for i in range(k)]
    assert list(warc.LoserTree(runs)) == sorted([r for run in runs for r in run], key=warc._place)


def test_url_keys():
    assert warc.url_key("HTTP://www.Example.com:80/A?b=C#d") == "com:80,example)/a?b=c"
    assert warc.url_key("https://x.org") == "org,x)/"
    assert warc.url_key("Nothing") == "nothing"
    assert warc.url_key("http://[Bad/x") == "http://[bad/x" and warc.url_key("http://a]b") == "http://a]b"
