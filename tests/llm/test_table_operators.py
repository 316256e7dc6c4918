"""Searches, URL rules and archive records against brute force and by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from collatium.llm import op3_hnsw, op6_topk, op7_urls, op9_warc


def vectors(spark, n=400, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8)).round(3)
    x[50:90] = x[7]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(n, None), (n + 1, [0.0] * 8), (n + 2, [float("nan")] + [1.0] * 7), (n + 3, [None] + [1.0] * 7), (None, [1.0] * 8), (n + 4, [1.0, 2.0]), (n + 5, [])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'own' as score", "1 as dim"), x


@pytest.fixture(scope="module")
def table(spark):
    df, x = vectors(spark)
    return df.cache(), np.array(x, dtype=np.float32).astype(float)


def test_nearest_recall_and_scores(table):
    df, x = table
    got = {}
    for r in op3_hnsw.nearest(df, F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = 0
    for q in range(0, 400, 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = sorted((d[i], i) for i in range(len(x)) if i != q)[:10]
        assert sorted(got[q]) == list(range(1, 11))
        assert all(abs(s - d[i]) < 1e-9 for i, s in got[q].values())
        hits += len({i for i, _ in got[q].values()} & {i for _, i in want})
    assert hits >= 0.9 * 200 and set(got) == {*range(0, 400, 20)}


def test_recall_over_several_shards_of_the_embeddings(spark):
    """The driver's vectors in eight shards, merged, against brute force."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    data = {r.vec_id: np.array(r.embedding, dtype=float) for r in df.collect() if r.embedding}
    ids, x = np.array(sorted(data)), np.array([data[k] for k in sorted(data)])
    got: dict = {}
    for r in op3_hnsw.nearest(df, F.col("id") % 10 == 0, shard=64).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - data[q]) ** 2).sum(1))
        hits += len(found & set([int(i) for i in ids[np.lexsort((ids, d))] if i != q][:10]))
    assert len(got) >= 45 and hits >= 0.9 * 10 * len(got)


def test_searches_of_many_lengths_and_of_values_beyond_range(spark):
    rows = [(i, [float(i + j) for j in range(1 + i % 60)]) for i in range(240)] + [(900, [1e307, 1.0]), (901, [-1e307, 2.0]), (902, [1e160, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    near = op3_hnsw.nearest(df, F.col("id") % 50 == 0).collect()
    assert {r.query_id for r in near if r.query_id % 50 == 0} == {50, 100, 150, 200, 900}  # 0 is a zero vector
    large = op6_topk.largest(df, F.col("id") % 50 == 0).collect()
    for q in (0, 50, 100, 150, 200):
        whole = lambda v: np.floor(256 * np.array(v))
        want = sorted((-int(whole(dict(rows)[q]) @ whole(v)), i) for i, v in rows if i != q and len(v) == len(dict(rows)[q]) and i < 900)
        assert [(r.vec_id, r.score) for r in sorted(large, key=lambda r: r.rank) if r.query_id == q and r.vec_id < 900] == [(i, -s) for s, i in want][:5]


def test_searches_of_empty_tables(table):
    none = table[0].limit(0)
    assert op3_hnsw.nearest(none, F.col("id") % 20 == 0).count() == 0 and op6_topk.largest(none, F.col("id") % 20 == 0).count() == 0


def test_largest_products_are_exact(table):
    df, x = table
    whole = np.floor(256 * x).astype(np.int64)
    rows = {i: v for i, v in enumerate(whole)} | {401: np.zeros(8, np.int64)}
    got = {}
    for r in op6_topk.largest(df, F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in range(0, 400, 20):
        want = sorted((-int(rows[q] @ v), i) for i, v in rows.items() if i != q)[:5]
        assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(want, 1)]


def test_annuli_beyond_every_bound_are_not_sent(spark, monkeypatch):
    """Far-apart clusters: exact products where blocks meet few spans; intervals against each query's own."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(300, 6)) * 0.05 + 6 * c for c in rng.normal(size=(8, 6))]).round(3)
    monkeypatch.setattr(op6_topk, "SPAN", 1)
    monkeypatch.setattr(op6_topk, "QUERIES", 16)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in op6_topk.largest(df, F.col("id") % 50 == 0, block=32).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = np.floor(256 * x).astype(np.int64)
    for q in range(0, len(x), 50):
        want = sorted((-int(s), i) for i, s in enumerate(whole @ whole[q]) if i != q)[:5]
        assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(want, 1)]
    ids, q = np.arange(0, len(x), 50), whole[::50].astype(float)
    sample = (np.arange(len(x)), whole.astype(float), float((whole.astype(float) ** 2).sum(1).max()))
    far, own, floor, slack = op6_topk.starts(ids, q, sample, 4, 5)
    reach = np.sqrt(np.maximum(0.0, own + sample[2] - 2.0 * floor + slack))
    spans = list(op6_topk.intervals(ids, q, sample, 4, 5))
    for p in range(4):
        mine = [(a, b) for at, a, b in spans if at == p]
        assert all(b < c for (_, b), (c, _) in zip(mine[:-1], mine[1:], strict=True))
        for point in np.linspace(far[:, p].min() - 1, far[:, p].max() + 1, 200):
            assert any(a <= point <= b for a, b in mine) or not (np.abs(far[:, p] - point) <= reach).any()


def test_url_rules_and_mined_rules(spark):
    urls = ["http://a.example.com/en/71", "http://COM/en/x", "https://x.example.net/de/8?q", "http://y.net/de/", "http://spam.biz/buy/now", "no scheme", None, "http://", "http://fine.biz/read/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    bad = [(f"http://s{i}.biz/buy/{i}", True) for i in range(30)] + [(f"http://s{i}.biz/read/{i}", False) for i in range(30)] + [(None, True)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in op7_urls.judge(pages, spark.createDataFrame(bad, "url string, bad boolean")).collect()}
    assert got[0] == ("a.example.com", "/en/71", "example.com/en/7", "allow") and got[1] == ("com", "/en/x", "com/en/", "block")
    assert got[2] == ("x.example.net", "/de/8", "example.net/de/8", "block") and got[3] == ("y.net", "/de/", "net/de/", "block")
    assert got[4][2:] == (None, "block") and got[8][2:] == (None, "allow")
    assert got[5] == ("", "", None, "allow") == got[6] and got[7] == ("", "", None, "allow") and len(got) == len(urls)
    assert op7_urls.judge(pages.limit(0), spark.createDataFrame([], "url string, bad boolean")).count() == 0
    assert op7_urls.judge(pages, spark.createDataFrame([], "url string, bad boolean")).count() == len(urls)


def test_url_rules_of_the_contract(spark, tmp_path):
    """Every rule of the registered query by its word in the contract, on its host, a subdomain and beside it."""
    from collatium.llm import queries

    contract = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    urls = [f"https://{sub}{rule}x" for rule in contract for sub in ("", "www.")] + ["https://xnet/de/", "https://a.net/fr/de/"]
    spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in queries.op7_url_rules(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(10)] == [pair for pair in contract.items() for _ in range(2)] and got[10] == got[11] == (None, "allow")


def test_one_long_url_makes_no_explosion(spark):
    """URLs of 1,000 parts, good and bad ones, and rules that combine two tokens, against all subsets of two."""
    long = "http://deep.biz/" + "/".join(f"part{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(1000))
    bad = [(long, True)] * 6 + [(long, False)] * 6 + [(long + "/tail", True)]
    bad += [(f"http://a.org/x/{i}?q=1", True) for i in range(20)] + [(f"http://a.org/y/{i}?q=1", False) for i in range(20)] + [(f"http://b.org/x/{i}?q=1", False) for i in range(20)]
    pages = [(1, long, 9), (2, "http://a.org/x/7?q=1", 9), (3, "http://b.org/x/7?q=2", 9), (4, "http://a.org/z/7?q=1", 9), (4, "http://a.org/x", 9)]
    df = spark.createDataFrame(pages, "page_id long, url string, verdict int").selectExpr("*", "'own' as token", "'own' as rule", "1 as n", "'own' as kid")
    got = sorted((r.page_id, r.verdict) for r in op7_urls.judge(df, spark.createDataFrame(bad, "url string, bad boolean"), min_support=0.01).collect())
    assert got == [(1, "allow"), (2, "block"), (3, "allow"), (4, "allow"), (4, "block")]


def test_minimal_rules(spark):
    urls = [("http://spam.biz/a", True)] * 6 + [("http://spam.biz/b", True)] * 6 + [("http://good.biz/a", False)] * 6
    rules, classes = op7_urls.mined_rules(spark.createDataFrame(urls, "url string, bad boolean").select(op7_urls.tokens(F.col("url")).alias("tokens"), "bad"), 0.01, 0.8)
    names = {r.token: r.cls for r in classes.collect()}
    assert {tuple(r.antecedent) for r in rules.collect()} == {(names["h:spam"],), (names["p:b"],)}


def test_revisits(spark):
    full, other = 'ETag: "a"\r\nContent-Length: 9\r\nX: 1', 'ETag: "b"\r\nContent-Length: 7'
    rows = [
        (1, "http://www.x.org/a/?b=2&a=1", 100, "response", full), (2, "https://x.org/a?a=1&b=2", 90_000, "response", other), (3, "http://x.org/a?b=2&a=1&utm_s=3", 80_000, "revisit", 'ETag: W/"a"\r\nX: 2\r\nContent-Length: 0'),
        (4, "http://x.org:80/a?a=1&b=2", 90_000, "revisit", 'ETag: "a"'), (5, "http://x.org/a?a=1&b=2", 200_000, "revisit", 'ETag: "a"'), (6, "http://y.org/", 5, "revisit", None), (7, None, 6, "revisit", ""), (8, "http://x.org/a?a=1&b=2", None, "revisit", ""), (9, "http://x.org/a", 3, "request", ""),
        (10, "http://x.org/a?a=1&b=2", 300_000, "revisit", "X: 5"),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, s long, type string, block string").select("record_id", "url", F.timestamp_seconds("s").alias("ts"), "type", "block")
    got = {r.record_id: (r.original_id, r.status, r.headers) for r in op9_warc.resolve(df).collect()}
    assert got[3] == (1, "resolved", {"etag": 'W/"a"', "content-length": "9", "x": "2"})
    assert got[4][:2] == (1, "resolved")  # strictly earlier only
    assert got[5][:2] == (2, "mismatch") and got[10][:2] == (2, "unvalidated") and got[10][2]["content-length"] == "7"
    assert [got[k][:2] for k in (6, 7, 8)] == [(None, "no-original")] * 3 and set(got) == {3, 4, 5, 6, 7, 8, 10}
    assert op9_warc.resolve(df.limit(0)).count() == 0


def test_revisits_of_one_hot_url_and_long_blocks(spark):
    """One URL within one day, repeated rows, clashing names and a block of many lines; every revisit against brute force."""
    rng = np.random.default_rng(3)
    rows = [(i, "http://hot.org/", int(rng.integers(0, 80_000)), "response" if i % 3 else "revisit", f'ETag: "{i % 5}"') for i in range(3000)]
    rows += [rows[0]] * 2 + [(5000, "http://hot.org/", 90_000, "revisit", "\n".join(f"h{i % 900}: {i}" for i in range(5000)) + "\n: none\nbroken")]
    df = spark.createDataFrame(rows, "record_id long, url string, s long, type string, block string").select("record_id", "url", F.timestamp_seconds("s").alias("ts"), "type", "block", F.lit(1).alias("canonical"), F.lit("x").alias("slice")).repartition(7)
    full = sorted((s, i) for i, _, s, t, _ in rows if t == "response")
    want = sorted((i, max(((a, b) for a, b in full if a < s), default=(None, None))[1] or -1) for i, _, s, t, _ in rows if t == "revisit")
    got = op9_warc.resolve(df).collect()
    assert sorted((r.record_id, -1 if r.original_id is None else r.original_id) for r in got) == want
    heads = next(r.headers for r in got if r.record_id == 5000)
    assert heads["h0"] == "4500" and heads["h899"] == "4499" and "" not in heads
