"""Vectors, urls, chats, shards and the pipeline against brute force."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, chat, queries, sharding, url_filter

SF = "/root/testdata/sf0.001"


def exact(rows, queries_, k=10):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for q, v in queries_:
        d = np.sqrt(((x - np.array(v, float)) ** 2).sum(1))
        d[ids == q] = np.inf
        best = [int(b) for b in np.lexsort((ids, d))[:k] if d[b] < np.inf]
        out[q] = [(int(ids[b]), float(d[b])) for b in best]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(0)
    good = [(i, rng.normal(0, 1, 16).tolist()) for i in range(3000)]
    good += [(5000 + i, good[1][1]) for i in range(300)]
    bad = [(8000, None), (8100, [0.0] * 16), (8200, [float("nan")] * 16), (8300, [None] * 16), (8400, [float("inf")] * 16), (8500, [1.0] * 3), (8600, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in good + bad], "vec_id long, embedding array<double>, rank int").repartition(3)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = exact(good, [q for q in good if q[0] % 100 == 0])
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    assert all(x == sorted(x, key=lambda p: (p[1], p[0])) for x in got.values())


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, round(r.score, 6)) for r in ann.nearest(df, df.where("vec_id = 0")).collect()] == [(1, round(math.sqrt(2), 6))] * 2
    assert ann.nearest(df.where("false"), df).count() == 0


def test_hosts_and_rules(spark):
    urls = [None, "no scheme", "HTTP://WWW.Example.NET/en/x?y#z", "http://example.com/de/1", "http://a.example.com#x", "http://notexample.com/de/", "x://org/fr/", "x://host", "x:///p", "http://net", "http://example.net/EN/"]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, spark.createDataFrame([], "page_id long, bad int")).collect()}
    assert got[0] == ("", "", None, "allow") and got[1] == ("", "", None, "allow")
    assert got[2] == ("www.example.net", "/en/x", "example.net/en/", "allow")
    assert got[3] == ("example.com", "/de/1", "example.com/de/", "block") and got[4] == ("a.example.com", "", None, "allow")
    assert got[5][2] is None and got[6] == ("org", "/fr/", "org/fr/", "allow") and got[7] == ("host", "", None, "allow") and got[8] == ("", "/p", None, "allow")
    assert got[9] == ("net", "", None, "allow") and got[10][2:] == ("net/", "block")


def test_reputation_shrinks(spark):
    rows = [("bad.spam.org", 1)] * 40 + [("new.spam.org", None)] + [("other.spam.org", 1)] * 30 + [(f"h{i % 20}.fine.org", 0) for i in range(400)] + [("one.fine.org", 1)]
    got = {r.host: r for r in url_filter.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["bad.spam.org"].bound > 0.8 and got["new.spam.org"].post > 0.5 > got["one.fine.org"].bound
    assert url_filter.host_reputation(spark.createDataFrame([], "host string, bad int")).count() == 0


@pytest.mark.parametrize("name", ["op1_decontamination", "op8_url_filter", "op9_perspectives"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "labels", "conversations", "documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLES[name])
    cols = sorted(df.columns)
    at = [list(rel.columns).index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


def test_perspectives(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 200, "ann", "x" * 5000), (None, None, None, "n"), (3, 0, "system", "alone")]
    got = chat.rotate(spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, speaker string")).collect()
    assert Counter((r.conv_id, r.speaker) for r in got) == {(1, "ann"): 5, (1, "bob"): 5, (None, "unknown"): 1}
    for key in ((1, "ann"), (1, "bob")):
        mine = sorted((r for r in got if (r.conv_id, r.speaker) == key), key=lambda r: r.start)
        text = "".join(r.segment for r in mine)
        assert all(text[r.start : r.end] == r.segment for r in mine) and mine[-1].end == len(text)
        assert all((r.train_end > r.train_start) == (r.role == "assistant") for r in mine)
        assert all(text[r.train_start : r.train_end].endswith("<|end|>\n") for r in mine if r.role == "assistant")
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (2, 1)])
def test_hilbert_neighbours(spark, dims, bits):
    n = 2 ** (dims * bits)
    cells = spark.range(n)
    cols = [F.expr(f"cast((id div {2 ** (bits * i)}) % {2**bits} as int)").alias(f"c{i}") for i in range(dims)]
    rows = cells.select(*cols).select("*", sharding.hilbert_index([F.col(f"c{i}") for i in range(dims)], bits).alias("h")).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(n))
    assert all(sum(abs(a[f"c{i}"] - b[f"c{i}"]) for i in range(dims)) == 1 for a, b in zip(rows, rows[1:], strict=False))


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 500])
def test_shards(spark, n):
    rows = [(i % 37 if i % 5 else None, None if i % 11 == 0 else "é" * (i % 9) + "t", ["en", None][i % 2], f"s{i % 3}", i, "x") for i in range(n)]
    df = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string"))
    got = df.collect()
    assert len(got) == n
    sizes = Counter(r.shard for r in got)
    assert not n or max(sizes.values()) - min([*sizes.values(), *([0] if len(sizes) < 16 else [])]) <= 1
    for s, k in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(k))
    assert Counter((r.size, r.text_crc32) for r in got) == Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    ranked = sorted(got, key=lambda r: r.curve_rank)
    assert [r.curve for r in ranked] == sorted(r.curve for r in ranked)


def test_pipeline(spark):
    import corpus_pipeline as P
    from tests.llm.test_text import brute_classes, brute_contamination

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = P.drop_toxic(spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    classes = brute_classes(rows)
    alone = P.drop_near_copies(spark, kept, SF)
    assert sorted(r.doc_id for r in alone.collect()) == sorted(i for i, c in classes.items() if i == c)
    rows = [(r.doc_id, r.text) for r in alone.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = P.drop_contaminated(spark, alone, SF)
    want = sorted(i for i, _, hit, _ in brute_contamination(rows, items) if not hit)
    assert sorted(r.doc_id for r in clean.collect()) == want
    out = P.run(spark, SF)
    assert sorted(r.doc_id for r in out.collect()) == want and out.where("not restored").count() == 0
