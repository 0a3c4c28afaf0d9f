import random

import numpy as np
from pyspark.sql import functions as F

from gleanery.llm import common, textkit


def brute_components(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_components_match_union_find(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(1000, 1300)]
    rest = [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    links = [*chain, *star, *rest, (5, 5), (160, 99)]
    rng.shuffle(links)
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
    want = {k: v for k, v in brute_components(links).items() if any(k in p and p[0] != p[1] for p in links)}
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_skew_joins_equal_plain_joins(spark):
    rows = [(1, i) for i in range(3000)] + [(k, 0) for k in range(2, 50)]
    left = spark.createDataFrame(rows, "k long, v long")
    right = spark.createDataFrame([(k, f"x{k}", sum(r[0] == k for r in rows)) for k in range(1, 40)], "k long, name string, w long")
    want = sorted(map(tuple, left.join(right.drop("w"), "k").collect()))
    assert sorted(map(tuple, common.skew_join(left, right, "k", "w").drop("w").collect())) == want
    salted = common.salted_join(left, right.drop("w"), "k", right.select("k", "w"), "v", per=100)
    assert sorted(map(tuple, salted.select("k", "v", "name").collect())) == want
    outer = common.skew_join(left, right, "k", "w", "left")
    assert outer.count() == len(rows)


def test_without_and_only_are_exact_and_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(i if i != 7 else None, f"t{i}", i, "x") for i in range(500)], "doc_id long, text string, maybe__ long, at__ string").withColumn("a.b", F.lit(1))
    gone = spark.createDataFrame([(i,) for i in range(0, 500, 3)], "doc_id long")
    kept = common.without(docs, "doc_id", gone)
    assert set(kept.columns) == set(docs.columns)
    assert {r["maybe__"] for r in kept.collect()} == {i for i in range(500) if i % 3 or i == 7} | {7}
    assert {r["maybe__"] for r in common.only(docs, "doc_id", gone).collect()} == {i for i in range(0, 500, 3) if i != 7}
    assert common.without(docs, "doc_id", gone.limit(0)).count() == 500


def test_bitmap_misses_nothing(spark):
    keys = spark.range(20_000).select((F.col("id") * 7919).alias("h"))
    table, power = common.bitmap(keys, "h", 20_000)
    rows = common.in_bitmap(keys.unionByName(spark.range(20_000).select((-F.col("id") - 1).alias("h"))), F.col("h"), table, power, "hit")
    r = {x["old"]: (x["n"], x["hits"]) for x in rows.groupBy((F.col("h") >= 0).alias("old")).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits")).collect()}
    assert r[True] == (20_000, 20_000)
    assert r[False][1] < 4000


def test_words_and_hashes_match_python():
    import pyarrow as pa

    texts = ["Hello wörld  foo\n", "", "one", None, "tail", " a b ", "x" * 5000 + " y", "a\x0bb\x0cc\x1dd\x00e"]
    data, offsets = textkit.buffer_of(pa.array(texts))
    starts, ends, rows = textkit.spans(data, offsets, textkit.WHITE)
    words = [data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
    want = [(t or "").encode().split() for t in texts]
    assert words == [w for t in want for w in t]
    assert np.diff(rows).tolist() == [len(t) for t in want]
    h = textkit.word_hashes(data, starts, ends)
    again = textkit.word_hashes(data, starts, ends, block=7)
    assert (h == again).all()
    by = {}
    for w, x in zip(words, h.tolist(), strict=True):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)
