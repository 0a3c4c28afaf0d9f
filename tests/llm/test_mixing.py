from collections import Counter

import numpy as np
import pytest

from gleanery.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, sid int"
ROWS = [(i, " ".join(f"d{i}w{j}" for j in range(i % 37)), "hot" if i % 3 else f"s{i % 5}", 1, 1) for i in range(400)] + [
    (1000, None, "empty", 1, 1), (1001, "", "s1", 1, 1), (None, "a b c", None, 1, 1), (1002, "x y", None, 1, 1), (1003, "p q", "hot", 1, 1), (1003, "p q", "hot", 1, 1), (1004, "long " * 30_000, "s2", 1, 1),
]
CONFIG = mixing.MixConfig(block_words=16, shard_slots=64, bucket_rows=50)


def test_targets_share_the_excess():
    assert mixing.targets([100, 1, 100], [1, 2, 3], 201, 3) == pytest.approx([49.5, 3.0, 148.5])
    assert mixing.targets([0, 0], [1, 2], 0, 3) == [0, 0]
    t = mixing.targets([5, 50, 500, 7], [1, 2, 3, 1], 562, 3)
    assert sum(t) == pytest.approx(562) and all(x <= 3 * s + 1e-9 for x, s in zip(t, [5, 50, 500, 7], strict=True))


def test_permutations_are_bijections():
    for n in (1, 2, 3, 17, 1000):
        for key in (0, 5, 1 << 60):
            assert sorted(mixing.permuted(np.arange(n), n, key).tolist()) == list(range(n))
    assert (mixing.permuted(np.arange(1000), 1000, 1) != mixing.permuted(np.arange(1000), 1000, 2)).any()


def test_mix_meets_the_contract(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    got = mixing.mix(df, CONFIG).collect()
    assert len(got) == len(ROWS)
    sizes, source = Counter(), {}
    for _, t, s, *_ in ROWS:
        sizes[s] += len((t or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, mixing.targets([sizes[s] for s in names], [(1, 2, 3)[i % 3] for i in range(len(names))], sum(sizes.values()), 3), strict=True))
    for d, t, s, *_ in ROWS:
        source.setdefault((d, len((t or "").split())), s)
    taken = Counter()
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in names:
        assert abs(taken[s] - want[s]) <= 2 * CONFIG.block_words
    again = mixing.mix(df.repartition(2), CONFIG).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_blocks_hold_the_words_that_were_taken(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    blocks = mixing.mixed_blocks(df, CONFIG).collect()
    words = Counter(w for r in blocks for w in r["text"].split())
    for r in mixing.mix(df, CONFIG).collect():
        if r["doc_id"] is not None and r["doc_id"] < 1000:
            assert sum(words[f"d{r['doc_id']}w{j}"] for j in range(r["size"])) == r["taken"]
    assert all(len(r["text"].split()) <= CONFIG.block_words for r in blocks)
    shards = Counter(r["shard"] for r in blocks)
    assert all(n == CONFIG.shard_slots for k, n in shards.items() if k != max(shards))
    uses = Counter((r["source"], r["block"]) for r in blocks)
    assert max(uses.values()) <= 3


def test_empty_tables(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mixed_blocks(df.limit(0)).count() == 0
    assert {r["taken"] for r in mixing.mix(df.where("source = 'empty'")).collect()} == {0}
