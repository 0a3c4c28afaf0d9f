import hashlib
import random
import re

import pyarrow as pa
import pytest

from gleanery.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, item_id long"


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items, window=10):
    out = []
    for d, t, *_ in docs:
        w, hit, ids = words(t), set(), []
        for i, x in items:
            v = words(x)
            n = min(window, len(v))
            grams = {tuple(v[p : p + n]) for p in range(len(v) - n + 1)} if v else set()
            at = [p for p in range(len(w) - n + 1) if tuple(w[p : p + n]) in grams] if v else []
            hit |= {q for p in at for q in range(p, p + n)}
            if at:
                ids.append("null" if i is None else str(i))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def tables(seed=2):
    rng = random.Random(seed)
    vocab = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 9, 10, 11, 30])))) for i in range(25)]
    items += [(100, None), (101, "..."), (None, "null id item here"), (102, items[3][1]), (103, "aa " * 14)]
    docs = []
    for i in range(120):
        w = [rng.choice(vocab) for _ in range(rng.choice([0, 5, 40, 200]))]
        for _ in range(rng.choice([0, 0, 1, 3])):
            v = words(rng.choice(items)[1])
            a = rng.randrange(len(v) + 1)
            w[len(w) // 2 : len(w) // 2] = v[a : a + rng.choice([5, 9, 10, 12, 40])]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w).upper() if i % 3 == 0 else " ".join(w), i))
    docs += [(500, None, 1), (501, "", 1), (502, "?!", 1), (None, items[3][1], 1), (503, items[3][1], 1), (503, items[3][1], 1), (504, "zz " * 300_000 + items[5][1], 1), (505, "AA " * 40, 1)]
    return docs, items


@pytest.mark.parametrize("shard_words", [5_000_000, 60])
def test_matches_brute_force(spark, shard_words):
    docs, items = tables()
    got = decontaminate.decontaminate(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string"), shard_words=shard_words)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_empty_tables_and_kept_columns(spark):
    docs, items = tables()
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.decontaminate(d.limit(0), b).count() == 0
    assert decontaminate.decontaminate(d, b.limit(0)).where("contaminated or n_items > 0").count() == 0
    want = sorted(str(x[0]) for x in brute(docs, items) if not x[5])
    for words in (5_000_000, 60):
        kept = decontaminate.drop_contaminated(d, b, shard_words=words)
        assert kept.columns == ["doc_id", "text", "item_id"]
        assert sorted(str(r["doc_id"]) for r in kept.collect()) == want
    assert decontaminate.drop_contaminated(d, b.limit(0)).count() == d.count()


def test_every_window_shares_a_fingerprint():
    rng = random.Random(1)
    for _ in range(50):
        seq = " ".join(rng.choice("abcdefgh") * 3 for _ in range(40))
        w = seq.split()
        index = decontaminate.build(pa.table({"item_id": [1], "text": [seq]}))
        a = rng.randrange(31)
        _, found = decontaminate.scan(index, pa.array(["x y z " + " ".join(w[a : a + 10]) + " q r s"]))
        assert decontaminate.covered([(x, y) for x, y, _ in found[0]]) >= 10


def test_periodic_items_meet_once_a_place():
    item = "one two three " * 20_000
    index = decontaminate.build(pa.table({"item_id": [1, 2], "text": [item, "zz " * 50_000]}))
    assert len(index.hashes) < 100
    counts, found = decontaminate.scan(index, pa.array(["x " + "two three one " * 9_000 + "y", "zz " * 30_000, "one two three " * 3]))
    assert [decontaminate.covered([(a, b) for a, b, _ in f]) for f in found] == [27_000, 30_000, 0]
    assert counts.tolist() == [27_002, 30_000, 9]
