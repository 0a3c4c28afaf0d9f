import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gleanery.llm import near_dedup

SCHEMA = "doc_id long, text string, n long, sketch string"


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(6))
    rows, at = [], 0
    for _ in range(25):
        base = [word() for _ in range(rng.choice([4, 12, 60, 200]))]
        for _ in range(rng.choice([1, 2, 5, 12])):
            w = list(base)
            for _ in range(int(len(w) * rng.choice([0, 0.02, 0.05, 0.1]))):
                w[rng.randrange(len(w))] = word()
            rows.append((at, rng.choice([" ", "  ", "\n"]).join(w).upper() if rng.random() < 0.2 else " ".join(w), 1, "x"))
            at += 1
    passage = " ".join(word() for _ in range(80))
    rows += [(at + i, passage + " " + " ".join(word() for _ in range(rng.randrange(10, 120))), 1, "x") for i in range(40)]
    rng.shuffle(rows)
    return rows


EDGES = [(9001, None, 1, "x"), (9002, "", 1, "x"), (9003, " \n ", 1, "x"), (9004, "solo", 1, "x"), (9005, "SOLO", 1, "x"), (9006, "a b", 1, "x"), (None, "a b", 1, "x"), (9007, "w " * 100_000, 1, "x"), (9008, "w w", 1, "x"), (9010, "one two three", 1, "x"), (9010, "four five six", None, None), (9011, "one two three", 1, "x"), (9012, "FOUR five six", 1, "x")]


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pairs_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {f"{x} {y}" for x, y in zip(w, w[1:], strict=False)} if len(w) > 1 else set(w)


def brute(rows):
    """All pairs by counting what they share; nothing of the engine is used."""
    sets = [pairs_of(t) for _, t, *_ in rows]
    holders, parent = {}, {d: d for d, *_ in rows if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, *_) in enumerate(rows):
        if a is None:
            continue
        both = collections.Counter(j for x in sets[i] for j in holders.get(x, ()))
        for j, n in both.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                x, y = find(a), find(rows[j][0])
                parent[max(x, y)] = min(x, y)
        for x in sets[i]:
            holders.setdefault(x, []).append(i)
    return sorted(((d, len(s), None if d is None else find(d), d is None or find(d) == d) for (d, *_), s in zip(rows, sets, strict=True)), key=str)


@pytest.mark.parametrize(("block", "refine"), [(2048, 1024), (4, 1024), (2048, 3), (2, 2)])
def test_matches_brute_force(spark, monkeypatch, block, refine):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "REFINE", refine)
    rows = corpus() + EDGES
    got = near_dedup.group(spark.createDataFrame(rows, SCHEMA).repartition(4)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_crowded_buckets_lose_no_link(spark):
    """2200 documents with a passage in common share bands by the thousand; the linked ones among them are all found."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    passage, rows = [word() for _ in range(60)], []
    while len(rows) < 2200:
        own = [word() for _ in range(34)]
        for _ in range(rng.choice([1, 1, 2, 3])):
            w = list(own)
            for _ in range(rng.randrange(8)):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows), " ".join([*passage, *w]), 1, "x"))
    sizes = collections.Counter(int(k) for r in rows for k in near_dedup.describe(pa.array([r[1]]))[2][0])
    assert max(sizes.values()) > 1024
    want = brute(rows)
    assert 500 < len({r[2] for r in want}) < 2150
    got = near_dedup.group(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == want


def test_small_sets_are_linked_exactly(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcde") for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 7, 22]))), 1, "x") for i in range(900)]
    rows += [(2000 + 2 * i + j, " ".join(f"w{i}n{k}" for k in range(4 + j)), 1, "x") for i in range(400) for j in range(2)]
    got = near_dedup.group(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_hot_group_and_kept_columns(spark):
    rows = [(i, "the same few words again and again here", i, "x") for i in range(1500)] + corpus(5)[:20]
    rows = [(10_000 + i if i >= 1500 else r[0], *r[1:]) for i, r in enumerate(rows)]
    kept = near_dedup.drop_near_copies(spark.createDataFrame(rows, SCHEMA))
    assert set(kept.columns) == {"doc_id", "text", "n", "sketch"}
    assert sorted(r["doc_id"] for r in kept.collect()) == [d for d, _, _, k in brute(rows[:1] + rows[1500:]) if k]


def test_empty_table(spark):
    assert near_dedup.group(spark.createDataFrame([], SCHEMA)).count() == 0


def test_signatures_estimate_jaccard_with_low_variance():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        x = rng.integers(0, 1 << 62, 300).astype(np.uint64)
        a, b = x[:200], x[100:]
        s = near_dedup.superminhash(np.concatenate([np.unique(a), np.unique(b)]), np.array([0, 200, 400]))
        errors.append((s[0] == s[1]).mean() - 1 / 3)
    assert abs(np.mean(errors)) < 0.02
    assert np.std(errors) < 1.05 * np.sqrt(1 / 3 * 2 / 3 / near_dedup.SLOTS)
    assert (s != near_dedup._FULL).all()


def test_every_slot_is_filled_for_small_sets():
    s = near_dedup.superminhash(np.array([5, 9], np.uint64), np.array([0, 1, 1, 2]))
    assert (s[0] != near_dedup._FULL).all() and (s[1] == near_dedup._FULL).all()
    assert sorted(s[0] >> 24) == list(range(near_dedup.SLOTS))  # one element takes each rank once
