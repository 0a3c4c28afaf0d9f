import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gleanery.llm import line_dedup
from gleanery.llm.line_dedup import LineConfig

SCHEMA = "doc_id long, text string, a string, line long"


def split(t):
    """Lines of a text as (begin, end, words)."""
    out, now = [], []
    found = list(re.finditer(r"[^\x20\x09-\x0D]+", t))
    for i, m in enumerate(found):
        now.append(m)
        gap = t[m.end() : found[i + 1].start()] if i + 1 < len(found) else "\n"
        if m[0][-1] in ".!?" or "\n" in gap:
            out.append((now[0].start(), m.end(), [x[0] for x in now]))
            now = []
    return out


def rows(seed=3):
    rng = random.Random(seed)
    sentence = lambda: " ".join(rng.choice("abcdefghijk") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 14))) + rng.choice([".", "!", "", "?"])
    passages = [[sentence() for _ in range(rng.randrange(3, 9))] for _ in range(6)]
    out = []
    for i in range(70):
        parts = [[sentence() for _ in range(rng.randrange(0, 6))] for _ in range(3)]
        for p in rng.sample(passages, rng.randrange(0, 3)):
            parts.insert(rng.randrange(len(parts)), p[rng.randrange(2) :])
        out.append((i, rng.choice(["\n", " "]).join(x for p in parts for x in p), "x", 1))
    rng.shuffle(out)
    return out + [(500, None, "x", 1), (501, "", None, 1), (None, out[0][1], "x", 1), (502, "word " * 50_000, "x", 1), (503, "word " * 50_000, "x", 1), (504, out[1][1], "x", 1), (504, out[1][1], "x", 1), (505, " \n\n ", "x", 1)]


@pytest.mark.parametrize("c", [LineConfig(), LineConfig(8)])
def test_matches_brute_force(spark, c):
    data = rows()
    got = line_dedup.dedup_lines(spark.createDataFrame(data, SCHEMA).repartition(4), c)
    assert sorted(map(tuple, got.select("doc_id", "n_lines", "n_dropped", "n_words_dropped", "text").collect()), key=str) == whole(data, c, True)
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_identical_documents_go_whatever_their_lines(spark):
    rng = random.Random(12)
    line = lambda n: " ".join("".join(rng.choice("qwertzuiop") for _ in range(9)) for _ in range(n))
    short = "\n".join(line(4) for _ in range(40))
    odd, even = [line(7) for _ in range(5)], [line(7) for _ in range(5)]
    both = "\n".join(x for p in zip(odd, even, strict=True) for x in p)
    data = [(1, short), (2, short), (11, "\n".join(f"{x}\n{line(9)}" for x in odd)), (12, "\n".join(f"{line(9)}\n{x}" for x in even)), (13, both), (14, both)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame([(*d, "x", 1) for d in data], SCHEMA)).collect()}
    assert (got[2]["n_dropped"], got[2]["text"]) == (40, "") and (got[14]["n_dropped"], got[14]["text"]) == (10, "")
    assert all(got[d]["n_dropped"] == 0 for d in (1, 11, 12, 13))


def test_colliding_hashes_delete_nothing():
    """A run whose hashes agree but whose words don't stays."""
    text = "alpha beta gamma delta epsil zeta theta kappa lambd omicr " * 2 + "end."
    twin = text.replace("alpha", "ALPHA")
    x, y = (line_dedup.column_lines(pa.array([t])) for t in (text, twin))
    block = x.hashes.view(np.int64).tolist()
    proof = line_dedup.run_digest(text.encode(), x, 0, 1)
    assert line_dedup.cut(text, [{"block": block, "proof": proof}]) == ("", 1, 21)
    forged = y.hashes.view(np.int64).tolist()
    assert line_dedup.cut(twin, [{"block": forged, "proof": proof}]) == (twin, 0, 0)
    assert line_dedup.run_digest(b" alpha \n beta  x.", line_dedup.column_lines(pa.array([" alpha \n beta  x."])), 1, 1) == line_dedup.run_digest(b"beta x.", line_dedup.column_lines(pa.array(["beta x."])), 0, 1)


def test_shared_passages_go_and_clean_documents_stay(spark):
    rng = random.Random(1)
    line = lambda: " ".join("".join(rng.choice("qwertzuiop") for _ in range(7)) for _ in range(9)) + "."
    passage = " ".join(line() for _ in range(7))
    data = [(i, f"{line()} {line()}\n{passage}\n{line()}", "x", 1) for i in range(1200)] + [(5000 + i, f"{line()}\n{line()}", "x", 1) for i in range(50)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got[0]["n_dropped"] == 0 and all(got[i]["n_words_dropped"] == 63 and passage not in got[i]["text"] for i in range(1, 1200))
    assert all(got[5000 + i]["n_dropped"] == 0 for i in range(50))


def test_patience_aligns_in_order():
    rng = random.Random(2)
    for _ in range(200):
        a, b = [rng.randrange(12) for _ in range(rng.randrange(30))], [rng.randrange(12) for _ in range(rng.randrange(30))]
        got = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
    x = list(range(50))
    assert line_dedup.patience(x[:20] + [99] + x[20:], x) == [(i + (i >= 20), i) for i in x]


def test_line_counts_agree():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab .!?\n\t") for _ in range(rng.randrange(60))) for _ in range(300)] + [None, "", "é.\nñ"]
    column = pa.array(texts)
    want = [len(split(t or "")) for t in texts]
    assert line_dedup.count_lines(column).tolist() == want
    lines = line_dedup.column_lines(column)
    assert (lines.rows[1:] - lines.rows[:-1]).tolist() == want


def held(a, b, words, least):
    """Places of a in any run of lines that b holds too and that has enough words: by all runs of all places."""
    out = set()
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if sum(words[i : i + n]) >= least:
                out |= set(range(i, i + n))
    return out


def test_blocks_are_found_without_unique_lines():
    rng = random.Random(11)
    size = [rng.randrange(1, 12) for _ in range(40)]
    passage = [1, 2, 3, 4]
    for k in range(400):
        if k == 0:  # twice on one side, never at an end, no line unique on both
            a, b = [30, *passage, 31, *passage, 32], [33, *passage, 34, *passage, 35]
        else:
            a, b = ([rng.randrange(rng.choice([3, 8, 30])) for _ in range(rng.randrange(40))] for _ in range(2))
        words = [size[x] for x in a]
        got = line_dedup.common_blocks(a, b, words, 20)
        assert all(a[i : i + n] == b[j : j + n] and sum(words[i : i + n]) >= 20 for i, j, n in got)
        assert {p for i, _, n in got for p in range(i, i + n)} == held(a, b, words, 20)


def whole(rows, c, texts=False):
    """(doc_id, n_lines, n_dropped, n_words_dropped, and the text that is left): every run of enough words that any earlier document holds is dropped."""
    lines = [split(t or "") for _, t, *_ in rows]
    keys = [[tuple(w) for *_, w in x] for x in lines]
    out = []
    for (d, t, *_), mine, a in zip(rows, lines, keys, strict=True):
        size, drop = [len(k) for k in a], set()
        for (e, *_), b in zip(rows, keys, strict=True):
            if d is not None and e is not None and e < d:
                drop |= held(a, b, size, c.block_words)
        kept, at = "", 0
        for p in sorted(drop):
            kept += t[at : mine[p][0]]
            at = mine[p + 1][0] if p + 1 < len(mine) else len(t)
        out.append((d, len(a), len(drop), sum(size[p] for p in drop), *([None if t is None else kept + t[at:]] if texts else [])))
    return sorted(out, key=str)


def dropped(spark, data):
    return sorted(map(tuple, line_dedup.dedup_lines(spark.createDataFrame(data, SCHEMA).repartition(4)).select("doc_id", "n_lines", "n_dropped", "n_words_dropped").collect()), key=str)


def test_runs_are_found_whichever_documents_hold_their_lines_first(spark):
    rng = random.Random(4)
    line = lambda n: " ".join("".join(rng.choice("qwertzuiop") for _ in range(9)) for _ in range(n)) + "."
    x, y, z = line(7), line(2), line(12)
    data = [(12, f"{x}\n{line(9)}"), (76, f"{line(8)}\n{z}"), (552, f"{line(6)}\n{x}\n{y}\n{z}\n{line(6)}"), (2079, f"{line(5)}\n{x}\n{y}\n{z}")]
    # a run whose end only a later holder has: its shortest run from the start is 300's first
    p, q, r = line(15), line(15), line(3)
    data += [(300, f"{p}\n{q}\n{line(4)}"), (301, f"{line(4)}\n{p}\n{q}\n{r}\n{line(4)}"), (302, f"{line(4)}\n{p}\n{q}\n{r}")]
    data = [(*d, "x", 1) for d in data]
    got = dropped(spark, data)
    assert (2079, 4, 3, 21) in got and (302, 4, 3, 33) in got
    assert got == whole(data, LineConfig())


def test_passages_in_short_lines_go(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("qwertzuiop") for _ in range(8))
    verse, table, mixed = ([" ".join(word() for _ in range(rng.choice(n))) for _ in range(24)] for n in ([1], [2, 3], [1, 4, 6]))
    data = [(i, "\n".join([f"{word()} {word()}", *x, word()])) for i, x in enumerate([verse, table, mixed, verse[3:], table[5:20], mixed[2:9], verse[:19], [*verse[:6], *table[:4], *verse[6:]]])]
    data = [(*d, "x", 1) for d in [*data, (90, "a\nb\n" * 30), (91, "b\na\n" * 30), (92, "a\n" * 19), (93, "a\n" * 19)]]
    got = {r[0]: r for r in dropped(spark, data)}
    assert got[3][2] == 21 and got[4][2] == 15 and got[6][2] == got[93][2] == 0 and got[91][2] == 60
    assert list(got.values()) == whole(data, LineConfig())
    assert dropped(spark, rows(8)) == whole(rows(8), LineConfig())
