import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gleanery.llm import langid, toxicity

WORDS = {"xx": "tha ing the ould wer an", "yy": "ñor ción el la ez que", "zz": "sch ung der keit ü ich"}


def text(rng, lang, n, extra=()):
    return " ".join(rng.choice(WORDS[lang].split()) + rng.choice(WORDS[lang].split()) for _ in range(n)) + " " + " ".join(extra)


EDGES = [(900, None, "xx", 1), (901, "", "yy", 1), (902, "12 ?! 3", "xx", 1), (903, "a", None, 1), (None, "thaing wer", None, 1), (904, "schung " * 100_000, "zz", 1), (904, "schung", "zz", 1), (904, "schung", "zz", 1)]


def documents(n=240, seed=1):
    rng = random.Random(seed)
    return [(i, text(rng, lang := rng.choice(list(WORDS)), rng.randrange(5, 40)), lang if i % 9 else None, i) for i in range(n)] + EDGES


def test_language_predictions(spark):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long").repartition(3)
    got = langid.predict(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    by = {r["doc_id"]: r for r in got}
    held = [(by[d]["lang_pred"], lang) for d, _, lang, _ in rows[:240] if lang and by[d]["held_out"]]
    assert len(held) > 30 and sum(a == b for a, b in held) >= 0.95 * len(held)
    assert [(by[d]["lang_pred"], by[d]["score"]) for d in (900, 901, 902)] == [("und", 0.0)] * 3
    assert by[904]["lang_pred"] == "zz" and by[903]["lang_pred"] in WORDS
    kept = langid.keep_identified(df)
    assert set(kept.columns) == set(df.columns) and kept.count() == len(rows) - 3


def test_language_model_is_naive_bayes(spark):
    rows = documents(60)
    config = langid.LangConfig(buckets=1 << 10)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    model = langid.train(df, config)

    def seen(t):
        p = np.concatenate([[np.uint32(32)], langid.letters((t or "").encode()), [np.uint32(32)]]).astype(np.uint32)
        return np.concatenate(langid.grams(p, config.buckets))

    counts = {x: np.full(config.buckets, config.smoothing) for x in WORDS}
    for _, t, lang, _ in rows:
        if lang and t is not None:
            for g in seen(t):
                counts[lang][g] += 1
    want = np.array([np.log(counts[x] / counts[x].sum()) for x in sorted(WORDS)])
    assert model.langs == sorted(WORDS) and np.allclose(model.logp, want, atol=1e-5)
    # predictions, document by document and language by language
    texts = [r[1] for r in rows] + ["é", "ab", " x ", "1", "\u00df" * 3]
    langs, scores = model.score(pa.array(texts))
    for t, lang, score in zip(texts, langs, scores, strict=True):
        if not any(c.isalpha() for c in t or ""):
            assert (lang, score) == ("und", 0.0)
            continue
        g = seen(t)
        total = [sum(float(model.logp[j, x]) for x in g) for j in range(len(WORDS))]
        best = total.index(max(total))
        z = sum(np.exp((x - total[best]) * min(len(g), config.evidence) / len(g)) for x in total)
        assert lang == model.langs[best] and abs(score - 1 / z) < 1e-6
    for size in (1, 50, 1 << 20):  # whatever the batches
        got = []
        for lo, two, three, at, _ in langid.batches_of_grams(pa.array(texts), config.buckets, size):
            assert lo == len(got)
            got += [np.concatenate([x[a:b][x[a:b] < config.buckets] for x in (two, three)]) for a, b in zip(at[:-1], at[1:], strict=True)]
        assert all(np.array_equal(g, seen(t)) for g, t in zip(got, texts, strict=True))
    assert langid.predict(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(df.withColumn("lang", langid.F.lit(None).cast("string"))).collect()} == {"und"}


BAD = ("vilescum", "rotten")


def toxic_documents(n=900, seed=4):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.25
        extra = [rng.choice(BAD) + rng.choice(["", "ed", "s"]) for _ in range(3)] if bad else []
        w = text(rng, lang := rng.choice(list(WORDS)), rng.randrange(5, 40)).split() + extra
        rng.shuffle(w)
        rows.append((i, " ".join(w), lang, i))
        if i % 4:
            labels.append((i, int(bad), "x"))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_documents()
    docs = spark.createDataFrame(rows + EDGES, "doc_id long, text string, lang string, toxic long").repartition(3)
    said = spark.createDataFrame(labels + [(900, None, "x"), (None, 1, "x"), (5000, 1, "x")], "doc_id long, toxic int, text string")
    config = toxicity.ToxicConfig(epochs=10)
    got = toxicity.predict(docs, said, config).collect()
    assert len(got) == len(rows) + len(EDGES)
    by, truth = {r["doc_id"]: r for r in got}, {d: t for d, t, _ in labels}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 3 == 1)
    held = [(by[d]["predicted"], t) for d, t in truth.items() if by[d]["held_out"]]
    right = sum(a == b for a, b in held) / len(held)
    assert len(held) > 100 and right > 0.95
    assert by[900]["score"] == by[901]["score"] and by[900]["predicted"] == 0
    again = toxicity.predict(docs.repartition(2), said, config).collect()
    assert {(r["doc_id"], round(r["score"], 9)) for r in again} == {(r["doc_id"], round(r["score"], 9)) for r in got}


def test_toxicity_sample_is_bounded_in_bytes(spark, monkeypatch):
    rows, labels = toxic_documents(300)
    docs = spark.createDataFrame([*rows, (9000, "long " * 5000, "xx", 1)], "doc_id long, text string, lang string, toxic long")
    said = spark.createDataFrame([(d, t) for d, t, _ in labels] + [(9000, 0)], "doc_id long, toxic int")
    drawn = {}
    monkeypatch.setattr(toxicity, "fit", lambda texts, y, *rest: drawn.update(texts=texts.to_pylist(), y=y))
    for bound in (8000, 1 << 20):
        toxicity.train(docs, said, toxicity.ToxicConfig(sample_bytes=bound))
        sizes = [sum(len(t.encode()) for t, y in zip(drawn["texts"], drawn["y"], strict=True) if y == k) for k in (0, 1)]
        assert max(sizes) <= bound // 2 and min(sizes) > bound // 4 or bound == 1 << 20 and len(drawn["y"]) == len(labels) + 1


def test_toxicity_scores_match_a_plain_reading():
    """Score of a fitted model against a word-by-word convolution of each text alone."""
    rows, labels = toxic_documents(200)
    truth = {d: t for d, t, _ in labels}
    ids = [r for r in rows if r[0] in truth]
    m = toxicity.fit(pa.array([r[1] for r in ids]), np.array([truth[r[0]] for r in ids]), [r[2] for r in ids], (1.0, 1.0), toxicity.ToxicConfig(epochs=3))
    texts = [r[1] for r in rows[:40]] + [None, "", "?", "one", "Two WORDS", "x " * 3000]
    k = len(m.bias) // len(toxicity.WIDTHS)
    for t, got in zip(texts, m.score(pa.array(texts)), strict=True):
        f, _ = toxicity.features(*toxicity.textkit.buffer_of(pa.array([t], pa.string())), len(m.table))
        act, column = np.zeros(len(m.bias)), 0
        for i, w in enumerate(toxicity.WIDTHS):
            for q in range(k):
                sums = [sum(float(m.table[f[p + j], column + j * k + q].sum()) for j in range(w)) for p in range(len(f) - w + 1)]
                act[i * k + q] = max(sums) + m.bias[i * k + q] if sums else 0.0
            column += w * k
        z = m.scale[0] * (act @ m.out[:-1] + m.out[-1]) + m.scale[1]
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-4


def test_toxicity_without_labels(spark):
    rows, labels = toxic_documents(40)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic long")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.predict(docs, none).collect()} == {0.0}
    assert {r["score"] for r in toxicity.predict(docs, spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, toxic int")).collect()} == {1.0}
    assert toxicity.predict(docs.limit(0), none).count() == 0


def test_thresholds_by_language(spark):
    rows, labels = toxic_documents(400)
    truth = dict((d, t) for d, t, _ in labels)
    ids = [r for r in rows if r[0] in truth]
    m = toxicity.fit(pa.array([r[1] for r in ids]), np.array([truth[r[0]] for r in ids]), [r[2] for r in ids], (1.0, 1.0), toxicity.ToxicConfig(epochs=4))
    assert set(m.thresholds) == set(WORDS)
    df = spark.createDataFrame([("xx", m.thresholds["xx"]), ("xx", m.thresholds["xx"] - 0.01), ("??", 0.71), (None, 0.69)], "lang string, score double")
    assert [r["toxic_by_lang"] for r in toxicity.flag(df, m).collect()] == [True, False, True, False]


def test_pooling_matches_a_plain_convolution():
    rng = np.random.default_rng(0)
    k = 2
    table, bias = rng.standard_normal((16, 6 * k)).astype(np.float32), rng.standard_normal(3 * k).astype(np.float32)
    rows = np.array([0, 0, 1, 3, 10])
    f = rng.integers(0, 16, (10, 3))
    got, best = toxicity.pooled(table, f, rows, bias, where=True)
    for r in range(4):
        words, column = f[rows[r] : rows[r + 1]], 0
        for i, w in enumerate(toxicity.WIDTHS):
            for q in range(k):
                acts = [sum(table[words[p + j], column + j * k + q].sum() for j in range(w)) for p in range(len(words) - w + 1)]
                want = max(acts) + bias[i * k + q] if acts else 0
                assert got[r, i * k + q] == pytest.approx(want, abs=1e-5)
                assert best[r, i * k + q] == (rows[r] + int(np.argmax(acts)) if acts else -1)
            column += w * k
