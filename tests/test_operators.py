import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.functions import scores
from gleanery.operators import aspects, embeddings, keywords, neural, relational, sentiment, tagging, topics
from gleanery.plans import queries as plans
from gleanery.plans import scoring


def test_unroll_counts_and_mixed(spark):
    item = lambda *xs: [{"aspect": a, "sentiment": s} for a, s in xs]
    rows = [("zero", []), ("one", item(("a", "positive"))), ("equal", item(("a", "negative"), ("b", "negative"))), ("mixed", item(("a", "positive"), ("b", "negative")))]
    df = spark.createDataFrame(rows, "sentence string, aspect_sentiment array<struct<aspect:string,sentiment:string>>")
    out = relational.unroll(df, "aspect_sentiment")
    assert sorted((r["sentence"], r["aspect"], r["mixed"]) for r in out.collect()) == [("equal", "a", False), ("equal", "b", False), ("mixed", "a", True), ("mixed", "b", True), ("one", "a", False)]
    assert {r["sentiment"]: (r["n"], r["n_mixed"]) for r in relational.sentiment_counts(out).collect()} == {"positive": (2, 1), "negative": (3, 1)}
    train, test, mixed = relational.train_test(df, df, "aspect_sentiment")
    assert (train.count(), test.count(), mixed.count()) == (5, 5, 2)
    assert relational.category_examples(out).columns == ["text", "aspect", "sentiment"]


def test_other_review_forms(spark):
    df = spark.createDataFrame([("s", [("l a", "r", "positive"), ("l", "", "negative")])], "sentence string, left_right array<struct<left:string,right:string,sentiment:string>>")
    got = relational.target_examples(relational.unroll(df, "left_right")).collect()
    assert got[0]["left_text"] == ["<beg>", "l", "a", "<end>"] and got[1]["right_text"] == ["<beg>", "<end>"]
    df = spark.createDataFrame([("s", [(3, "t", "positive")])], "sentence string, offset array<struct<of:int,t:string,sentiment:string>>")
    assert [tuple(r) for r in relational.offset_examples(relational.unroll(df, "offset")).collect()] == [("s", 3, "t", "positive")]
    df = spark.createDataFrame([("s", ["a", "b"]), ("t", [])], "sentence string, aspect array<string>")
    rows = relational.aspect_rows(df)
    assert sorted((r["sentence"], r["aspect"], r["sentiment"]) for r in rows.collect()) == [("s", "a", ""), ("s", "b", "")]
    assert relational.aspect_rows(spark.createDataFrame([("s", "a")], "sentence string, aspect string")).count() == 1
    back = relational.collect_scores(rows.withColumn("doc_id", F.lit(1)).withColumn("score", F.array(F.lit(0.1))).withColumn("compound", F.lit(0.5)), "doc_id").first()
    assert back["aspect"] == ["a", "b"] and back["compound"] == [0.5, 0.5]


@pytest.mark.parametrize(("n", "dev"), [(5, 0), (25, 2), (0, 0), (100, 10)])
def test_train_dev_split(spark, n, dev):
    df = spark.range(n).withColumnRenamed("id", "k")
    got = relational.train_dev_split(df, "k", 0.1, seed=None)
    assert sorted(r["k"] for r in got.where("split = 'dev'").collect()) == list(range(n - dev, n))
    hashed = relational.train_dev_split(df, "k", 0.1, seed=3)
    assert hashed.where("split = 'dev'").count() == dev and hashed.count() == n
    compat = relational.train_dev_split(df, "k", 0.1, compat=True)
    assert compat.where("split = 'dev'").count() == (n if n and dev == 0 else dev)


def test_lookup_and_new_words(spark):
    words, known = spark.createDataFrame([("a",), ("b",), ("b",)], "word string"), spark.createDataFrame([("a", 7)], "word string, word_id int")
    assert sorted(r["word_id"] for r in relational.lookup(words, known, "word", F.lit(0), "word_id").collect()) == [0, 0, 7]
    assert [r["word"] for r in relational.new_words(words, known).collect()] == ["b"]


def test_phrases_and_ranks(spark):
    df = spark.createDataFrame([(1, "The fast engine and the fast car, not a slow car."), (2, ""), (3, None)], "doc_id long, text string")
    got = df.where("doc_id = 1").select(keywords.phrases(F.col("text")).alias("p")).first()["p"]
    assert got == ["fast engine", "fast car", "slow car"]
    ranks = {r["phrase"]: (r["score"], r["rank"]) for r in keywords.ranked_phrases(df, ["doc_id"]).collect()}
    assert ranks == {"slow car": (4.0, 1), "fast engine": (4.0, 2), "fast car": (4.0, 3)}


def test_tags(spark):
    assert len(tagging.TAG_IDS) == 45 and len(tagging.WORD_TAGS) == 36
    toks = ["The", "quick", "movie", "is", "really", "good", ",", "not", "running", "slowly", "42", "."]
    got = spark.createDataFrame([(toks,)], "t array<string>").select(tagging.default_tagger(F.col("t")).alias("g"))
    tags = got.first()["g"]
    assert tags == ["DT", "NN", "NN", "VBZ", "RB", "JJ", ",", "RB", "VBG", "RB", "CD", "."]
    ids = got.select(tagging.tag_ids(F.array(F.lit("NN"), F.lit("??"))).alias("i")).first()["i"]
    assert ids == [sorted(tagging.TAG_IDS).index("NN") + 1, None]


def sequential(toks, tags, raw):
    """Labels after a walk that changes them in place."""
    raw = list(raw)
    seen = []
    for i, (w, t) in enumerate(zip(toks, tags, strict=True)):
        bare = "".join(c for c in w if c.isascii() and (c.isalpha() or c in " /")).rstrip()
        if not bare or bare in aspects.SKIPPED_WORDS or t not in tagging.WORD_TAGS:
            continue
        if t in aspects.TRIGGERS and i + 1 < len(toks):
            raw[i], raw[i + 1] = 0, 1
            if i + 2 < len(toks) and tags[i + 1] in aspects.CHAINED:
                raw[i + 2] = 1
        if raw[i] in (1, 2) and t not in aspects.SILENT_TAGS:
            seen.append(bare)
    return raw, seen


def test_relabelling_equals_a_sequential_walk(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        n = rng.randrange(0, 9)
        rows.append((i, [rng.choice(["good", "is", "12", "a-b", "s", ","]) for _ in range(n)], [rng.choice(["DT", "JJ", "RB", "NN", "IN", "TO", "MD", ",", "VB"]) for _ in range(n)], [rng.choice([0, 0, 1, 2]) for _ in range(n)]))
    df = spark.createDataFrame(rows, "id int, toks array<string>, tags array<string>, raw array<int>")
    df = df.withColumn("trig", aspects.triggers(F.col("toks"), F.col("tags"))).withColumn("labels", aspects.relabel(F.col("raw"), F.col("tags"), F.col("trig")))
    got = {r["id"]: (r["labels"], r["words"]) for r in df.withColumn("words", aspects.aspect_words(F.col("toks"), F.col("tags"), F.col("labels"))).collect()}
    for i, toks, tags, raw in rows:
        want_raw, want = sequential(toks, tags, raw)
        assert got[i][1] == want
        assert [a for a, w, t in zip(got[i][0], toks, tags, strict=True) if t in tagging.WORD_TAGS] == [a for a, w, t in zip(want_raw, toks, tags, strict=True) if t in tagging.WORD_TAGS]


def test_detect(spark):
    df = spark.createDataFrame([(1, "The battery life is great but the screen is poor."), (2, ""), (3, None), (4, "Hello " * 300)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in aspects.detect(df).collect()}
    assert got[1]["aspect"] == ["battery life", "screen"] and got[1]["sentence"].endswith("poor .")
    assert got[2]["aspect"] == [] and got[3]["aspect"] == [] and len(got[4]["sentence"].split()) == 200
    bare = {r["doc_id"]: r["aspect"] for r in aspects.detect(df, extract_phrase=False).collect()}
    assert bare[1] == ["battery", "screen"]
    labelled = aspects.detect(df.where("doc_id = 1").withColumn("raw", F.array(*[F.lit(x) for x in (0, 0, 2, 0, 0, 0, 0, 0, 0, 0, 0)])), labels="raw", extract_phrase=False).first()
    assert labelled["aspect"] == ["battery", "life", "screen"]


def test_sentiment(spark):
    df = spark.createDataFrame([(1, "This is good."), (2, "This is not good."), (3, "This is very good. It is bad."), (4, ""), (5, None), (6, "Plain words.")], "id int, text string")
    got = {r["id"]: r for r in df.select("id", sentiment.lexicon_score(F.col("text")).alias("v"), sentiment.pattern_score(F.col("text")).alias("p"), sentiment.score_overall(F.col("text")).alias("o"), sentiment.score_sentiment(F.col("text"), "odd").alias("u")).collect()}
    assert got[1]["v"]["polarity"] == pytest.approx((1.9 / (1.9**2 + 15) ** 0.5 + 1) / 2) and got[2]["v"]["polarity"] < 0.5 < got[1]["v"]["polarity"]
    assert got[1]["v"]["scores"] == pytest.approx([0, 3 / 5.9, 2.9 / 5.9])
    a, b = (1.9 + 0.293), -2.1
    assert got[3]["v"]["polarity"] == pytest.approx(((a / (a * a + 15) ** 0.5 + b / (b * b + 15) ** 0.5) / 2 + 1) / 2)
    assert got[4]["v"] is None and got[5]["v"] is None and got[4]["o"]["label"] is None
    assert got[1]["p"]["polarity"] == pytest.approx((1.9 / 4 + 1) / 2) and got[6]["p"]["polarity"] == 0.5
    assert got[1]["o"]["label"] == "positive" and list(got[1]["u"]["scores"]) == [0.5] * 3
    means = sentiment.sentence_means(spark.createDataFrame([(1, 0.0, 1.0, 0.0, 0.5), (1, 1.0, 0.0, 0.0, 0.0)], "k int, neg double, neu double, pos double, compound double"), "k").first()
    assert tuple(means) == (1, 0.5, 0.5, 0.0, 0.25)


@pytest.mark.parametrize("k", [43, 53])
def test_scores_round_as_the_sql_does(spark, tmp_path, k):
    text = " ".join(["terrible."] * k + ["plain."] * (256 - k))  # neg comes to 0.5046875 and 0.5203125
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("overall_score", "lexicon_sentiment"):
        df = plans.QUERIES[name](spark, str(tmp_path))
        with duckdb.connect() as db:
            db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
            want = db.execute(f"SELECT {', '.join(df.columns)} FROM ({plans.SQL[name]})").fetchall()
        assert [tuple(r) for r in df.collect()] == want


def test_vocabulary_and_bags(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["a"]), (3, []), (4, ["Z", "é"])], "doc_id long, keywords array<string>")
    v = topics.vocabulary(df)
    assert [(r["word"], r["word_id"]) for r in v.orderBy("word_id").collect()] == [("Z", 0), ("a", 1), ("b", 2), ("é", 3)]
    bag = topics.bag_of_words(df, v)
    assert sorted((r["doc_id"], r["word_id"], r["n"]) for r in bag.collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 1), (4, 0, 1), (4, 3, 1)]
    only_first = topics.bag_of_words(df.where("doc_id = 4").select("doc_id", F.array(F.lit("Z")).alias("keywords")), v)
    assert topics.kept_documents(only_first).count() == 0 and topics.kept_documents(bag).count() == 3


@pytest.mark.parametrize("name", ["bag_of_words", "doc_filter", "perplexity"])
def test_word_queries_equal_sql_on_odd_documents(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(topics, "POSTED_WORDS", 10)
    docs = [(1, "b a b c"), (2, "a a"), (3, None), (4, ""), (5, "Z z"), (None, "b q"), (6, "a"), (7, "é ü é 日本")]
    for extra in ([], [(1, "b zz"), (2, "a"), (None, "a b"), (3, "x")]):  # the second time with doc_ids that repeat
        at = f"{tmp_path}/{len(extra)}"
        spark.createDataFrame([(*d, "en") for d in docs + extra], "doc_id long, text string, lang string").repartition(3).write.parquet(f"{at}/documents.parquet")
        df = plans.QUERIES[name](spark, at)
        with duckdb.connect() as db:
            db.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet/*.parquet'")
            want = db.execute(f"SELECT {', '.join(df.columns)} FROM ({plans.SQL[name]})").fetchall()
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def test_word_queries_move_no_pairs_of_document_and_word(spark):
    plan = lambda n: plans.QUERIES[n](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan("bag_of_words") and "HashAggregate" not in plan("bag_of_words").split("Scan")[0]
    assert "Exchange hashpartitioning(doc_id" not in plan("perplexity") and "Join" not in plan("perplexity")
    assert "word_id" not in plan("doc_filter") and "SortMergeJoin" not in plan("doc_filter")


def test_topic_dictionary(spark):
    table = topics.topic_table({"Problem": ["boom"], "New": ["zip"]})
    assert [t for t, _ in table][-1] == "New" and dict(table)["Problem"] == ["boom"] and len(table) == 11
    assert dict(topics.topic_table())["Problem"] == "error crash fail broken bug fault".split()
    df = spark.createDataFrame([("the PRICEY one, zip boom",), ("none xyz",), ("error test",)], "line string")
    got = [r["m"] for r in df.select(topics.match_topics(F.col("line"), table).alias("m")).collect()]
    assert got == ["Price Problem New", "", ""]
    beta = spark.createDataFrame([(0, 0, "a", 1.0), (0, 1, "b", 1.0), (0, 2, "zip", 3.0), (1, 0, "q", 0.1)], "topic int, word_id int, word string, weight double")
    rows = {r["topic"]: (r["words"], r["label"]) for r in topics.label_topics(topics.top_words(beta, 2), table).collect()}
    assert rows == {0: (["zip", "b"], "New - zip b"), 1: (["q"], " - q")}


def test_topic_gradients():
    rng = np.random.default_rng(0)
    m = topics.ProdLDA(7, topics.TopicConfig(n_topics=4, hidden=(5, 6), seed=1))
    x = rng.integers(0, 4, (9, 7)).astype(float)
    eps, masks = rng.standard_normal((9, 4)), (np.ones((9, 6)), np.ones((9, 4)))
    _, g = m.gradients(x, eps, masks)
    for name, value in m.p.items():
        for at in itertools.islice(np.ndindex(value.shape), 5):
            old = value[at]
            value[at] = old + 1e-5
            up = m.forward(x, True, eps, masks)[0].mean()
            value[at] = old - 1e-5
            down = m.forward(x, True, eps, masks)[0].mean()
            value[at] = old
            assert g[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-4, rel=1e-3), name


def test_topic_model(spark):
    rng = random.Random(0)
    groups = [["login", "account", "access"], ["slow", "time", "minute"]]
    rows = [(i, [rng.choice(groups[i % 2]) for _ in range(8)]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, keywords array<string>")
    config = topics.TopicConfig(n_topics=2, epochs=30, rate=0.02, batch=20)
    a, b = topics.TopicModel(df, config=config), topics.TopicModel(df, config=config)
    assert a.fit() and b.fit() and a.losses == b.losses and a.losses[-1] < a.losses[0]
    assert np.array_equal(a.model.p["wd"], b.model.p["wd"]) and a.perplexity() > 1
    assert a.top_words_and_topics().count() == 2
    small = topics.TopicModel(df.limit(3), config=config)
    assert small.fit() is False and small.top_words_and_topics().count() == 0 and small.perplexity() is None
    with pytest.raises(ValueError):
        a.with_config(most_cells=10).fit()


def test_topic_gradients_by_blocks_of_words(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.poisson(0.3, (23, 90)).astype(float)
    whole, parts = (topics.ProdLDA(90, topics.TopicConfig(n_topics=3, hidden=(5, 6))) for _ in range(2))
    loss, g = whole.gradients(topics.Bag.of(x))
    monkeypatch.setattr(topics, "BLOCK_CELLS", 170)
    again, h = parts.gradients(topics.Bag.of(x))
    assert again == pytest.approx(loss) and g.keys() == h.keys() == whole.p.keys()
    assert all(np.allclose(g[k], h[k]) for k in g)


def test_topic_model_takes_many_documents_of_many_words(spark):
    df = spark.range(16_000).select(F.col("id").alias("doc_id"), F.array(*[F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(13_000))) for k in range(6)]).alias("keywords"))
    model = topics.TopicModel(df, config=topics.TopicConfig(n_topics=2, hidden=(4, 4), epochs=1, batch=1000))
    assert model.fit() and len(model.x) * model.x.width > 200_000_000
    assert model.top_words_and_topics().count() == 2 and model.perplexity() > 1


def test_topic_model_holds_no_array_as_long_as_the_words(spark, monkeypatch):
    df = spark.range(60).select(F.col("id").alias("doc_id"), F.array(*[F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(150))) for k in range(9)]).alias("keywords"))
    config = topics.TopicConfig(n_topics=2, hidden=(4, 4), epochs=3, batch=20, rate=0.02)
    held = topics.TopicModel(df, config=config)
    assert held.fit()
    for name, value in (("HELD_CELLS", 100), ("BLOCK_CELLS", 170), ("BAG_ROWS", 90)):
        monkeypatch.setattr(topics, name, value)
    mapped = topics.TopicModel(df, config=config)
    assert mapped.fit() and mapped.losses == pytest.approx(held.losses) and mapped.perplexity() == pytest.approx(held.perplexity())
    m = mapped.model
    long = [x for x in (*m.p.values(), *itertools.chain(*m.moments.values(), *m.running.values()), mapped.x.ids, mapped.x.counts) if x.size > 100]
    assert len(long) == 19 and [type(x).__name__ for x in long] == ["memmap"] * 19
    # biases that a norm takes away again have a gradient of rounding errors alone
    assert all(np.allclose(m.p[k], held.model.p[k], atol=1e-6) for k in m.p if k not in ("bd", "bm", "bv")) and not hasattr(mapped.vocab, "__len__")
    got, want = ({(r["topic"], r["word"]): r["weight"] for r in x.beta().collect()} for x in (mapped, held))
    assert got == pytest.approx(want) and len(got) == 2 * m.p["wd"].shape[1]


def test_topic_query_reads_documents(spark, tmp_path):
    docs = [(i, " ".join(f"{'ab'[i % 2]}{(i * 7 + j) % 9}" for j in range(12)), "en") for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = plans.QUERIES["prodlda_topics"](spark, str(tmp_path)).collect()
    assert len(got) == 5 and {w for r in got for w in r["words"]} <= {w for _, t, _ in docs for w in t.split()}


def test_embeddings(spark):
    words = spark.createDataFrame([("a",), ("<pad>",), ("zz",)], "word string")
    known = spark.createDataFrame([("a", [1.0, 2.0])], "word string, vec array<float>")
    got = {r["word"]: r["vec"] for r in embeddings.pretrained(words, known, 0.25, 2).collect()}
    assert got["a"] == [1.0, 2.0] and got["<pad>"] == [0.0, 0.0] and all(-0.25 <= x <= 0.25 for x in got["zz"]) and any(got["zz"])
    assert got == {r["word"]: r["vec"] for r in embeddings.pretrained(words, known, 0.25, 2).collect()}
    assert any({r["word"]: r["vec"] for r in embeddings.review_vectors(words, known, 0.25, 2).collect()}["<pad>"])
    asp = spark.createDataFrame([("a b",), ("q r",)], "aspect string")
    assert {r["aspect"]: r["vec"] for r in embeddings.aspects_from_first_word(asp, known, unknown="a").collect()} == {"a b": [1.0, 2.0], "q r": [1.0, 2.0]}
    table = spark.createDataFrame([("Food", [3.0, 4.0])], "word string, vec array<double>")
    got = {r["aspect"]: r["vec"] for r in embeddings.aspects_from_table(spark.createDataFrame([("FOOD",), ("x",)], "aspect string"), table, 2).collect()}
    assert got["FOOD"] == [3.0, 4.0] and len(got["x"]) == 2
    with pytest.raises(ValueError):
        embeddings.embedding_table("other", {}, words, 0.1, 2)
    mean = embeddings.mean_vector(spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0])], "k int, vec array<double>"), "k").first()
    assert mean["vec"] == [2.0, 3.0]


def test_subwords_and_nearest(spark):
    s = embeddings.Subwords(8, 256)
    df = spark.createDataFrame([(1, "price", ["a", "price"], 5), (2, None, None, 6)], "id int, w string, ws array<string>, n int")
    r = s.column(s.column(s.column(df, "w"), "ws", "many"), "n", "num").orderBy("id").collect()
    assert r[0]["vec"] == pytest.approx(s.vector("price")) and r[0]["many"][1] == pytest.approx(r[0]["vec"]) and r[0]["num"] == pytest.approx(s.vector("5")) and r[1]["vec"] is None
    filled = s.fill(spark.createDataFrame([("a",), ("b",)], "word string"), spark.createDataFrame([("a", [0.0] * 8)], "word string, vec array<double>"))
    assert {x["word"] for x in filled.collect()} == {"a", "b"}
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = embeddings.nearest(rows.where("vec_id = 0"), rows, 2).orderBy("rank").collect()
    assert [x["vec_id"] for x in got] == [1, 2]
    with pytest.raises(ValueError):
        embeddings.nearest(rows, rows, 1, most_queries=2)


def test_nearest_multiplies_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "QUERY_BLOCK", 7)
    monkeypatch.setattr(embeddings, "TABLE_BLOCK", 30)
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (200, 6)).astype(float)  # with many ties
    x[[20, 40, 60]] = 0
    vectors = [*map(list, x.tolist()), None, [1.0, None, 2.0, 0.0, 0.0, 1.0], [1.0, 2.0], [float("nan")] * 6, [1e200] * 6]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    queries = rows.where("vec_id % 10 = 0 or vec_id > 198")
    for k in (4, 300):
        found = embeddings.nearest(queries, rows, k)
        got = sorted((r["query_id"], r["rank"], r["vec_id"], repr(r["cosine"])) for r in found.collect())
        pairs = rows.join(queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), F.expr("vec_id <> query_id")).withColumn("cosine", scores.cosine(F.col("q"), F.col("embedding")))
        w = W.partitionBy("query_id").orderBy(scores.rounded("cosine", 9).desc_nulls_last(), "vec_id")
        want = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        assert got == sorted((r["query_id"], r["rank"], r["vec_id"], repr(r["cosine"])) for r in want.collect())
    plan = embeddings.nearest(rows.where("vec_id < 200"), rows.where("vec_id < 200"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan


def test_networks(spark, tmp_path):
    rng = np.random.default_rng(0)
    x, w, b = rng.standard_normal((7, 3)), rng.standard_normal((5, 3, 2)), rng.standard_normal(2)
    padded = np.vstack([np.zeros((2, 3)), x, np.zeros((2, 3))])
    want = [[sum(padded[i + j, c] * w[j, c, o] for j in range(5) for c in range(3)) + b[o] for o in range(2)] for i in range(7)]
    assert np.allclose(neural.conv1d(x, w, b, 2), want)
    logits = rng.standard_normal((6, 3))
    assert (neural.labels_of(logits, "class") == logits.argmax(axis=1)).all()
    lsm = logits - np.log(np.exp(logits).sum(axis=0))
    assert (neural.labels_of(logits) == lsm.argmax(axis=1)).all()
    t, s, e = rng.standard_normal((3, 3)), rng.standard_normal(3), rng.standard_normal(3)
    score = lambda p: s[p[0]] + e[p[-1]] + sum(logits[i, k] for i, k in enumerate(p)) + sum(t[a, c] for a, c in itertools.pairwise(p))
    assert neural.viterbi(logits, t, s, e) == list(max(itertools.product(range(3), repeat=6), key=score))

    general, domain = {"good": rng.standard_normal(4)}, {"good": rng.standard_normal(3)}
    bundle = neural.random_tagger(4, 3, filters=4)
    neural.save_bundle(str(tmp_path / "w.npz"), bundle)
    assert all(np.array_equal(v, bundle[k]) for k, v in neural.load_bundle(str(tmp_path / "w.npz")).items())
    df = spark.createDataFrame([(1, ["good", "day"], [7, None]), (2, [], [])], "id long, toks array<string>, tags array<int>")
    assert neural.padded_width(df, "toks") == 130
    got = {r["id"]: r["labels"] for r in neural.infer_labels(df, "id", "toks", "tags", general, domain, bundle, 130).collect()}
    g, d, tags = np.zeros((130, 4)), np.zeros((130, 3)), np.zeros(130, int)
    g[0], d[0], tags[0] = general["good"], domain["good"], 7
    assert got == {1: neural.labels_of(neural.tag_rows(g, d, tags, bundle))[:2].tolist(), 2: []}

    rows = spark.createDataFrame([(1, list("abcde"), ["a", "b"]), (2, ["a"], ["a"]), (3, None, ["a"])], "id int, toks array<string>, aspect array<string>")
    vectors = {c: rng.standard_normal(4) for c in "abcde"}
    for target in (False, True):
        gate = neural.random_gate(4, 4, maps=3, target=target)
        got = {r["id"]: r for r in neural.score_aspects(rows, "toks", "aspect", vectors, gate, ("positive", "negative", "neutral")).collect()}
        want = neural.gate(np.array([vectors[c] for c in "abcde"]), np.array([vectors[c] for c in "ab"]), gate)
        assert got[1]["score"] == pytest.approx([want[1], want[2], want[0]]) and got[2]["score"] is None and got[3]["sentiment"] is None


def test_tagger_takes_a_few_sentences_at_a_time(spark):
    few, n = neural.tag_rows, 600
    toks = [[f"t{(i * j) % 11}" for j in range(i % 9)] if i % 7 else None for i in range(n)]
    toks[500] = ["t1"] * 150
    df = spark.createDataFrame([(i, t, None if t is None else [(i + j) % 46 for j in range(len(t))]) for i, t in enumerate(toks)], "item long, toks array<string>, tag_ids array<int>").coalesce(1)
    known = {f"t{i}": np.full(2, i / 7) for i in range(9)}
    w = neural.random_tagger(2, 2, filters=2)
    got = neural.infer_labels(df, "item", "toks", "tag_ids", known, known, w, 130)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    rows = {r["item"]: r["labels"] for r in got.collect()}
    assert len(rows) == n and all(len(rows[i]) == len(t or []) for i, t in enumerate(toks))
    look = lambda t, width: np.array([known.get(x, np.zeros(2)) for x in t] + [np.zeros(2)] * (width - len(t)))
    for i in (1, 5, 8, 130, 255, 499, 500, 599):
        t = toks[i] or []
        v, tags = look(t, max(130, len(t))), np.array([(i + j) % 46 for j in range(len(t))] + [0] * (max(130, len(t)) - len(t)))
        assert rows[i] == neural.labels_of(few(v[None], v[None], tags[None], w))[0, : len(t)].tolist()


def test_aspect_scorer(spark):
    rng = np.random.default_rng(1)
    vectors, weights = {w: rng.standard_normal(4) for w in ("the", "food", "was", "good")}, neural.random_gate(4, 4, maps=3)
    scorer = scoring.AspectScorer(vectors, weights, "topic")
    df = spark.createDataFrame([(1, "the food was good", ["food", "the food"]), (2, "nothing here", [])], "doc_id long, sentence string, aspect array<string>")
    assert [r["sentence"] for r in scorer.inputs(df).collect()] == ["the food was good the"] * 2
    got = scorer.score_sentences(df, "doc_id").collect()
    assert [r["doc_id"] for r in got] == [1] and got[0]["aspect"] == ["food", "the food"] and all(0 <= c <= 1 for c in got[0]["compound"])
    want = neural.gate(np.array([vectors[w] for w in "the food was good the".split()]), np.array([vectors["food"]]), weights)
    assert got[0]["score"][0] == pytest.approx(want.tolist())
    transfer = spark.createDataFrame([("r", "food", "kw", "neutral")], "Response string, aspect string, keyword string, sentiment_name string")
    assert scorer.examples(transfer).first()["aspect"] == "food" and scoring.AspectScorer(vectors, weights).examples(transfer).first()["aspect"] == "kw"
    with pytest.raises(ValueError):
        scoring.AspectScorer(vectors, weights, "other")
