"""Queries over the networks and word vectors, with small stated weights, so that SQL can compute the same by list arithmetic."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gleanery.functions import scores, text
from gleanery.operators import aspects, embeddings, keywords, neural, tagging
from gleanery.plans import queries, scoring
from gleanery.plans.queries import _PADDED, _DOCWORDS, _keyworded, _quote, _sql_clean, query, sql_words, table

_T = "coalesce(text, '')"
KNOWN = keywords.STOP_WORDS if isinstance(keywords.STOP_WORDS, tuple) else tuple(sorted(keywords.STOP_WORDS))


def _stated(*shape: int, at: int = 0) -> np.ndarray:
    """Weights that a rule gives: from -0.9 to 0.9 in tenths."""
    return ((((np.arange(np.prod(shape)) + at) * 37 + 11) % 19 - 9) / 10).reshape(shape)


VECTORS = {w: np.array([(i * 7 % 11 - 5) / 10, (i * 3 % 13 - 6) / 10]) for i, w in enumerate(KNOWN)}
GATE = {"x3": _stated(3, 2, 2), "x3b": _stated(2, at=3), "y3": _stated(3, 2, 2, at=5), "y3b": _stated(2, at=7), "fa": _stated(2, 2, at=2), "fab": _stated(2, at=9), "fc": _stated(2, 3, at=4), "fcb": np.array([0.31, 0.17, 0.23])}
TARGET = GATE | {"a3": _stated(3, 2, 2, at=8), "a3b": _stated(2, at=1)}


# SQL of the gated network: words to logits

_V = "map {" + ", ".join(f"{_quote(w)}: [{v[0]}::DOUBLE, {v[1]}::DOUBLE]" for w, v in VECTORS.items()) + "}"


def _look(toks: str) -> str:
    return f"list_transform({toks}, lambda t: coalesce({_V}[t], [0.0::DOUBLE, 0.0::DOUBLE]))"


def _conv(x: str, p: str, weight: np.ndarray, bias: np.ndarray, o: int) -> str:
    return "(" + " + ".join(f"{x}[{p} + {j}][{i + 1}] * ({weight[j, i, o]}::DOUBLE)" for j in range(weight.shape[0]) for i in range(weight.shape[1])) + f" + ({bias[o]}))"


def _tanh(x: str) -> str:
    return f"(1 - 2 / (exp(2 * {x}) + 1))"


def _gate_sql(source: str, w: dict[str, np.ndarray]) -> str:
    """``source``: columns k (key), toks, asp; gives k and logits."""
    if "a3" in w:
        each = [f"list_max(list_transform(range(1, len(asp) + 1), lambda p: greatest(0, {_conv('a', 'p', w['a3'], w['a3b'], o)})))" for o in (0, 1)]
        pooled, padded = ", ".join(each), f"list_concat([[0.0::DOUBLE, 0.0::DOUBLE]], {_look('asp')}, [[0.0::DOUBLE, 0.0::DOUBLE]])"
    else:
        pooled, padded = "list_avg(list_transform(a, lambda v: v[1])), list_avg(list_transform(a, lambda v: v[2]))", _look("asp")
    v = [f"m[1] * ({w['fa'][0, o]}) + m[2] * ({w['fa'][1, o]}) + ({w['fab'][o]})" for o in (0, 1)]
    f = [f"list_max(list_transform(range(1, len(s) - 1), lambda p: {_tanh(_conv('s', 'p', w['x3'], w['x3b'], o))} * greatest(0, {_conv('s', 'p', w['y3'], w['y3b'], o)} + v[{o + 1}])))" for o in (0, 1)]
    z = [f"f[1] * ({w['fc'][0, c]}) + f[2] * ({w['fc'][1, c]}) + ({w['fcb'][c]})" for c in range(3)]
    return f"""(SELECT * EXCLUDE (f), [{', '.join(z)}] AS z FROM (SELECT * EXCLUDE (s, v), [{', '.join(f)}] AS f FROM (SELECT * EXCLUDE (m), [{', '.join(v)}] AS v FROM
        (SELECT * EXCLUDE (a), [{pooled}] AS m FROM (SELECT *, {_look('toks')} AS s, {padded} AS a FROM {source})))))"""


_NAMES = "['negative', 'neutral', 'positive']"
_INPUT = f"(SELECT conv_id, turn, {_PADDED} AS toks, ({_PADDED})[1:2] AS asp FROM (SELECT conv_id, turn, {sql_words('lower(' + _T + ')')} AS w FROM conversations) WHERE len(w) > 0)"


def _gate_rows(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", text.cyclic_pad(text.whitespace_tokens(F.lower(F.coalesce("text", F.lit(""))))).alias("toks"))
    return rows.where(F.size("toks") > 0).withColumn("aspect", F.slice("toks", 1, 2))


def _gate_query(weights):
    def run(spark, d):
        rows = neural.score_aspects(_gate_rows(spark, d), "toks", "aspect", VECTORS, weights)
        return rows.select("conv_id", "turn", "sentiment", *[scores.rounded(F.get("score", F.lit(i)), 6).alias(n) for i, n in enumerate(("neg", "neu", "pos"))])

    return run


for _name, _w in (("gate_scores", GATE), ("gate_target_scores", TARGET)):
    query(_name, f"SELECT conv_id, turn, {_NAMES}[list_position(z, list_max(z))] AS sentiment, round(z[1], 6) AS neg, round(z[2], 6) AS neu, round(z[3], 6) AS pos FROM {_gate_sql(_INPUT, _w)}")(_gate_query(_w))


_SENTENCE = "regexp_replace(coalesce(text, ''), '[\\n\\r]+', ' ', 'g')"


def _cleaned(x: str) -> str:
    return sql_words(f"({_sql_clean().replace(_T, x)})")


_SCORED = f"""(SELECT k, turn, asp0 AS aspect, {_cleaned("array_to_string(padded, ' ')")} AS toks, {_cleaned("asp0")} AS asp FROM (
    SELECT k, turn, unnest(list_distinct(w[1:3])) AS asp0, {_PADDED} AS padded FROM (SELECT conv_id AS k, turn, {sql_words(_SENTENCE)} AS w FROM conversations) WHERE len(w) > 0))"""
_SHARES = "list_transform([1, 2, 3], lambda i: exp(z[i] - list_max(z)) / (exp(z[1] - list_max(z)) + exp(z[2] - list_max(z)) + exp(z[3] - list_max(z))))"


@query(
    "score_sentences",
    f"""SELECT k * 100000 + turn AS item, count(*) AS n, string_agg(aspect || '=' || coalesce(label, '?'), '; ' ORDER BY aspect) AS found, round(sum(((1 - p[2]) * (p[3] - p[1]) + 1) / 2), 5) AS compound
    FROM (SELECT k, turn, aspect, CASE WHEN len(toks) >= 3 AND len(asp) > 0 THEN {_NAMES}[list_position(z, list_max(z))] END AS label, CASE WHEN len(toks) >= 3 AND len(asp) > 0 THEN {_SHARES} END AS p FROM {_gate_sql(_SCORED, GATE)}) GROUP BY ALL""",
)
def score_sentences(spark, d):
    """Aspects of a sentence (its first words, stand-ins for detected ones) scored end to end and put back into one row a sentence."""
    line = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\n\\r]+", " ")
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("item"), line.alias("sentence"))
    rows = rows.withColumn("aspect", F.array_distinct(F.slice(text.whitespace_tokens(F.col("sentence")), 1, 3)))
    got = scoring.AspectScorer(VECTORS, GATE).score_sentences(rows, "item")
    found = F.transform(F.arrays_zip("aspect", "sentiment"), lambda x: F.concat_ws("=", x["aspect"], F.coalesce(x["sentiment"], F.lit("?"))))
    total = F.aggregate(F.filter("compound", lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x)
    some = F.exists("compound", lambda x: x.isNotNull())
    return got.select("item", F.size("aspect").cast("long").alias("n"), F.array_join(found, "; ").alias("found"), F.when(some, scores.rounded(total, 5)).alias("compound"))


# Taggers: the best path of a linear chain, labels by position

CHAIN = {"transition": _stated(3, 3, at=6), "start": _stated(3, at=12), "end": _stated(3, at=15)}
_STEPS = 4
_Z = f"list_transform(range({_STEPS}), lambda i: [CAST(embedding[3 * i + 1] AS DOUBLE), CAST(embedding[3 * i + 2] AS DOUBLE), CAST(embedding[3 * i + 3] AS DOUBLE)])"


def _emissions(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 3 * _STEPS).cast("array<double>").alias("e"))
    return rows.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(_STEPS - 1)), lambda i: F.slice("e", i * 3 + 1, 3)).alias("z"))


def _path_score() -> str:
    digit = lambda i: f"(c // {3**i} % 3 + 1)"
    array = lambda x: "[" + ", ".join(map(str, x)) + "]"
    parts = [f"{array(CHAIN['start'])}[{digit(0)}]", f"{array(CHAIN['end'])}[{digit(_STEPS - 1)}]"] + [f"z[{i + 1}][{digit(i)}]" for i in range(_STEPS)]
    parts += [f"{array([array(r) for r in CHAIN['transition']])}[{digit(i)}][{digit(i + 1)}]" for i in range(_STEPS - 1)]
    return " + ".join(parts)


@query("viterbi_paths", f"SELECT vec_id, array_to_string([{', '.join(f'best // {3**i} % 3' for i in range(_STEPS))}], '') AS path FROM (SELECT vec_id, arg_max(c, {_path_score()}) AS best FROM (SELECT vec_id, {_Z} AS z FROM embeddings), range({3**_STEPS}) t(c) GROUP BY vec_id)")
def viterbi_paths(spark, d):
    return _emissions(spark, d).select("vec_id", F.array_join(neural.best_paths(F.col("z"), CHAIN).cast("array<string>"), "").alias("path"))


_NORMED = f"list_transform(z, lambda r: list_transform([1, 2, 3], lambda c: r[c] - ln(list_sum(list_transform(z, lambda q: exp(q[c]))))))"


@query("position_labels", f"SELECT vec_id, array_to_string(list_transform(n, lambda r: list_position(r, list_max(r)) - 1), '') AS labels FROM (SELECT vec_id, {_NORMED} AS n FROM (SELECT vec_id, {_Z} AS z FROM embeddings))")
def position_labels(spark, d):
    return _emissions(spark, d).select("vec_id", F.array_join(neural.position_labels(F.col("z")).cast("array<string>"), "").alias("labels"))


def _labelled_sql() -> str:
    start = queries.SQL["aspect_terms"]
    changed = start.replace("THEN 1 ELSE 0 END) AS labels", "THEN 1 ELSE length(toks[i]) % 3 END) AS labels")
    if changed == start:
        raise ValueError("the labels of aspect_terms stand elsewhere now")
    return changed


@query("aspect_terms_labelled", _labelled_sql())
def aspect_terms_labelled(spark, d):
    """Aspects from raw labels of a model, which modifiers change; here the labels are the tokens' lengths modulo 3."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    rows = rows.withColumn("raw", F.transform(text.tokens(F.coalesce("text", F.lit(""))), lambda t: F.char_length(t) % 3))
    got = aspects.detect(rows, labels="raw")
    return got.select("conv_id", "turn", F.md5("sentence").alias("sentence_md5"), F.array_join("aspect", "; ").alias("aspect"))


@query("tagger_aspects")
def tagger_aspects(spark, d):
    """The tagger's labels fed into detection, end to end."""
    known = {w: np.concatenate([v, -v]) for w, v in VECTORS.items()}, VECTORS
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("toks", text.tokens(F.col("text")))
    rows = rows.withColumn("tag_ids", tagging.tag_ids(tagging.default_tagger(F.col("toks"))))
    labels = neural.infer_labels(rows, "item", "toks", "tag_ids", *known, neural.random_tagger(4, 2, filters=8), 200)  # tokens() gives 200 at most
    return aspects.detect(rows.select("item", "text").join(labels, "item"), labels="labels").select("item", "sentence", "aspect")


@query("argmax_index", "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS best FROM embeddings")
def argmax_index(spark, d):
    return table(spark, d, "embeddings").select("vec_id", scores.argmax_index(F.col("embedding")).cast("long").alias("best"))


@query("tag_mask", f"SELECT conv_id, turn, array_to_string(list_concat(list_transform({sql_words(_T)}[1:200], lambda t: '1'), list_transform(range(greatest(0, 200 - len({sql_words(_T)}))), lambda i: '0')), '') AS mask FROM conversations")
def tag_mask(spark, d):
    """Which places of a padded sentence hold a token."""
    n = F.least(F.size(text.whitespace_tokens(F.coalesce("text", F.lit("")))), F.lit(200))
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.repeat(F.lit("1"), n), F.repeat(F.lit("0"), 200 - n)).alias("mask"))


# Word vectors

_SUB = embeddings.Subwords(2, 97, 3, 4, table=np.array([[i * 31 % 101, i * 17 % 103] for i in range(97)], np.float32))
_CHARS = "list_transform(string_split('<' || {0} || '>', ''), lambda c: ord(c))"
_HASH = "list_reduce(list_concat([2166136261::BIGINT], list_transform(list_slice(b, i, i + n - 1), lambda c: c::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) % 97"
_GRAMS = f"list_transform(list_concat(list_transform(range(1, len(b) - 1), lambda i: [i, 3]), list_transform(range(1, greatest(1, len(b) - 2)), lambda i: [i, 4])), lambda g: {_HASH.replace('n - 1', 'g[2] - 1').replace('i + g', 'g[1] + g').replace('(b, i,', '(b, g[1],')})"


def _sub_sql(word: str, source: str) -> str:
    """``source`` with columns x and y: the word's vector."""
    return f"(SELECT *, list_avg(list_transform(ids, lambda i: i * 31 % 101)) AS x, list_avg(list_transform(ids, lambda i: i * 17 % 103)) AS y FROM (SELECT *, {_GRAMS} AS ids FROM (SELECT *, {_CHARS.format(word)} AS b FROM {source})))"


@query("subword_vectors", f"SELECT event_id, round(x, 4) AS x, round(y, 4) AS y FROM {_sub_sql('event_type', 'events')}")
def subword_vectors(spark, d):
    rows = _SUB.column(table(spark, d, "events").select("event_id", "event_type"), "event_type")
    return rows.select("event_id", *[scores.rounded(F.get("vec", F.lit(i)), 4).alias(n) for i, n in enumerate("xy")])


@query("subword_vectors_of_numbers", f"SELECT event_id, round(x, 4) AS x, round(y, 4) AS y FROM {_sub_sql('CAST(user_id AS VARCHAR)', 'events')}")
def subword_vectors_of_numbers(spark, d):
    rows = _SUB.column(table(spark, d, "events").select("event_id", "user_id"), "user_id")
    return rows.select("event_id", *[scores.rounded(F.get("vec", F.lit(i)), 4).alias(n) for i, n in enumerate("xy")])


@query("subword_vectors_of_arrays", f"SELECT event_id, 2 AS n, round(a.x + b.x, 4) AS x FROM {_sub_sql('event_type', 'events')} a JOIN {_sub_sql('CAST(user_id AS VARCHAR)', 'events')} b USING (event_id)")
def subword_vectors_of_arrays(spark, d):
    rows = _SUB.column(table(spark, d, "events").select("event_id", F.array("event_type", F.col("user_id").cast("string")).alias("words")), "words")
    return rows.select("event_id", F.size("vec").alias("n"), scores.rounded(F.aggregate(F.transform("vec", lambda v: F.get(v, F.lit(0))), F.lit(0.0), lambda a, x: a + x), 4).alias("x"))


_LANGS = "(SELECT DISTINCT event_type AS word FROM events)"


@query("vocabulary_growth", f"SELECT word, round(x, 4) AS x FROM {_sub_sql('word', _LANGS)} WHERE word > 'm' UNION ALL SELECT DISTINCT event_type, -1.0 FROM events WHERE event_type <= 'm'")
def vocabulary_growth(spark, d):
    """A table that knows some words gets vectors for the others."""
    words = table(spark, d, "events").select(F.col("event_type").alias("word"))
    known = words.where("word <= 'm'").distinct().withColumn("vec", F.array(F.lit(-1.0), F.lit(0.0)))
    return _SUB.fill(words, known).select("word", scores.rounded(F.get("vec", F.lit(0)), 4).alias("x"))


@query("mean_vector", "SELECT label, i - 1 AS i, round(avg(x), 6) AS x FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL")
def mean_vector(spark, d):
    rows = table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("vec"))
    got = embeddings.mean_vector(rows, "label")
    return got.select("label", F.posexplode("vec").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), scores.rounded("x", 6).alias("x"))


def _vector_table(spark, d):
    return table(spark, d, "embeddings").select(F.concat(F.lit("Word"), F.col("vec_id").cast("string")).alias("word"), F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("vec"))


@query("aspects_by_first_word", "SELECT doc_id, round(coalesce(a.embedding, b.embedding)[1]::DOUBLE, 6) AS x FROM documents LEFT JOIN embeddings a ON a.vec_id = doc_id JOIN embeddings b ON b.vec_id = 0")
def aspects_by_first_word(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("Word"), F.col("doc_id").cast("string"), F.lit(" of it")).alias("aspect"))
    return embeddings.aspects_from_first_word(rows, _vector_table(spark, d), unknown="Word0").select("doc_id", scores.rounded(F.get("vec", F.lit(0)), 6).alias("x"))


@query("aspects_by_table", "SELECT vec_id, round(embedding[2]::DOUBLE, 6) AS y FROM embeddings")
def aspects_by_table(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("wORD"), F.col("vec_id").cast("string")).alias("aspect"))
    return embeddings.aspects_from_table(rows, _vector_table(spark, d), 2).select("vec_id", scores.rounded(F.get("vec", F.lit(1)), 6).alias("y"))


@query("embedding_choice", "SELECT kind, CAST(doc_id AS VARCHAR) AS word, round(CASE WHEN kind = 'yelp' THEN -1 ELSE 1 END * coalesce(embedding[1]::DOUBLE, 0), 6) AS x FROM documents CROSS JOIN (VALUES ('glove'), ('yelp'), ('w2v')) t(kind) LEFT JOIN embeddings ON vec_id = doc_id")
def embedding_choice(spark, d):
    """The same words by each kind of table, chosen by name."""
    words = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("word"))
    have = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("word"), F.col("embedding").cast("array<double>").alias("vec"))
    kinds = {"glove": have, "w2v": have, "yelp": have.withColumn("vec", F.transform("vec", lambda x: -x))}
    out = [embeddings.embedding_table(k, kinds, words, 0.0, 64).select(F.lit(k).alias("kind"), "word", scores.rounded(F.get("vec", F.lit(0)), 6).alias("x")) for k in kinds]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("padding_vectors", "SELECT word, total FROM (VALUES ('<pad>', 0, 0), ('w0', 0, 1), ('w1', 0, 1)) t(word, kept, total)")
def padding_vectors(spark, d):
    """Unknown words have seeded vectors inside the scale and different from each other; the padding word has zeros."""
    words = spark.createDataFrame([("<pad>",), ("w0",), ("w1",)], "word string")
    got = embeddings.pretrained(words, words.limit(0).withColumn("vec", F.array(F.lit(0.0))), 0.25, 64)
    inside = F.forall("vec", lambda x: F.abs(x) <= 0.25) & (F.size(F.array_distinct("vec")) > 32)
    return got.select("word", inside.cast("int").alias("total"))


@query("known_words", f"SELECT word, count(*) AS n FROM {_DOCWORDS} WHERE word IN (SELECT unnest({sql_words('lower(' + _T + ')')}) FROM benchmark) GROUP BY word")
def known_words(spark, d):
    """Counts of the documents' words that the benchmark has: counted before they meet, so no word's rows do."""
    counts = _keyworded(spark, d).select(F.explode("keywords").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.join(table(spark, d, "benchmark").select(F.explode(text.whitespace_tokens(F.lower(F.coalesce("text", F.lit(""))))).alias("word")).distinct(), "word", "left_semi")
