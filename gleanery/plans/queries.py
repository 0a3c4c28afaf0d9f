"""The registered queries over the driver's tables and their SQL for DuckDB. Every query reads whole tables and texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import scores, text
from gleanery.operators import aspects, embeddings, keywords, neural, relational, sentiment, tagging, topics
from gleanery.plans import scoring

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(c: str = "text"):
    return F.coalesce(F.col(c), F.lit(""))


# SQL fragments

_T = "coalesce(text, '')"


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_words(x: str) -> str:
    return f"list_filter(string_split_regex(trim({x}, ' '), '\\s+'), lambda w: w <> '')"


def sql_tokens(x: str) -> str:
    for pattern, into in text.TOKEN_STEPS:
        x = f"regexp_replace({x}, {_quote(pattern)}, {_quote(into.replace('$', chr(92)))}, 'g')"
    return sql_words(x)


_STOPS = ", ".join(map(_quote, keywords.STOP_WORDS))
_DELIM = f"(lower(t) IN ({_STOPS}) OR NOT regexp_matches(t, '[A-Za-z0-9]|[^\\x00-\\x7F]'))"


def sql_phrases(toks: str) -> str:
    joined = f"array_to_string(list_transform({toks}, lambda t: CASE WHEN {_DELIM} THEN chr(10) ELSE lower(t) END), ' ')"
    return f"list_filter(list_transform(string_split({joined}, chr(10)), lambda p: trim(p, ' ')), lambda p: p <> '')"


_BARE = "rtrim(regexp_replace(t, '[^ /A-Za-z]+', '', 'g'), ' ')"
_SKIP = ", ".join(map(_quote, aspects.SKIPPED_WORDS))
_WORDTAGS = ", ".join(map(_quote, sorted(tagging.WORD_TAGS)))
_TRIG = ", ".join(map(_quote, aspects.TRIGGERS))
_SILENT = ", ".join(map(_quote, aspects.SILENT_TAGS))
_PASS = f"({_BARE} <> '' AND {_BARE} NOT IN ({_SKIP}) AND tags[i] IN ({_WORDTAGS}))"
_RELABEL = f"""
    t0 AS (SELECT conv_id, turn, list_slice({sql_tokens(_T)}, 1, 200) AS toks, {sql_phrases(sql_tokens(_T))} AS phr FROM conversations),
    t1 AS (SELECT *, list_transform(toks, lambda t: {tagging.tag_sql("t")}) AS tags FROM t0),
    t2 AS (SELECT *, list_transform(toks, lambda t, i: {_PASS} AND tags[i] IN ({_TRIG}) AND i < len(toks)) AS trig FROM t1),
    t3 AS (SELECT *, list_transform(toks, lambda t, i: CASE WHEN trig[i] THEN 0
        WHEN i > 1 AND trig[i - 1] THEN 1 WHEN i > 2 AND trig[i - 2] AND tags[i - 1] IN ('JJ', 'RB') THEN 1 ELSE 0 END) AS labels FROM t2)"""


# Functions


def _sql_clean() -> str:
    x = f"regexp_replace({_T}, '[^`''!?,()0-9A-Za-z]', ' ', 'g')"
    for s in text._CONTRACTIONS:
        x = f"replace({x}, {_quote(s)}, {_quote(' ' + s)})"
    for s in text._PLAIN + text._GUARDED:
        x = f"replace({x}, {_quote(s)}, {_quote(f' {chr(92)}{s} ' if s in text._GUARDED else f' {s} ')})"
    return f"trim(regexp_replace({x}, '\\s{{2,}}', ' ', 'g'), ' ')"


@query("clean_text", f"SELECT doc_id, {_sql_clean()} AS clean FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean_text(_text()).alias("clean"))


@query("keep_alpha", f"SELECT doc_id, rtrim(regexp_replace({_T}, '[^ /A-Za-z]+', '', 'g'), ' ') AS kept FROM documents")
def keep_alpha(spark, d):
    return table(spark, d, "documents").select("doc_id", text.keep_alpha(_text()).alias("kept"))


@query("keep_alphanumeric", f"SELECT doc_id, regexp_replace({_T}, '[^ ''.0-9A-Za-z]+', ' ', 'g') AS kept FROM documents")
def keep_alphanumeric(spark, d):
    return table(spark, d, "documents").select("doc_id", text.keep_alphanumeric(_text()).alias("kept"))


@query("keep_alphanumeric_slash", f"SELECT doc_id, regexp_replace({_T}, '[^ ''./0-9A-Za-z]+', ' ', 'g') AS kept FROM documents")
def keep_alphanumeric_slash(spark, d):
    return table(spark, d, "documents").select("doc_id", text.keep_alphanumeric(_text(), slash=True).alias("kept"))


@query("text_md5", "SELECT doc_id, md5(text) AS digest FROM documents")
def text_md5(spark, d):
    return table(spark, d, "documents").select("doc_id", text.text_md5(F.col("text")).alias("digest"))


@query("word_tokens", f"SELECT doc_id, len(k) AS n_tokens, md5(array_to_string(k, ' ')) AS digest FROM (SELECT doc_id, {sql_tokens(_T)} AS k FROM documents)")
def word_tokens(spark, d):
    rows = table(spark, d, "documents").select("doc_id", text.tokens(_text(), None).alias("k"))
    return rows.select("doc_id", F.size("k").cast("long").alias("n_tokens"), F.md5(text.detokenize(F.col("k"))).alias("digest"))


_SENTENCES = "list_filter(string_split(regexp_replace(trim({0}, ' '), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


@query("sentences", f"SELECT doc_id, len(s) AS n_sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest FROM (SELECT doc_id, {_SENTENCES.format(_T)} AS s FROM documents)")
def sentences(spark, d):
    rows = table(spark, d, "documents").select("doc_id", text.sentences(_text()).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", lambda x: F.char_length(x))), F.lit(0)).cast("long").alias("longest"))


_PADDED = "CASE WHEN len(w) = 0 THEN NULL WHEN len(w) < 6 THEN list_slice(flatten([w, w, w, w, w]), 1, greatest(5, len(w))) ELSE w END"


@query("cyclic_pad", f"SELECT item, array_to_string({_PADDED}, ' ') AS padded FROM (SELECT conv_id * 100000 + turn AS item, {sql_words(_T)} AS w FROM conversations UNION ALL SELECT -1 - doc_id, {sql_words('lang')} FROM documents)")
def cyclic_pad(spark, d):
    a = table(spark, d, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("item"), text.whitespace_tokens(_text()).alias("w"))
    b = table(spark, d, "documents").select((-1 - F.col("doc_id")).alias("item"), text.whitespace_tokens(F.col("lang")).alias("w"))
    return a.unionByName(b).select("item", F.array_join(text.cyclic_pad(F.col("w")), " ").alias("padded"))


@query("first_word", f"SELECT doc_id, {sql_words(_T)}[1] AS word FROM documents")
def first_word(spark, d):
    return table(spark, d, "documents").select("doc_id", text.first_word(_text()).alias("word"))


@query("sentiment_names", "SELECT doc_id, CASE quality - toxic WHEN -1 THEN 'negative' WHEN 0 THEN 'neutral' WHEN 1 THEN 'positive' END AS name FROM labels")
def sentiment_names(spark, d):
    return table(spark, d, "labels").select("doc_id", text.sentiment_name(F.col("quality") - F.col("toxic")).alias("name"))


# Key phrases, tags, aspects


@query("phrase_candidates", f"SELECT conv_id, turn, array_to_string({sql_phrases(sql_tokens(_T))}, '; ') AS phrases FROM conversations")
def phrase_candidates(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(keywords.phrases(_text()), "; ").alias("phrases"))


@query(
    "keyword_rank",
    f"""WITH p AS (SELECT conv_id, turn, unnest(range(1, len(phr) + 1)) AS spot, unnest(phr) AS phrase FROM (SELECT conv_id, turn, {sql_phrases(sql_tokens(_T))} AS phr FROM conversations)),
    w AS (SELECT conv_id, turn, spot, phrase, unnest(string_split(phrase, ' ')) AS word, len(string_split(phrase, ' ')) AS n FROM p),
    s AS (SELECT *, sum(n) OVER k / count(*) OVER k AS s FROM w WINDOW k AS (PARTITION BY conv_id, turn, word)),
    e AS (SELECT conv_id, turn, spot, phrase, sum(s) AS score FROM s GROUP BY ALL),
    b AS (SELECT conv_id, turn, phrase, max(score) AS score FROM e GROUP BY ALL)
    SELECT conv_id, turn, phrase, round(score, 6) AS score, row_number() OVER (PARTITION BY conv_id, turn ORDER BY round(score, 9) DESC, phrase DESC) AS rank FROM b""",
)
def keyword_rank(spark, d):
    rows = keywords.ranked_phrases(table(spark, d, "conversations"), ["conv_id", "turn"])
    return rows.select("conv_id", "turn", "phrase", scores.rounded("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("find_phrase", f"SELECT conv_id, turn, array_to_string(list_filter(phr, lambda p: contains(p, 'er')), '; ') AS found FROM (SELECT conv_id, turn, {sql_phrases(sql_tokens(_T))} AS phr FROM conversations)")
def find_phrase(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(text.find_phrases(F.lit("ER"), keywords.phrases(_text())), "; ").alias("found"))


@query("pos_tags", f"SELECT conv_id, turn, array_to_string(list_transform(k, lambda t: {tagging.tag_sql('t')}), ' ') AS tags FROM (SELECT conv_id, turn, {sql_tokens(_T)} AS k FROM conversations)")
def pos_tags(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(tagging.default_tagger(text.tokens(_text(), None)), " ").alias("tags"))


@query("modifier_relabel", f"WITH {_RELABEL} SELECT conv_id, turn, array_to_string(labels, '') AS labels FROM t3")
def modifier_relabel(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", text.tokens(_text()).alias("toks"))
    rows = rows.withColumn("tags", tagging.default_tagger(F.col("toks")))
    rows = rows.withColumn("trig", aspects.triggers(F.col("toks"), F.col("tags")))
    labels = aspects.relabel(F.transform("toks", lambda x: F.lit(0)), F.col("tags"), F.col("trig"))
    return rows.select("conv_id", "turn", F.array_join(labels.cast("array<string>"), "").alias("labels"))


@query(
    "aspect_terms",
    f"""WITH {_RELABEL},
    t4 AS (SELECT *, list_transform(list_filter(list_transform(toks, lambda t, i: CASE WHEN labels[i] IN (1, 2) AND tags[i] NOT IN ({_SILENT}) AND {_PASS} THEN {_BARE} END), lambda w: w IS NOT NULL), lambda w: w) AS ws FROM t3),
    t5 AS (SELECT conv_id, turn, toks, flatten(list_transform(ws, lambda w: CASE WHEN len(list_filter(phr, lambda p: contains(p, lower(w)))) > 0 THEN list_filter(phr, lambda p: contains(p, lower(w))) ELSE [w] END)) AS a FROM t4)
    SELECT conv_id, turn, md5(array_to_string(toks, ' ')) AS sentence_md5, coalesce(array_to_string(list_sort(list_distinct(a)), '; '), '') AS aspect FROM t5""",
)
def aspect_terms(spark, d):
    rows = aspects.detect(table(spark, d, "conversations").select("conv_id", "turn", "text"))
    return rows.select("conv_id", "turn", F.md5("sentence").alias("sentence_md5"), F.array_join("aspect", "; ").alias("aspect"))


_IDS = "map {" + ", ".join(f"{_quote(t)}: {i}" for t, i in tagging.TAG_IDS.items()) + "}"


@query("tag_ids", f"SELECT conv_id, turn, array_to_string(list_transform({sql_tokens(_T)}, lambda t: {_IDS}[{tagging.tag_sql('t')}]), ' ') AS ids FROM conversations")
def tag_ids(spark, d):
    ids = tagging.tag_ids(tagging.default_tagger(text.tokens(_text(), None)))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(ids.cast("array<string>"), " ").alias("ids"))


@query("one_hot_tags", f"SELECT conv_id, turn, tag, count(*) AS n FROM (SELECT conv_id, turn, unnest(list_transform({sql_tokens(_T)}, lambda t: {_IDS}[{tagging.tag_sql('t')}])) AS tag FROM conversations) GROUP BY ALL")
def one_hot_tags(spark, d):
    ids = tagging.tag_ids(tagging.default_tagger(text.tokens(_text(), None)))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.explode(ids).alias("id"))
    flags = rows.select("conv_id", "turn", F.posexplode(scores.one_hot(F.col("id"))).alias("at", "flag")).where("flag = 1")
    return flags.groupBy("conv_id", "turn", (F.col("at") + 1).alias("tag")).agg(F.count("*").alias("n"))


# Labelled reviews

_ITEMS = "list_transform(string_split({0}, chr(10)), lambda l: {{'aspect': string_split(l, ' ')[1], 'sentiment': CASE length(l) % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END}})".format(_T)
_UNROLLED = f"(SELECT doc_id, unnest(items).aspect AS aspect, unnest(items).sentiment AS sentiment, len(list_distinct(list_transform(items, lambda x: x.sentiment))) > 1 AS mixed FROM (SELECT doc_id, {_ITEMS} AS items FROM documents))"


def _reviews(spark, d) -> DataFrame:
    """Stand-ins for labelled reviews: a document's lines as (first word, sentiment by length)."""
    name = lambda x: F.when(F.char_length(x) % 3 == 0, "negative").when(F.char_length(x) % 3 == 1, "neutral").otherwise("positive")
    items = F.transform(F.split(_text(), "\n"), lambda x: F.struct(F.get(F.split(x, " "), F.lit(0)).alias("aspect"), name(x).alias("sentiment")))
    return table(spark, d, "documents").select("doc_id", items.alias("items"))


@query("unroll", f"SELECT * FROM {_UNROLLED}")
def unroll(spark, d):
    return relational.unroll(_reviews(spark, d), "items")


@query("mixed_unroll", f"SELECT * FROM {_UNROLLED} WHERE mixed")
def mixed_unroll(spark, d):
    return relational.unroll(_reviews(spark, d), "items").where("mixed")


@query("sentiment_counts", f"SELECT sentiment, count(*) AS n, count(*) FILTER (mixed) AS n_mixed FROM {_UNROLLED} GROUP BY sentiment")
def sentiment_counts(spark, d):
    return relational.sentiment_counts(relational.unroll(_reviews(spark, d), "items"))


@query("aspect_rows", f"SELECT doc_id, aspect, '' AS sentiment FROM {_UNROLLED}")
def aspect_rows(spark, d):
    rows = _reviews(spark, d).select("doc_id", F.transform("items", lambda x: x["aspect"]).alias("aspect"))
    return relational.aspect_rows(rows)


@query("train_dev_split", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) > count(*) OVER () - CAST(floor(0.1 * count(*) OVER ()) AS BIGINT) THEN 'dev' ELSE 'train' END AS split FROM documents")
def train_dev_split(spark, d):
    return relational.train_dev_split(table(spark, d, "documents").select("doc_id"), "doc_id", 0.1, seed=None)


_PAIRS = f"(SELECT doc_id, unnest(list_transform(string_split({_T}, chr(10)), lambda l: {{'left': string_split(l, ', ')[1], 'right': coalesce(string_split(l, ', ')[2], ''), 'of': length(string_split(l, ', ')[1])}})) AS x FROM documents)"


def _pairs(spark, d) -> DataFrame:
    """Stand-ins for target reviews: a line's first two parts between commas, and the first one's length."""
    part = lambda x, i: F.coalesce(F.get(F.split(x, ", "), F.lit(i)), F.lit(""))
    items = F.transform(F.split(_text(), "\n"), lambda x: F.struct(part(x, 0).alias("left"), part(x, 1).alias("right"), F.char_length(part(x, 0)).alias("of"), part(x, 0).alias("t"), F.lit("neutral").alias("sentiment")))
    return table(spark, d, "documents").select("doc_id", F.lit("").alias("sentence"), items.alias("items"))


@query("target_unroll", f"SELECT '<beg> ' || array_to_string(list_concat({sql_words('x.left')}, ['<end>']), ' ') AS left_text, '<beg> ' || array_to_string(list_concat({sql_words('x.right')}, ['<end>']), ' ') AS right_text FROM {_PAIRS}")
def target_unroll(spark, d):
    rows = relational.target_examples(relational.unroll(_pairs(spark, d), "items"))
    return rows.select(F.array_join("left_text", " ").alias("left_text"), F.array_join("right_text", " ").alias("right_text"))


@query("offset_unroll", f"SELECT CAST(x.of AS BIGINT) AS \"offset\", x.left AS aspect FROM {_PAIRS}")
def offset_unroll(spark, d):
    rows = relational.offset_examples(relational.unroll(_pairs(spark, d), "items"))
    return rows.select(F.col("offset").cast("long").alias("offset"), "aspect")


@query("mixed_test", f"SELECT split, count(*) AS n, count(*) FILTER (mixed) AS n_mixed FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'test' END AS split, mixed FROM {_UNROLLED}) GROUP BY split")
def mixed_test(spark, d):
    rows = _reviews(spark, d)
    train, test, mixed = relational.train_test(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 <> 0"), "items")
    parts = train.select(F.lit("train").alias("split"), "mixed").unionByName(test.select(F.lit("test").alias("split"), "mixed"))
    return parts.groupBy("split").agg(F.count("*").alias("n"), F.count_if("mixed").alias("n_mixed"))


@query("entity_attributes", "SELECT l_orderkey, l_linenumber, l_returnflag AS entity, l_linestatus AS attribute FROM lineitem")
def entity_attributes(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("#", "l_returnflag", "l_linestatus").alias("c"))
    return rows.select("l_orderkey", "l_linenumber", text.entity_attribute(F.col("c")).alias("x")).select("l_orderkey", "l_linenumber", "x.entity", "x.attribute")


# Vocabulary and topics

_DOCWORDS = f"(SELECT doc_id, lang, unnest({sql_words('lower(' + _T + ')')}) AS word FROM documents)"


def _keyworded(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", text.whitespace_tokens(F.lower(_text())).alias("keywords"))


@query("vocab_index", f"SELECT word, row_number() OVER (ORDER BY word) - 1 AS word_id FROM (SELECT DISTINCT word FROM {_DOCWORDS})")
def vocab_index(spark, d):
    return topics.vocabulary(_keyworded(spark, d))


_BAG = f"WITH v AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS word_id FROM (SELECT DISTINCT word FROM {_DOCWORDS})), b AS (SELECT doc_id, word_id, count(*) AS n FROM {_DOCWORDS} JOIN v USING (word) GROUP BY ALL)"


@query("bag_of_words", _BAG + " SELECT * FROM b")
def bag_of_words(spark, d):
    return topics.indexed_bag(_keyworded(spark, d))


@query("doc_filter", _BAG + " SELECT doc_id, CAST(sum(n) AS BIGINT) AS total FROM b GROUP BY doc_id HAVING sum(word_id * n) > 0")
def doc_filter(spark, d):
    return topics.document_totals(_keyworded(spark, d))


_DEFINED = {"article": ["the", "der ", " la"], "ending": ["tion", "keit", "mente"], "Error": ["ou", "error"]}
_MATCHED = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), ' ')"


def _sql_match(x: str) -> str:
    return _MATCHED.format(", ".join(f"CASE WHEN {' OR '.join(f'contains(lower({x}), {_quote(k.lower())})' for k in ws)} THEN {_quote(t)} END" for t, ws in topics.topic_table(_DEFINED)))


@query("topic_match", f"SELECT doc_id, {_sql_match(_T)} AS topics FROM documents")
def topic_match(spark, d):
    return table(spark, d, "documents").select("doc_id", topics.match_topics(_text(), topics.topic_table(_DEFINED)).alias("topics"))


_TOPS = f"SELECT lang AS topic, word, count(*) AS weight, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word DESC) AS rank FROM {_DOCWORDS} GROUP BY lang, word QUALIFY rank <= 3"


def _tops(spark, d) -> DataFrame:
    words = _keyworded(spark, d).select(F.col("lang").alias("topic"), F.explode("keywords").alias("word")).groupBy("topic", "word").agg(F.count("*").alias("weight"))
    return topics.top_words(words.withColumn("word_id", F.col("word")), 3)


@query("top_words", f"SELECT topic, CAST(rank AS INTEGER) AS rank, word, weight FROM ({_TOPS})")
def top_words(spark, d):
    return _tops(spark, d)


@query("topic_labels", f"SELECT topic, words, m || ' - ' || words AS label, m AS matched FROM (SELECT topic, words, {_sql_match('words')} AS m FROM (SELECT topic, string_agg(word, ' ' ORDER BY rank) AS words FROM ({_TOPS}) GROUP BY topic))")
def topic_labels(spark, d):
    rows = topics.label_topics(_tops(spark, d), topics.topic_table(_DEFINED))
    return rows.select("topic", F.array_join("words", " ").alias("words"), "label", "matched")


@query("perplexity", f"WITH w AS (SELECT doc_id, word, count(*) AS n FROM {_DOCWORDS} GROUP BY ALL), p AS (SELECT word, sum(n) / (SELECT sum(n) FROM w) AS p FROM w GROUP BY word), l AS (SELECT doc_id, sum(-n * ln(p)) AS loss, sum(n) AS c FROM w JOIN p USING (word) GROUP BY doc_id) SELECT round(exp(avg(loss / c)), 4) AS perplexity FROM l")
def perplexity(spark, d):
    return topics.unigram_perplexity(_keyworded(spark, d)).select(scores.rounded("perplexity", 4).alias("perplexity"))


@query("prodlda_topics")
def prodlda_topics(spark, d):
    model = topics.TopicModel(_keyworded(spark, d).select("doc_id", "keywords"), config=topics.TopicConfig(n_topics=5, epochs=10), topic_def=_DEFINED)
    model.fit()
    return model.top_words_and_topics()


# Scores

_E = "[CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE), CAST(embedding[3] AS DOUBLE)]"
_P = "(SELECT vec_id, s, exp(s[1] - m) / z AS neg, exp(s[2] - m) / z AS neu, exp(s[3] - m) / z AS pos FROM (SELECT vec_id, s, list_max(s) AS m, exp(s[1] - list_max(s)) + exp(s[2] - list_max(s)) + exp(s[3] - list_max(s)) AS z FROM (SELECT vec_id, {} AS s FROM embeddings)))".format(_E)


def _logits(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 3).cast("array<double>").alias("s"))


@query("compound", f"SELECT vec_id, round(((1 - neu) * (pos - neg) + 1) / 2, 6) AS compound FROM {_P}")
def compound(spark, d):
    return _logits(spark, d).select("vec_id", scores.rounded(scores.compound(F.col("s")), 6).alias("compound"))


@query("norm_score", f"SELECT vec_id, round((s[1] + 1) / 2, 6) AS score FROM {_P}")
def norm_score(spark, d):
    return _logits(spark, d).select("vec_id", scores.rounded(scores.normalize(F.get("s", F.lit(0))), 6).alias("score"))


@query("argmax_label", f"SELECT vec_id, ['negative', 'neutral', 'positive'][list_position(s, list_max(s))] AS label FROM {_P}")
def argmax_label(spark, d):
    return _logits(spark, d).select("vec_id", scores.argmax_label(F.col("s")).alias("label"))


@query("reorder_classes", f"SELECT vec_id, round(s[2], 6) AS neg, round(s[3], 6) AS neu, round(s[1], 6) AS pos FROM {_P}")
def reorder_classes(spark, d):
    s = scores.reorder(F.col("s"), ("positive", "negative", "neutral"))
    return _logits(spark, d).select("vec_id", *[scores.rounded(F.get(s, F.lit(i)), 6).alias(n) for i, n in enumerate(("neg", "neu", "pos"))])


_LEX = "map {" + ", ".join(f"{_quote(k)}: {v}::DOUBLE" for k, v in sentiment.LEXICON.items()) + "}"
_BOOST = "map {" + ", ".join(f"{_quote(k)}: {v}::DOUBLE" for k, v in sentiment.BOOSTERS.items()) + "}"
_NEG = ", ".join(map(_quote, sentiment.NEGATIONS))
_PATTERN = f"(SELECT doc_id, ((coalesce(list_avg(list_filter(list_transform({sql_tokens(_T)}, lambda t: {_LEX}[lower(t)]), lambda v: v IS NOT NULL)), 0) / 4) + 1) / 2 AS p FROM documents)"
_VADER = f"""(SELECT doc_id, avg(total / sqrt(total * total + 15)) AS c, avg(CASE WHEN mass > 0 THEN neg / mass ELSE 0 END) AS neg, avg(CASE WHEN mass > 0 THEN neu / mass ELSE 0 END) AS neu, avg(CASE WHEN mass > 0 THEN pos / mass ELSE 0 END) AS pos FROM (
    SELECT doc_id, coalesce(list_sum(v), 0) AS total, coalesce(list_sum(list_transform(v, lambda x: CASE WHEN x > 0 THEN x + 1 ELSE 0 END)), 0) AS pos, coalesce(list_sum(list_transform(v, lambda x: CASE WHEN x < 0 THEN 1 - x ELSE 0 END)), 0) AS neg,
        len(list_filter(v, lambda x: x = 0)) AS neu, pos + neg + neu AS mass FROM (
    SELECT doc_id, list_transform(r, lambda x, i: CASE WHEN len(list_filter(k[greatest(i - 3, 1) : i - 1], lambda w: w IN ({_NEG}))) > 0 THEN x * -{sentiment.DAMP} ELSE x END) AS v FROM (
    SELECT doc_id, k, list_transform(k, lambda t, i: CASE WHEN {_LEX}[t] > 0 THEN {_LEX}[t] + CASE WHEN i > 1 THEN coalesce({_BOOST}[k[i - 1]], 0) ELSE 0 END WHEN {_LEX}[t] < 0 THEN {_LEX}[t] - CASE WHEN i > 1 THEN coalesce({_BOOST}[k[i - 1]], 0) ELSE 0 END ELSE 0 END) AS r FROM (
    SELECT doc_id, list_transform({sql_tokens('s')}, lambda t: lower(t)) AS k FROM (SELECT doc_id, unnest({_SENTENCES.format(_T)}) AS s FROM documents)))))
    GROUP BY doc_id)"""


@query("pattern_sentiment", f"SELECT doc_id, round(p, 6) AS polarity FROM {_PATTERN}")
def pattern_sentiment(spark, d):
    return table(spark, d, "documents").select("doc_id", scores.rounded(sentiment.pattern_score(F.col("text"))["polarity"], 6).alias("polarity"))


@query("lexicon_sentiment", f"SELECT doc_id, round((c + 1) / 2, 6) AS polarity, round(neg, 6) AS neg, round(neu, 6) AS neu, round(pos, 6) AS pos FROM documents LEFT JOIN {_VADER} USING (doc_id)")
def lexicon_sentiment(spark, d):
    rows = table(spark, d, "documents").select("doc_id", sentiment.lexicon_score(F.col("text")).alias("s"))
    return rows.select("doc_id", scores.rounded("s.polarity", 6).alias("polarity"), *[scores.rounded(F.get("s.scores", F.lit(i)), 6).alias(n) for i, n in enumerate(("neg", "neu", "pos"))])


@query("overall_score", f"SELECT doc_id, ['negative', 'neutral', 'positive'][list_position(m, list_max(m))] AS label, round(m[1], 6) AS neg, round(m[2], 6) AS neu, round(m[3], 6) AS pos FROM (SELECT doc_id, [(1 - p + neg) / 2, neu / 2, (p + pos) / 2] AS m FROM {_PATTERN} LEFT JOIN {_VADER} USING (doc_id))")
def overall_score(spark, d):
    rows = table(spark, d, "documents").select("doc_id", sentiment.score_overall(F.col("text")).alias("s"))
    return rows.select("doc_id", "s.label", *[scores.rounded(F.get("s.scores", F.lit(i)), 6).alias(n) for i, n in enumerate(("neg", "neu", "pos"))])


# Word vectors


@query("embed_lookup", "SELECT word, round(coalesce((SELECT sum(x) FROM (SELECT unnest(e.embedding)::DOUBLE AS x)), 0), 4) AS total FROM (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS word FROM documents) LEFT JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = word")
def embed_lookup(spark, d):
    words = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("word")).distinct()
    known = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vec"))
    rows = embeddings.pretrained(words, known, 0.0, 64)
    return rows.select("word", scores.rounded(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("oov_words", f"SELECT DISTINCT word FROM {_DOCWORDS} EXCEPT SELECT unnest({sql_words('lower(' + _T + ')')}) FROM benchmark")
def oov_words(spark, d):
    words = _keyworded(spark, d).select(F.explode("keywords").alias("word"))
    known = table(spark, d, "benchmark").select(F.explode(text.whitespace_tokens(F.lower(_text()))).alias("word"))
    return relational.new_words(words, known.distinct())


@query(
    "cosine_topk",
    """SELECT query_id, vec_id, round(c, 6) AS cosine, rank FROM (
        SELECT q.vec_id AS query_id, t.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])) AS c,
            row_number() OVER (PARTITION BY q.vec_id ORDER BY round(c, 9) DESC NULLS LAST, t.vec_id) AS rank
        FROM embeddings q JOIN embeddings t ON q.vec_id <> t.vec_id WHERE q.vec_id % 100 = 0) WHERE rank <= 5""",
)
def cosine_topk(spark, d):
    rows = table(spark, d, "embeddings")
    found = embeddings.nearest(rows.where("vec_id % 100 = 0"), rows, 5, most_queries=1_000_000)
    return found.select("query_id", "vec_id", scores.rounded("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


# Networks


@query("tagger_infer")
def tagger_infer(spark, d):
    small, large = embeddings.Subwords(8, 1 << 12), embeddings.Subwords(16, 1 << 12, seed=1)
    known = {w: small.vector(w) for w in keywords.STOP_WORDS}, {w: large.vector(w) for w in keywords.STOP_WORDS}
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("item"), text.tokens(_text()).alias("toks"))
    rows = rows.withColumn("tag_ids", tagging.tag_ids(tagging.default_tagger(F.col("toks"))))
    return neural.infer_labels(rows, "item", "toks", "tag_ids", known[1], known[0], neural.random_tagger(16, 8, filters=16), neural.padded_width(rows, "toks"))


@query("gate_infer")
def gate_infer(spark, d):
    words = embeddings.Subwords(16, 1 << 12)
    known = {w: words.vector(w) for w in keywords.STOP_WORDS}
    rows = table(spark, d, "conversations").select("conv_id", "turn", text.cyclic_pad(text.whitespace_tokens(_text())).alias("toks"))
    rows = rows.withColumn("aspect", F.slice("toks", 1, 2))
    return neural.score_aspects(rows, "toks", "aspect", known, neural.random_gate(16, 16, maps=10)).select("conv_id", "turn", "sentiment", F.transform("score", lambda x: scores.rounded(x, 6)).alias("score"))


@query("aspect_sentiment")
def aspect_sentiment(spark, d):
    words = embeddings.Subwords(16, 1 << 12)
    known = {w: words.vector(w) for w in keywords.STOP_WORDS}
    rows = aspects.detect(table(spark, d, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("item"), "text"), extract_phrase=False)
    scorer = scoring.AspectScorer(known, neural.random_gate(16, 16, maps=10))
    return scorer.score(rows.select("item", "sentence", "aspect")).select("item", "aspect", "sentiment", scores.rounded("compound", 6).alias("compound"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, label): the three commonest content words of each language after cleaning, as a label."""
    rows = table(spark, sf_dir, "documents").select("lang", F.explode(text.whitespace_tokens(F.lower(text.clean_text(_text())))).alias("word"))
    counts = rows.where(~F.col("word").isin(*keywords.STOP_WORDS)).groupBy("lang", "word").agg(F.count("*").alias("weight"))
    tops = topics.top_words(counts.select(F.col("lang").alias("topic"), "word", "weight", F.col("word").alias("word_id")), 3)
    return topics.label_topics(tops, topics.topic_table()).select(F.col("topic").alias("lang"), "label")
