"""Queries over sources and sinks: each writes a driver table in a format into the shared folder and reads it back through the source."""

from __future__ import annotations

import os
import tarfile

import numpy as np
from pyspark.sql import functions as F

from gleanery.functions import text
from gleanery.operators import neural, relational, topics
from gleanery.plans.queries import query, sql_words, table
from gleanery.sources import files
from gleanery.sources.shared import as_file, fresh_path

_LINE = "regexp_replace(coalesce(text, ''), '[\\n\\r]+', ' ', 'g')"


def _line():
    return F.regexp_replace(F.coalesce("text", F.lit("")), "[\\n\\r]+", " ")


@query("polarity_source", f"SELECT md5({_LINE}) AS digest, CASE role WHEN 'user' THEN 'negative' ELSE 'positive' END AS label, count(*) AS n FROM conversations GROUP BY ALL")
def polarity_source(spark, d):
    rows, at = table(spark, d, "conversations"), [fresh_path(spark, n) for n in ("negative", "positive")]
    rows.where("role = 'user'").select(_line()).write.text(at[0])
    rows.where("role <> 'user'").select(_line()).write.text(at[1])
    return files.polarity(spark, *at).groupBy(F.md5("text").alias("digest"), "label").agg(F.count("*").alias("n"))


_NOTED = "SELECT CASE page_id % 4 WHEN 0 THEN '# ' || url WHEN 1 THEN '   ' WHEN 2 THEN '  ' || url || ' ' ELSE url END AS line FROM pages"


@query("commented_lines", f"SELECT trim(line, ' ') AS line FROM ({_NOTED}) WHERE trim(line, ' ') <> '' AND trim(line, ' ') NOT LIKE '#%'")
def commented_lines(spark, d):
    at, kind = fresh_path(spark, "lines"), F.col("page_id") % 4
    line = F.when(kind == 0, F.concat(F.lit("# "), "url")).when(kind == 1, F.lit("   ")).when(kind == 2, F.concat(F.lit("  "), "url", F.lit(" "))).otherwise(F.col("url"))
    table(spark, d, "pages").select(line).write.text(at)
    return files.commented_lines(spark, at)


@query("commented_rows", "SELECT CAST(doc_id AS VARCHAR) AS id, ' ' || quality AS quality, CAST(toxic AS VARCHAR) AS toxic FROM labels WHERE doc_id % 5 <> 0")
def commented_rows(spark, d):
    at = fresh_path(spark, "rows")
    table(spark, d, "labels").select(F.concat(F.when(F.col("doc_id") % 5 == 0, "#").otherwise(""), F.col("doc_id").cast("string"), F.lit(", "), F.col("quality").cast("string"), F.lit(","), F.col("toxic").cast("string"))).write.text(at)
    return files.commented_rows(spark, at).select(*[F.get("fields", F.lit(i)).alias(n) for i, n in enumerate(("id", "quality", "toxic"))])


@query("vocabulary_json", "SELECT 'item ' || item_id AS word, CAST(item_id AS INTEGER) AS word_id FROM benchmark")
def vocabulary_json(spark, d):
    at, items = fresh_path(spark, "vocabulary"), table(spark, d, "benchmark")
    # a JSON object is one value: a vocabulary's size, not a corpus'
    items.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("item "), F.col("item_id").cast("string")), F.col("item_id").cast("int")))))).write.text(at)
    return files.vocabulary_json(spark, at)


def _micro(vec):
    """Sum of a vector's entries in 10^-5, each rounded."""
    return F.aggregate(F.transform(vec, lambda x: F.round(x.cast("double") * 100000).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


_MICRO = "CAST(list_sum(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 100000) AS BIGINT))) AS BIGINT)"


def _words(spark, d):
    return table(spark, d, "embeddings").select(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"), F.col("embedding").alias("vec"))


@query("matrix_npy", f"SELECT vec_id AS word_id, len(embedding) AS dim, {_MICRO} AS total FROM embeddings")
def matrix_npy(spark, d):
    at, rows = fresh_path(spark, "matrix") + ".npy", table(spark, d, "embeddings")
    files.save_matrix_npy(rows.select(F.col("vec_id").alias("word_id"), F.col("embedding").alias("vec")), at, rows.count(), 64)
    return files.matrix_npy(spark, at).select("word_id", F.size("vec").cast("long").alias("dim"), _micro("vec").alias("total"))


@query("word2vec_binary", f"SELECT 'w' || vec_id AS word, len(embedding) AS dim, {_MICRO} AS total FROM embeddings")
def word2vec_binary(spark, d):
    at = fresh_path(spark, "vectors") + ".bin"
    files.save_word2vec_binary(_words(spark, d), at, 64)
    return files.word2vec_binary(spark, at).select("word", F.size("vec").cast("long").alias("dim"), _micro("vec").alias("total"))


@query("vectors_text", f"SELECT 'w' || vec_id AS word, len(embedding) AS dim, {_MICRO} AS total FROM embeddings WHERE vec_id % 2 = 0")
def vectors_text(spark, d):
    words, vectors = fresh_path(spark, "words"), fresh_path(spark, "vectors")
    files.save_vectors(_words(spark, d), words, vectors)
    wanted = table(spark, d, "embeddings").where("vec_id % 2 = 0").select(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"))
    return files.vectors_text(spark, vectors, wanted).select("word", F.size("vec").cast("long").alias("dim"), _micro("vec").alias("total"))


@query("vector_sink", "SELECT 'w' || vec_id AS line FROM embeddings UNION ALL SELECT 'w' || vec_id || ' ' || array_to_string(list_transform(embedding, lambda x: printf('%.5f', CAST(x AS DOUBLE))), ' ') FROM embeddings")
def vector_sink(spark, d):
    words, vectors = fresh_path(spark, "words"), fresh_path(spark, "vectors")
    files.save_vectors(_words(spark, d), words, vectors)
    return spark.read.text(words).unionByName(spark.read.text(vectors)).select(F.col("value").alias("line"))


@query("vectors_last_fields", f"SELECT 'new word ' || vec_id AS word, len(embedding) AS dim, {_MICRO} AS total FROM embeddings")
def vectors_last_fields(spark, d):
    at = fresh_path(spark, "vectors")
    table(spark, d, "embeddings").select(files.vector_line(F.concat(F.lit("new word "), F.col("vec_id").cast("string")), F.col("embedding"))).write.text(at)
    return files.vectors_last_fields(spark, at, 64).select("word", F.size("vec").cast("long").alias("dim"), _micro("vec").alias("total"))


@query("aspect_vectors", f"SELECT 'aspect ' || vec_id AS word, len(embedding) AS dim, {_MICRO} AS total FROM embeddings")
def aspect_vectors(spark, d):
    at = fresh_path(spark, "aspects")
    numbers = F.array_join(F.transform("embedding", lambda x: F.format_string("%.5f", x.cast("double"))), " ")
    table(spark, d, "embeddings").select(F.concat(F.lit("aspect "), F.col("vec_id").cast("string"), F.lit(":"), numbers)).write.text(at)
    return files.aspect_vectors(spark, at).select("word", F.size("vec").cast("long").alias("dim"), _micro("vec").alias("total"))


@query("saved_table", "SELECT doc_id, md5(text) AS digest, lang, source, n_chars FROM documents")
def saved_table(spark, d):
    at = fresh_path(spark, "table")
    files.save_table(table(spark, d, "documents"), at)
    return files.load_table(spark, at).select("doc_id", F.md5("text").alias("digest"), "lang", "source", "n_chars")


@query("vocabulary_fields", "SELECT 'event' AS field, event_type AS token, row_number() OVER (ORDER BY event_type) - 1 AS id FROM (SELECT DISTINCT event_type FROM events) UNION ALL SELECT 'region', r_name, CAST(r_regionkey AS BIGINT) FROM region")
def vocabulary_fields(spark, d):
    events = topics.vocabulary(table(spark, d, "events").select(F.array("event_type").alias("keywords")))
    return files.vocabulary_fields({"event": events, "region": table(spark, d, "region").select(F.col("r_name").alias("word"), F.col("r_regionkey").alias("word_id"))})


@query("weight_bundle", "SELECT name, size, total FROM (VALUES ('a', 12, 66.0::DOUBLE), ('b', 2, 0.5::DOUBLE)) t(name, size, total)")
def weight_bundle(spark, d):
    at = as_file(fresh_path(spark, "bundle")) + ".npz"
    neural.save_bundle(at, {"a": np.arange(12.0).reshape(3, 4), "b": np.array([0.25, 0.25])})
    return spark.createDataFrame([(k, int(v.size), float(v.sum())) for k, v in neural.load_bundle(at).items()], "name string, size int, total double")


@query("transfer_source", "SELECT CAST(doc_id AS VARCHAR) AS key, 'a, \"b\"' AS response, quality - toxic AS sentiment, CASE quality - toxic WHEN -1 THEN 'negative' WHEN 0 THEN 'neutral' ELSE 'positive' END AS sentiment_name FROM labels")
def transfer_source(spark, d):
    at, c = fresh_path(spark, "transfer"), F.col("doc_id").cast("string")
    rows = table(spark, d, "labels").select(c.alias("RowKey"), F.lit("q").alias("Question"), F.lit('a, "b"').alias("Response"), F.lit("x").alias("aspect"), (F.col("quality") - F.col("toxic")).alias("sentiment"), F.lit("k").alias("keyword"))
    rows.write.option("header", True).option("escape", '"').csv(at)
    return files.transfer_csv(spark, at).select(F.col("RowKey").alias("key"), F.col("Response").alias("response"), "sentiment", "sentiment_name")


@query("archive_source", "SELECT item_id, md5(text) AS digest FROM benchmark")
def archive_source(spark, d):
    """The benchmark's files, packed and unpacked."""
    at = as_file(fresh_path(spark, "archive"))
    folder = files.ensure_dir(f"{at}/in")
    table(spark, d, "benchmark").write.mode("overwrite").parquet(f"file://{folder}/items")
    with tarfile.open(f"{at}/items.tar", "w") as t:
        t.add(f"{folder}/items", "items")
    files.ensure_dir(folder, erase=True)
    if os.listdir(folder):
        raise ValueError("an erased folder is not empty")
    files.unpack(f"{at}/items.tar", f"{at}/out")
    return spark.read.parquet(f"file://{at}/out/items").select("item_id", F.md5("text").alias("digest"))


_TOKS = sql_words("coalesce(text, '')")


@query("highlight", f"SELECT conv_id, turn, array_to_string(list_transform({_TOKS}, lambda t: CASE WHEN length(t) > 5 THEN chr(27) || '[6;30;42m' || t || chr(27) || '[0m' ELSE t END), ' ') AS shown FROM conversations")
def highlight(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", text.whitespace_tokens(F.coalesce("text", F.lit(""))).alias("k"))
    return rows.select("conv_id", "turn", text.highlight(F.col("k"), F.transform("k", lambda t: F.char_length(t) > 5)).alias("shown"))


@query("category_source", f"SELECT {_LINE} AS text, role AS aspect, 'neutral' AS sentiment FROM conversations")
def category_source(spark, d):
    rows = table(spark, d, "conversations").select(_line().alias("sentence"), F.array(F.struct(F.col("role").alias("aspect"), F.lit("neutral").alias("sentiment"))).alias("items"))
    return relational.category_examples(relational.unroll(rows, "items"))
