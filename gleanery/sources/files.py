"""Sources and sinks: polarity files, commented lists, vocabularies, vector files, transfer tables, archives."""

from __future__ import annotations

import mmap
import os
import shutil
import tarfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.text import sentiment_name
from gleanery.sources.shared import as_file

TRANSFER_SCHEMA = "RowKey string, Question string, Response string, aspect string, sentiment int, keyword string"


def corpus(spark: SparkSession, texts: list[str]) -> DataFrame:
    """(doc_id, text) of a list in memory; its place is the id."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def without_bad_bytes(c: Column) -> Column:
    return F.replace(F.make_valid_utf8(c), F.lit("�"), F.lit(""))


def polarity(spark: SparkSession, negative: str, positive: str) -> DataFrame:
    """(text, label) of two files of one example a line; bytes that aren't UTF-8 are dropped."""
    read = lambda at, label: spark.read.text(at).select(without_bad_bytes(F.col("value")).alias("text"), F.lit(label).alias("label"))
    return read(negative, "negative").unionByName(read(positive, "positive"))


def commented_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stripped lines, without comments (#) and blank lines."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("line"))
    return lines.where((F.col("line") != "") & ~F.col("line").startswith("#"))


def commented_rows(spark: SparkSession, path: str) -> DataFrame:
    """commented_lines() split at commas; fields are not stripped."""
    return commented_lines(spark, path).select(F.split("line", ",").alias("fields"))


def vocabulary_json(spark: SparkSession, path: str) -> DataFrame:
    """(word, word_id) of a JSON object."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,int>")).alias("word", "word_id"))


def matrix_npy(spark: SparkSession, path: str, rows: int = 10_000) -> DataFrame:
    """(word_id, vec) of a numpy matrix in a shared folder; no pickled objects are read. Tasks map their own rows, the driver reads the header."""
    at = as_file(path)
    n = len(np.load(at, allow_pickle=False, mmap_mode="r"))

    def read(batches):
        m = np.load(at, allow_pickle=False, mmap_mode="r")
        for b in batches:
            for i in b.column(0).to_pylist():
                part = np.ascontiguousarray(m[i * rows : (i + 1) * rows]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i * rows, i * rows + len(part))), _lists(part)], ["word_id", "vec"])

    return spark.range(-(-n // rows)).mapInArrow(read, "word_id long, vec array<float>")


def _lists(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, max(1, m.shape[1])), pa.int32()), pa.array(m.ravel()))


def save_matrix_npy(df: DataFrame, path: str, rows: int, dim: int) -> None:
    """A numpy file in a shared folder, from (word_id, vec) with word_id from 0 to rows - 1. Tasks write their own rows, a repeated task the same ones."""
    at = as_file(path)
    np.lib.format.open_memmap(at, mode="w+", dtype=np.float32, shape=(rows, dim)).flush()

    def write(batches):
        m = np.lib.format.open_memmap(at, mode="r+")
        for b in batches:
            m[b.column(0).to_numpy()] = np.array(b.column(1).to_pylist(), np.float32).reshape(-1, dim)
        m.flush()
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64())], ["done"])

    df.select(F.col("word_id").cast("long"), F.col("vec").cast("array<float>")).mapInArrow(write, "done long").write.format("noop").mode("overwrite").save()


def word2vec_binary(spark: SparkSession, path: str, batch: int = 10_000) -> DataFrame:
    """(word, vec) of a word2vec binary file in a shared folder. The driver walks over the words to find where each batch starts; tasks read the batches."""
    at = as_file(path)
    with open(at, "rb") as f:
        n, dim = map(int, f.readline().split())
        pos, starts = f.tell(), []
        with mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as m:
            for i in range(n):
                if i % batch == 0:
                    starts.append((pos, min(batch, n - i)))
                pos = m.find(b" ", pos) + 1 + 4 * dim

    def read(batches):
        with open(at, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as m:
            for b in batches:
                for pos, count in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    words, rows = [], np.empty((count, dim), np.float32)
                    for i in range(count):
                        end = m.find(b" ", pos)
                        words.append(m[pos:end].replace(b"\n", b"").decode("utf-8", "replace"))
                        rows[i] = np.frombuffer(m, np.float32, dim, end + 1) if (end + 1) % 4 == 0 else np.frombuffer(m[end + 1 : end + 1 + 4 * dim], np.float32)
                        pos = end + 1 + 4 * dim
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), _lists(rows)], ["word", "vec"])

    if not starts:
        return spark.createDataFrame([], "word string, vec array<float>")
    return spark.createDataFrame(starts, "pos long, count long").repartition(len(starts) if len(starts) < 200 else 200).mapInArrow(read, "word string, vec array<float>")


def save_word2vec_binary(df: DataFrame, path: str, dim: int) -> None:
    """A word2vec binary file in a shared folder, from (word, vec). Tasks write parts; the driver strings together those of the tasks that ended well."""
    at = as_file(path)
    os.makedirs(f"{at}.parts")

    def write(batches):
        name, n = f"{at}.parts/{uuid.uuid4().hex}", 0
        with open(name, "wb") as f:
            for b in batches:
                for word, vec in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    f.write(word.encode() + b" " + np.array(vec, np.float32).tobytes() + b"\n")
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["name", "n"])

    parts = df.select("word", F.col("vec").cast("array<float>")).mapInArrow(write, "name string, n long").collect()  # one row a task
    with open(at, "wb") as out:
        out.write(f"{sum(p['n'] for p in parts)} {dim}\n".encode())
        for p in parts:
            with open(p["name"], "rb") as f:
                shutil.copyfileobj(f, out, 1 << 20)
    shutil.rmtree(f"{at}.parts")


def vectors_text(spark: SparkSession, path: str, words: DataFrame | None = None) -> DataFrame:
    """(word, vec) of lines ``word v v ...``; only those in ``words``, if given."""
    lines = spark.read.text(path).select(F.substring_index("value", " ", 1).alias("word"), F.col("value"))
    if words is not None:
        lines = lines.join(words.select("word").distinct(), "word", "left_semi")
    return lines.select("word", F.split(F.trim(F.expr("substring(value, length(word) + 2)")), " +").cast("array<float>").alias("vec"))


def vectors_last_fields(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(word, vec) of lines whose last ``dim`` fields are the vector; the word may have spaces."""
    parts = F.split("value", " ")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") > dim)
    return rows.select(F.array_join(F.slice("p", F.lit(1), F.size("p") - dim), " ").alias("word"), F.slice("p", -dim, dim).cast("array<float>").alias("vec"))


def aspect_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec) of lines ``word:v v v``."""
    parts = F.split("value", ":")
    return spark.read.text(path).where(F.size(parts) == 2).select(F.get(parts, F.lit(0)).alias("word"), F.split(F.trim(F.get(parts, F.lit(1))), " +").cast("array<double>").alias("vec"))


def transfer_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """The transfer table, with the sentiment's name; quotes inside a quoted field are doubled."""
    return spark.read.csv(path, header=True, schema=TRANSFER_SCHEMA, sep=sep, escape='"').withColumn("sentiment_name", sentiment_name(F.col("sentiment")))


def vector_line(word: Column, vec: Column) -> Column:
    return F.concat_ws(" ", word, F.array_join(F.transform(vec.cast("array<double>"), lambda x: F.format_string("%.5f", x)), " "))


def save_vectors(df: DataFrame, words_path: str, vectors_path: str, single: bool = False, mode: str = "errorifexists") -> None:
    """Two text sinks: one word a line, and ``word v v ...`` with five decimals. ``single``: one file each, in word order."""
    rows = df.select("word", "vec")
    rows = rows.orderBy("word").coalesce(1) if single else rows
    rows.select("word").write.mode(mode).text(words_path)
    rows.select(vector_line(F.col("word"), F.col("vec"))).write.mode(mode).text(vectors_path)


def save_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet, in place of pickles."""
    df.write.mode(mode).parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def vocabulary_fields(vocabs: dict[str, DataFrame]) -> DataFrame:
    """(field, token, id) of several vocabularies (word, word_id)."""
    out = None
    for name, v in sorted(vocabs.items()):
        rows = v.select(F.lit(name).alias("field"), F.col("word").alias("token"), F.col("word_id").cast("long").alias("id"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no vocabulary")
    return out


def ensure_dir(path: str, erase: bool = False) -> str:
    """The absolute path of a folder that is there, emptied if asked."""
    path = os.path.abspath(os.path.expanduser(path))
    if erase and os.path.isdir(path):
        shutil.rmtree(path)
    os.makedirs(path, exist_ok=True)
    return path


def unpack(archive: str, into: str) -> list[str]:
    """Extracts a tar archive; members that would land elsewhere, and links out of the folder, are refused."""
    ensure_dir(into)
    with tarfile.open(archive) as t:
        t.extractall(into, filter="data")
        return sorted(m.name for m in t.getmembers())
