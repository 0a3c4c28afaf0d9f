"""Language identification (operator 2): multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, all but letters become spaces, one is put at either end, and bigrams and trigrams of code points are hashed into
``buckets``. Counting runs where the training texts lie: each task sums its counts, the counts are summed by
(language, bucket), and the matrix of log probabilities (languages x buckets, its size checked) is sent to all tasks.
Scoring is sparse and by batches: the n-grams of many texts pick their columns, whose sums run over whole texts.

It learns from a bounded sample, at most about ``docs_per_lang`` labelled documents a language, chosen by a hash of
doc_id, so reruns agree.

Defined cases: text that is null or has no letter is ``und`` with score 0, and so is everything where there is nothing to
learn from. Null lang teaches nothing. A null doc_id hashes as an empty id. Ties go to the language that sorts first.
Score: posterior of the best language under equal priors, the evidence counted as at most ``evidence`` n-grams.
Columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm import common, textkit

_tables: dict[str, np.ndarray] = {}


@dataclass(frozen=True)
class LangConfig:
    buckets: int = 1 << 15
    docs_per_lang: int = 4000
    smoothing: float = 0.5
    evidence: int = 40
    most_langs: int = 1000  #: the matrix takes 128 KB a language; beyond this it refuses


def letters(text_bytes: bytes) -> np.ndarray:
    """Code points of lower-cased letters; 32 for anything else."""
    if not _tables:
        points = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000)]
        _tables["fold"] = np.array([ord(x.lower()[0]) if x.isalpha() else 32 for x in points], np.uint32)
    points = np.frombuffer(text_bytes.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return _tables["fold"][points]


def grams(points: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the bigram and of the trigram from each place of an array of code points."""
    x = points * np.uint32(0x9E3779B1)
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    two = (x[:-1] ^ (x[1:] >> np.uint32(7))) * np.uint32(0x85EBCA6B)
    three = (two[:-1] ^ (x[2:] >> np.uint32(3))) * np.uint32(0xC2B2AE35)
    return (two * np.uint32(0x27D4EB2F) >> shift).astype(np.int64), (three >> shift).astype(np.int64)


def batches_of_grams(texts: pa.Array, buckets: int, size: int = textkit.CHUNK_BYTES // 16) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per range of rows: its first row, the bigram's and the trigram's bucket at each place, n+1 offsets of the rows' places, and which
    rows have a letter. A place where none begins has bucket ``buckets``.

    Each row is taken with a space before and after it; n-grams that cross from a row to the next don't count.
    """
    data, offsets = textkit.buffer_of(texts)
    for lo, hi in textkit.chunks(offsets, size):
        raw = data[offsets[lo] : offsets[hi]]
        begin = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets[lo : hi + 1] - offsets[lo]]
        points = letters(raw.tobytes())
        if len(points) != begin[-1]:  # bytes that aren't UTF-8: row by row
            rows = [letters(data[offsets[i] : offsets[i + 1]].tobytes()) for i in range(lo, hi)]
            begin, points = np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate(rows)
        at = begin + 2 * np.arange(hi - lo + 1)
        edge = np.ones(at[-1], bool)
        edge[at[:-1]] = edge[at[1:] - 1] = False
        padded = np.full(at[-1], 32, np.uint32)
        padded[edge] = points
        two, three = grams(padded, buckets)
        two, three = np.append(two, buckets), np.append(three, [buckets, buckets])
        two[at[1:] - 1] = three[at[1:] - 1] = three[at[1:] - 2] = buckets
        yield lo, two, three, at, np.logical_or.reduceat(padded != 32, at[:-1])


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


@dataclass
class LangModel:
    langs: list[str]
    logp: np.ndarray  #: languages x buckets
    evidence: int

    def score(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: a batch's n-grams pick their columns of the matrix, whose sums over each text are its evidence."""
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return langs, scores
        table = np.concatenate([self.logp, np.zeros((len(self.langs), 1), np.float32)], axis=1)  # what doesn't count adds nothing
        for lo, two, three, at, some in batches_of_grams(texts, self.logp.shape[1]):
            n = 2 * np.diff(at) - 3
            total = np.empty((len(n), len(self.langs)))
            step = max(1, (1 << 22) // len(two))  # languages at a time
            for j in range(0, len(self.langs), step):
                part = table[j : j + step]
                total[:, j : j + step] = np.add.reduceat(part.take(two, axis=1) + part.take(three, axis=1), at[:-1], axis=1, dtype=np.float64).T
            best = total.argmax(axis=1)
            z = np.exp((total - total.max(axis=1, keepdims=True)) * (np.minimum(n, self.evidence) / n)[:, None]).sum(axis=1)
            for i in np.flatnonzero(some).tolist():
                langs[lo + i], scores[lo + i] = self.langs[best[i]], 1 / z[i]
        return langs, scores


def train(docs: DataFrame, config: LangConfig = LangConfig()) -> LangModel:
    """Learns from docs (doc_id, text, lang): rows with null lang or text teach nothing."""
    docs = docs.where("lang is not null and text is not null")
    counted = docs.groupBy("lang").agg(F.count("*").alias("rows")).limit(config.most_langs + 1).collect()
    if len(counted) > config.most_langs:
        raise ValueError(f"more than {config.most_langs} languages")
    langs = sorted(r["lang"] for r in counted)
    if not langs:
        return LangModel([], np.zeros((0, config.buckets), np.float32), config.evidence)
    share = F.create_map(*[x for r in counted for x in (F.lit(r["lang"]), F.lit(min(1.0, config.docs_per_lang / r["rows"])))])
    chosen = docs.where((F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 30)) / (1 << 30)) < share[F.col("lang")])
    at, buckets = {x: i for i, x in enumerate(langs)}, config.buckets

    def count(batches):
        c = np.zeros(len(at) * (buckets + 1), np.int64)
        for b in batches:
            of = np.array([at[x] for x in b.column(1).to_pylist()], np.int64)
            for lo, two, three, ends, _ in batches_of_grams(b.column(0), buckets):
                lang = np.repeat(of[lo : lo + len(ends) - 1], np.diff(ends)) * (buckets + 1)
                for seen in (two, three):
                    np.add.at(c, lang + seen, 1)
        c = c.reshape(len(at), buckets + 1)[:, :buckets]
        i, j = np.nonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(c[i, j])], ["i", "j", "c"])

    rows = chosen.select("text", "lang").mapInArrow(count, "i int, j int, c long").groupBy("i", "j").agg(F.sum("c").alias("c")).toArrow()
    c = np.full((len(langs), buckets), config.smoothing)
    c[rows.column(0).to_numpy(), rows.column(1).to_numpy()] += rows.column(2).to_numpy()
    return LangModel(langs, np.log(c / c.sum(axis=1, keepdims=True)).astype(np.float32), config.evidence)


def identify(docs: DataFrame, model: LangModel) -> DataFrame:
    """docs (doc_id, held_out, text) with lang_pred and score in place of text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            langs, scores = shared.value.score(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def training_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang) of the rows that aren't held out."""
    return docs.where(~held_out(F.col("doc_id"), 4, 2)).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))


def predict(docs: DataFrame, config: LangConfig = LangConfig()) -> DataFrame:
    """Learns from the rows that aren't held out (crc32 of doc_id, mod 4, is 2) and predicts for all."""
    common.prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id"), 4, 2).alias("held_out"), F.col("text").cast("string"))
    return identify(rows, train(training_rows(docs), config))


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without those of no language (``und``) or of one less likely than ``least``; all columns and their order stay.

    One scan, no shuffle: each row goes or stays by its own text, whatever its doc_id.
    """
    spark = common.prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(train(training_rows(docs)))

    @F.arrow_udf("boolean")
    def identified(texts: pa.Array) -> pa.Array:
        langs, scores = shared.value.score(texts)
        return pa.array([x != "und" and s >= least for x, s in zip(langs, scores, strict=True)], pa.bool_())

    return docs.where(identified(F.col("text").cast("string")))
