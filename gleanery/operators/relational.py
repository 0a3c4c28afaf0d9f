"""Labelled reviews: sources to columns, unrolling, mixed flags, counts, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BEGIN, END = "<beg>", "<end>"


def category_examples(df: DataFrame) -> DataFrame:
    """(text, aspect, sentiment) from the category form's unrolled rows."""
    return df.select(F.col("sentence").alias("text"), "aspect", "sentiment")


def target_examples(df: DataFrame) -> DataFrame:
    """(text, left_text, right_text, sentiment): left and right sides as tokens between begin and end marks."""
    side = lambda c: F.concat(F.array(F.lit(BEGIN)), F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != ""), F.array(F.lit(END)))
    return df.select(F.col("sentence").alias("text"), side("left").alias("left_text"), side("right").alias("right_text"), "sentiment")


def offset_examples(df: DataFrame) -> DataFrame:
    """(text, offset, aspect, sentiment)."""
    return df.select(F.col("sentence").alias("text"), F.col("of").alias("offset"), F.col("t").alias("aspect"), "sentiment")


def is_mixed(items: Column) -> Column:
    """Whether an array of structs has more than one distinct sentiment."""
    return F.size(F.array_distinct(F.transform(items, lambda x: x["sentiment"]))) > 1


def unroll(df: DataFrame, items: str) -> DataFrame:
    """One row per element of ``items``, its fields as columns, and ``mixed``; empty arrays give no row."""
    fields = df.schema[items].dataType.elementType.fieldNames()
    rest = [c for c in df.columns if c != items]
    return df.select(*rest, is_mixed(F.col(items)).alias("mixed"), F.explode(items).alias("item__")).select(*rest, *[F.col(f"item__.{f}") for f in fields], "mixed")


def sentiment_counts(unrolled: DataFrame) -> DataFrame:
    """(sentiment, n, n_mixed)."""
    return unrolled.groupBy("sentiment").agg(F.count("*").alias("n"), F.count_if("mixed").alias("n_mixed"))


def train_test(train: DataFrame, test: DataFrame, items: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Unrolled train, test and mixed test rows."""
    t = unroll(test, items)
    return unroll(train, items), t, t.where("mixed")


def train_dev_split(df: DataFrame, key: str, ratio: float = 0.1, seed: int | None = 0, compat: bool = False) -> DataFrame:
    """df with ``split``: dev are the last int(ratio * n) rows in seeded hash order (by key if seed is None).

    compat: a ratio that gives no dev row makes all rows dev, as the older splitter did.
    Ranks come from per-bucket counts, so no window holds the whole table."""
    n = df.count()
    dev = int(ratio * n)
    order = F.col(key).cast("long") if seed is None else F.xxhash64(F.col(key), F.lit(seed))
    if compat and dev == 0:
        return df.withColumn("split", F.lit("dev"))
    if dev == 0:
        return df.withColumn("split", F.lit("train"))
    keyed = df.withColumn("order__", order)
    low, high = keyed.agg(F.min("order__"), F.max("order__")).first()
    buckets = max(1, n // 100_000)
    # doubles round, but never out of order
    width = float(max(1, (high - low) // buckets + 1))
    keyed = keyed.withColumn("bucket__", F.floor((F.col("order__").cast("double") - float(low)) / width))
    sizes = {r["bucket__"]: r["count"] for r in keyed.groupBy("bucket__").count().collect()}  # one number per 100 000 rows
    start, starts = 0, []
    for b in sorted(sizes):
        starts.append((b, start))
        start += sizes[b]
    offsets = df.sparkSession.createDataFrame(starts, "bucket__ long, start__ long")
    ranked = keyed.withColumn("rank__", F.row_number().over(W.partitionBy("bucket__").orderBy("order__", key))).join(offsets, "bucket__")
    return ranked.withColumn("split", F.when(F.col("start__") + F.col("rank__") > n - dev, "dev").otherwise("train")).drop("order__", "bucket__", "start__", "rank__")


def aspect_rows(df: DataFrame, sentence: str = "sentence", aspect: str = "aspect") -> DataFrame:
    """One row per aspect, of an array or a single string, and an empty ``sentiment``."""
    kind = df.schema[aspect].dataType.typeName()
    rows = df.withColumn(aspect, F.explode(aspect)) if kind == "array" else df
    return rows.withColumn("sentiment", F.lit(""))


def collect_scores(rows: DataFrame, key: str, sentence: str = "sentence") -> DataFrame:
    """Rows (key, sentence, aspect, sentiment, score, compound) back to one row per sentence, by aspect."""
    item = F.struct("aspect", "sentiment", "score", "compound")
    got = rows.groupBy(key).agg(F.first(sentence).alias(sentence), F.array_sort(F.collect_list(item)).alias("i"))
    return got.select(key, sentence, *[F.col(f"i.{f}").alias(f) for f in ("aspect", "sentiment", "score", "compound")])


def lookup(rows: DataFrame, table: DataFrame, on: str, default: Column, value: str) -> DataFrame:
    """Left join with a default for misses."""
    return rows.join(table, on, "left").withColumn(value, F.coalesce(value, default))


def new_words(words: DataFrame, known: DataFrame, on: str = "word") -> DataFrame:
    """Distinct words that ``known`` lacks."""
    return words.select(on).distinct().join(known.select(on), on, "left_anti")
