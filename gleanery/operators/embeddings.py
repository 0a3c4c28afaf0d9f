"""Word vectors: lookups with defaults, aspect vectors, subword vectors, nearest words."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gleanery.functions.scores import cosine, rounded
from gleanery.functions.text import first_word

PAD = "<pad>"


def zeros(dim: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.lit(0.0))


def seeded_uniform(word: Column, scale: float, dim: int, seed: int = 0) -> Column:
    """Uniform in (-scale, scale), the same for the same word and seed: a stand-in for random initial vectors."""
    unit = lambda i: F.pmod(F.xxhash64(word, i, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: (unit(i) * 2 - 1) * scale)


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def pretrained(words: DataFrame, table: DataFrame, scale: float, dim: int, pad: bool = True, on: str = "word") -> DataFrame:
    """words with ``vec``: the table's (word, vec) where it has one, zeros for the padding word (if ``pad``), else seeded uniform."""
    found = words.join(table.select(on, as_doubles(F.col("vec")).alias("vec")), on, "left")
    rest = seeded_uniform(F.col(on), scale, dim)
    if pad:
        rest = F.when(F.col(on) == PAD, zeros(dim)).otherwise(rest)
    return found.withColumn("vec", F.coalesce("vec", rest))


def review_vectors(words: DataFrame, table: DataFrame, scale: float, dim: int) -> DataFrame:
    """As pretrained(), but the padding word is a word like any other."""
    return pretrained(words, table, scale, dim, pad=False)


def aspects_from_first_word(aspects: DataFrame, table: DataFrame, aspect: str = "aspect", unknown: str | None = None) -> DataFrame:
    """aspects with the vector of their first word; unknown words take ``unknown``'s vector, if given, else null."""
    rows = aspects.withColumn("word__", first_word(F.col(aspect)))
    out = rows.join(table.select(F.col("word").alias("word__"), "vec"), "word__", "left")
    if unknown is not None:
        default = table.where(F.col("word") == unknown).select(F.col("vec").alias("default__")).limit(1)
        out = out.join(F.broadcast(default), F.lit(True), "left").withColumn("vec", F.coalesce("vec", "default__")).drop("default__")  # one row
    return out.drop("word__")


def aspects_from_table(aspects: DataFrame, table: DataFrame, dim: int, aspect: str = "aspect") -> DataFrame:
    """Vectors looked up by the lower-cased aspect on both sides; the others are seeded uniform in (-.25, .25)."""
    low = table.select(F.lower("word").alias("word__"), as_doubles(F.col("vec")).alias("vec")).dropDuplicates(["word__"])
    out = aspects.withColumn("word__", F.lower(aspect)).join(low, "word__", "left")
    return out.withColumn("vec", F.coalesce("vec", seeded_uniform(F.col("word__"), 0.25, dim))).drop("word__")


class Subwords:
    """A vector for any string: the mean of hashed vectors of its character n-grams. A default provider, not a trained one."""

    def __init__(self, dim: int = 64, buckets: int = 1 << 16, low: int = 3, high: int = 6, seed: int = 0, table: np.ndarray | None = None):
        self.dim, self.buckets, self.low, self.high = dim, buckets, low, high
        self.table = table if table is not None else np.random.default_rng(seed).standard_normal((buckets, dim)).astype(np.float32)

    def vector(self, word: str | None) -> list[float] | None:
        if word is None:
            return None
        w = f"<{word}>"
        ids = []
        for n in range(self.low, self.high + 1):
            for i in range(len(w) - n + 1):
                h = 2166136261
                for b in w[i : i + n].encode():
                    h = ((h ^ b) * 16777619) & 0xFFFFFFFF
                ids.append(h % self.buckets)
        return self.table[ids].mean(axis=0).astype(float).tolist() if ids else [0.0] * self.dim

    def column(self, df: DataFrame, c: str, into: str = "vec") -> DataFrame:
        """df with vectors of a string column, or of each string of an array; other types are cast to string."""
        shared, kind = df.sparkSession.sparkContext.broadcast(self), df.schema[c].dataType.typeName()

        if kind == "array":

            @F.pandas_udf("array<array<double>>")
            def vectors(lists: pd.Series) -> pd.Series:
                return lists.map(lambda ws: None if ws is None else [shared.value.vector(w) for w in ws])

            return df.withColumn(into, vectors(F.col(c)))

        @F.pandas_udf("array<double>")
        def vector(words: pd.Series) -> pd.Series:
            return words.map(shared.value.vector)

        return df.withColumn(into, vector(F.col(c).cast("string")))

    def fill(self, words: DataFrame, table: DataFrame) -> DataFrame:
        """The table (word, vec) with vectors for the distinct words it lacks, so that it covers ``words``."""
        missing = words.select("word").distinct().join(table, "word", "left_anti")
        return table.select("word", as_doubles(F.col("vec")).alias("vec")).unionByName(self.column(missing, "word").select("word", "vec"))


def embedding_table(kind: str, tables: dict[str, DataFrame], words: DataFrame, scale: float, dim: int) -> DataFrame:
    """``w2v``, ``glove`` or ``yelp`` vectors for words; ValueError for another kind."""
    if kind not in ("w2v", "glove", "yelp") or kind not in tables:
        raise ValueError(f"no embedding {kind!r}")
    return pretrained(words, tables[kind], scale, dim, pad=kind != "yelp")


def mean_vector(df: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """(key, vec): element-wise mean, summed before the shuffle."""
    rows = df.select(key, F.posexplode(vec).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(vec))


def nearest(queries: DataFrame, table: DataFrame, k: int = 5, key: str = "vec_id", vec: str = "embedding", most_queries: int = 10_000) -> DataFrame:
    """(query_id, rank, key, cosine): the k most similar rows of the table for each stated query. An extension.

    The number of queries is checked; ties of the cosine to 9 places rank by key. Both sides are packed into blocks, each pair of blocks is
    multiplied in numpy and gives its k best a query. Rows that aren't of the usual length, have nulls or infinities take Spark's expressions."""
    n = queries.count()
    if n > most_queries:
        raise ValueError(f"{n} queries; {most_queries} at most")
    usual = queries.where(F.col(vec).isNotNull()).groupBy(F.size(vec).alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = usual["dim"] if usual else 0
    plain = F.coalesce((F.size(vec) == dim) & F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < 1e100)), F.lit(False))  # NaN is greatest
    whole = dict(table.dtypes)[key] in ("tinyint", "smallint", "int", "bigint") and dict(queries.dtypes)[key] == dict(table.dtypes)[key] and dim > 0
    q, t = (x.select(key, vec).withColumn("plain__", plain if whole else F.lit(False)) for x in (queries, table))
    odd_q, odd_t = (x.where(~F.col("plain__")).drop("plain__") for x in (q, t))
    pairs = lambda x, y: y.join(F.broadcast(x.select(F.col(key).alias("query_id"), F.col(vec).alias("q__"))), F.col(key) != F.col("query_id")).select("query_id", key, cosine(F.col("q__"), F.col(vec)).alias("cosine"))
    found = pairs(odd_q, t.drop("plain__")).unionByName(pairs(q.where("plain__"), odd_t))
    if whole:
        a, b = (_blocks(x.where("plain__"), key, vec, size, name) for x, size, name in ((q, QUERY_BLOCK, "q"), (t, TABLE_BLOCK, "t")))
        cores = table.sparkSession.sparkContext.defaultParallelism
        both = b.repartition(4 * cores).crossJoin(a)
        ids = T.StructType([T.StructField("query_id", queries.schema[key].dataType), T.StructField(key, table.schema[key].dataType), T.StructField("cosine", T.DoubleType())])
        found = found.unionByName(both.mapInArrow(lambda batches: _best(batches, dim, k, key, ids), ids))
    w = W.partitionBy("query_id").orderBy(rounded("cosine", 9).desc_nulls_last(), F.col(key))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Rows of a block of queries and of the table.
QUERY_BLOCK, TABLE_BLOCK = 512, 4096


def _blocks(df: DataFrame, key: str, vec: str, size: int, name: str) -> DataFrame:
    """A row for each ``size`` rows at most: their keys and vectors as bytes."""

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                keys = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                values = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], [f"{name}_keys", f"{name}_values"])

    return df.where(F.col(key).isNotNull()).select(key, vec).mapInArrow(pack, f"{name}_keys binary, {name}_values binary")


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, added up from the first place to the last as Spark's expression does."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _best(batches, dim: int, k: int, key: str, schema: T.StructType):
    """Of pairs of blocks, the k best rows of each query and all that tie with the last of them by what the product can tell."""
    kinds = to_arrow_schema(schema)
    for batch in batches:
        for i in range(batch.num_rows):
            t_keys, t, q_keys, q = (np.frombuffer(batch.column(j)[i].as_buffer(), np.int64 if j in (0, 2) else np.float64) for j in range(4))
            t, q = t.reshape(-1, dim), q.reshape(-1, dim)
            t_norm, q_norm = np.sqrt(_summed(t, t)), np.sqrt(_summed(q, q))
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                near = (q / q_norm[:, None]) @ (t / t_norm[:, None]).T
                near[~np.isfinite(near)] = -2  # a zero vector has no cosine, and ranks last
                near[q_keys[:, None] == t_keys] = -np.inf  # a row isn't its own neighbour
                last = np.partition(near, -min(k, len(t)), axis=1)[:, -min(k, len(t))] if len(t) else np.zeros(len(q))
                row, col = np.nonzero((near >= (last - 1e-8)[:, None]) & (near > -np.inf))
                value = np.concatenate([_summed(q[row[c : c + 50_000]], t[col[c : c + 50_000]]) for c in range(0, len(row), 50_000)] or [np.zeros(0)]) / (q_norm[row] * t_norm[col])
            value[(q_norm[row] * t_norm[col]) == 0] = np.nan
            place = np.where(np.isnan(value), -np.inf, np.floor(np.abs(value) * 1e9 + 0.5) * np.sign(value))
            sort = np.lexsort((t_keys[col], -place, row))
            row, col, value = row[sort], col[sort], value[sort]
            first = np.searchsorted(row, row)
            keep = np.arange(len(row)) - first < k
            columns = q_keys[row[keep]], t_keys[col[keep]], value[keep]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=True) for c, f in zip(columns, kinds, strict=True)], schema=kinds)
