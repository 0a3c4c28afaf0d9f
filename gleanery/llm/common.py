"""What the operators share: staged tables, bounded bitmaps, joins that withstand hot keys, components."""

from __future__ import annotations

import atexit
import contextlib
import functools
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of the rows, so at most 1/HOT_SHARE keys are.
HOT_SHARE = 1 / 1024
ARROW_BYTES = 4 << 20


def size_of(setting: str) -> int:
    """Bytes of a setting such as 33554432, 64b, 32m, 32mb or 1g."""
    number, unit = re.fullmatch(r"\s*(-?[0-9]+)\s*([kmgtp]?)b?\s*", setting.lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}[unit]


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches by bytes, as texts may be long; leaves a bound that was set to less than Spark's own 64 MB.

    The setting stays changed: plans read it when they run, which is after the operator that made them has returned.
    """
    if not 0 < size_of(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) < 64 << 20:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, one of our own on a single machine
    (removed when Python ends); on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", "")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="gleanery-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_written: list[list[str]] = []


def stage_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; it stays until the enclosing ``scratch`` ends, outside of one as long as the folder."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _written:
        _written[-1].append(at)
    return at


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: cuts lineage, survives lost executors."""
    at = stage_path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def remove(spark: SparkSession, paths: list[str]) -> None:
    for at in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Removes what was written to the shared folder within, when it ends; for results that have been written elsewhere by then."""
    _written.append([])
    try:
        yield
    finally:
        remove(spark, _written.pop())


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a long column that is never null and that no two rows share, and its name.

    doc_id itself where it is such a key, which one pass over the ids finds out; else row numbers in a staged copy.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n"))
    if dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint") and ids.where("n > 1 or doc_id is null").isEmpty():
        return docs, "doc_id"
    name = fresh(docs, "row__")
    return staged(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, however its columns are named."""
    names = {c.lower() for c in df.columns}
    while stem.lower() in names:
        stem += "_"
    return stem


def null_first_key(c: Column) -> Column:
    """A struct that joins nulls with nulls by plain equality."""
    return F.struct(c.isNull().alias("n"), F.coalesce(c, F.lit(0)).alias("v"))


def bitmap(keys: DataFrame, column: str, rows: int, most_bits: int = 27) -> tuple[DataFrame, int]:
    """A Bloom-like set of the long ``column`` (one hash): a table (bucket, bits) and its number of bits' logarithm.

    It takes at most 2^27 bits, 16 MB, whatever the number of keys: beyond that it only lets more through.
    """
    power = min(most_bits, max(15, int(max(rows, 1) * 16).bit_length()))
    at = F.pmod(F.xxhash64(column), F.lit(1 << power)) + 1
    # bitmap_bucket_number counts from 1 over 32768 positions
    table = keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    return table, power


def in_bitmap(df: DataFrame, column: Column, table: DataFrame, power: int, name: str) -> DataFrame:
    """df with boolean ``name``: false only where the column's value is surely not in the set. No shuffle of df."""
    b, bits, bucket = fresh(df, "at__"), fresh(df, "bits__"), fresh(df, "bucket__")
    table = table.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits))
    at = df.withColumn(b, F.pmod(F.xxhash64(column), F.lit(1 << power)) + 1)
    joined = at.join(F.broadcast(table), F.bitmap_bucket_number(b) == F.col(bucket), "left")
    pos = F.bitmap_bit_position(F.col(b)).cast("int")
    byte = F.conv(F.hex(F.expr(f"substring(`{bits}`, cast(bitmap_bit_position(`{b}`) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.floor(byte / F.pow(F.lit(2), pos % 8)).cast("int") % 2 == 1, F.lit(False))
    return joined.withColumn(name, hit).drop(b, bits, bucket)


def skew_join(left: DataFrame, right: DataFrame, on: str, weight: str, how: str = "inner") -> DataFrame:
    """Joins ``left`` (many rows a key) with ``right`` (one row a key; ``weight`` is the key's number of rows in left).

    Keys that hold over HOT_SHARE of all rows number under 1/HOT_SHARE, whatever the size: these are
    broadcast and never shuffled. The others join by shuffle. ``weight`` is kept. Keys are not null.
    """
    total = right.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    limit = max(1000, int(total * HOT_SHARE))
    hot, cold = right.where(F.col(weight) > limit), right.where(F.col(weight) <= limit)
    if hot.isEmpty():
        return left.join(right, on, how)
    flag = fresh(left, "hot__")
    marked = left.join(F.broadcast(hot.select(on).withColumn(flag, F.lit(True))), on, "left")
    a = marked.where(F.col(flag)).drop(flag).join(F.broadcast(hot), on, "inner")
    b = marked.where(F.col(flag).isNull()).drop(flag).join(cold, on, how)
    return a.unionByName(b)


def without(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Rows of df whose long ``key`` isn't in ``gone``; of df only rows that a bounded bitmap lets suspect are shuffled."""
    n = gone.count()
    if n == 0:
        return df
    table, power = bitmap(gone, key, n)
    flag = fresh(df, "maybe__")
    marked = in_bitmap(df, F.col(key), table, power, flag)
    surely = marked.where(~F.col(flag)).drop(flag)
    rest = marked.where(F.col(flag)).drop(flag).join(gone.select(key).distinct(), key, "left_anti")
    return surely.unionByName(rest)


def only(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of df whose long ``key`` is in ``wanted``; only rows that pass a bounded bitmap are shuffled."""
    table, power = bitmap(wanted, key, wanted.count())
    flag = fresh(df, "maybe__")
    marked = in_bitmap(df, F.col(key), table, power, flag).where(F.col(flag)).drop(flag)
    return marked.join(wanted.select(key).distinct(), key, "left_semi")


def _local_unions(batches):
    """Union-find over a partition's links: replaces them by one link from each node to its least fellow."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 500_000:  # a bounded table; what it knows goes out as links
            yield _star(parent, find)
            parent.clear()
    yield _star(parent, find)


def _star(parent, find) -> pa.RecordBatch:
    pairs = [(x, find(x)) for x in list(parent)]
    pairs = [p for p in pairs if p[0] != p[1]]
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: long): the component is its least node.

    Union-find inside each partition, then rounds that take each node to its least neighbour and contract
    the links; each round at least halves the nodes that still have links. Nothing is collected.
    """
    links = staged(links.select("a", "b").where("a <> b").mapInArrow(_local_unions, "a long, b long"), "links")
    maps: list[DataFrame] = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("p"), F.count("*").alias("w")), "least")
        maps.append(least.select(F.col("a").alias("node"), F.col("p").alias("to"), "w"))
        step = skew_join(links, least.select("a", F.col("p").alias("pa"), "w"), "a", "w").select("pa", "b")
        step = skew_join(step, least.select(F.col("a").alias("b"), F.col("p").alias("pb"), "w"), "b", "w")
        links = staged(step.select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a <> b").distinct().mapInArrow(_local_unions, "a long, b long"), "links")
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[-1].select("node", "to")
    for earlier in reversed(maps[:-1]):
        later = out.withColumnRenamed("to", "end").withColumnRenamed("node", "to")
        sizes = earlier.groupBy("to").agg(F.count("*").alias("w"))
        moved = skew_join(earlier.select("node", "to"), sizes.join(later, "to", "left"), "to", "w", "inner")
        out = staged(moved.select("node", F.coalesce("end", "to").alias("to")), "map")
    # nodes that vanished in a later round have themselves as roots there
    return out.select("node", F.col("to").alias("component"))


def once(f):
    """Keeps the first result; for models that a worker unpacks."""
    return functools.lru_cache(maxsize=1)(f)


def lookup(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each value in sorted ``keys``, or -1."""
    if len(keys) == 0:
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, -1)


def salted_join(left: DataFrame, right: DataFrame, on: str, weights: DataFrame, salt_by: str, per: int = 20_000) -> DataFrame:
    """Inner join of ``left`` with wide rows of ``right`` (one a key), a hot key's rows spread over salts.

    ``weights`` (on, w) counts left's rows a key. Keys with more than max(per, HOT_SHARE of all) rows number
    under 1/HOT_SHARE; their names and salts alone are broadcast, and their right rows are repeated once a salt.
    """
    total = weights.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    limit = max(per, int(total * HOT_SHARE))
    hot = weights.where(F.col("w") > limit).select(on, F.ceil(F.col("w") / limit).cast("int").alias("salts__"))
    if hot.isEmpty():
        return left.join(right, on)
    a = left.join(F.broadcast(hot), on, "left").withColumn("salt__", F.when(F.col("salts__").isNull(), 0).otherwise(F.pmod(F.xxhash64(salt_by), F.col("salts__")).cast("int"))).drop("salts__")
    b = right.join(F.broadcast(hot), on, "left").withColumn("salt__", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts__") - 1, F.lit(0))))).drop("salts__")
    return a.join(b, [on, "salt__"]).drop("salt__")
