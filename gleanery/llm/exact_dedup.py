"""Exact dedup by stateful streaming (operator 7).

A streaming aggregation holds, in a disk-backed RocksDB store without expiry, one entry per digest: the
digest and length as key; the stable identifier (largest doc_id), a content locator (the file that holds
that row) and the count as value. Partial aggregation runs before the shuffle, so a text that fills a third of
the table sends one row per task. On hits (entries seen more than once) the full bytes are compared, again by
partial aggregation: a group is sound when its least and its greatest text are the same; the members of any
other group (a digest collision) are grouped by their text itself.

Defined cases: null text counts as empty, and all empty texts are equal. Case folding is A-Z only. The row
with the largest doc_id stays; null ids are least, and a group of null ids alone keeps them (keep_id null).
Rows that repeat the staying doc_id stay together. An empty table gives an empty result. Other columns of
any name are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import common

RESULT = "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CONF = {
    "spark.sql.streaming.stateStore.providerClass": _ROCKS,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
}


def _normal(texts: pa.Array) -> pa.Array:
    return pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))


def digests(docs: DataFrame, digest_bits: int = 256) -> DataFrame:
    """(doc_id, locator, sha, digest, n_bytes) of each row; ``digest`` is the first ``digest_bits`` of sha, 256 but in tests."""

    def run(batches):
        for b in batches:
            shas, sizes = [], []
            for t in _normal(b.column(1)):
                raw = t.as_buffer()
                shas.append(hashlib.sha256(raw if raw is not None else b"").hexdigest())
                sizes.append(raw.size if raw is not None else 0)
            short = shas if digest_bits >= 256 else [f"{int(s, 16) >> (256 - digest_bits):x}" for s in shas]
            lengths = sizes if digest_bits >= 256 else [0] * len(sizes)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(shas, pa.string()), pa.array(short, pa.string()), pa.array(lengths, pa.int64())], ["doc_id", "locator", "sha", "digest", "n_bytes"])

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.input_file_name().alias("locator"))
    return slim.mapInArrow(run, "doc_id long, locator string, sha string, digest string, n_bytes long")


def stateful_index(spark: SparkSession, stream: DataFrame, checkpoint: str) -> DataFrame:
    """Runs a streaming table (doc_id, locator, digest, n_bytes) into the store at ``checkpoint`` until its source is
    used up, and returns the store: (digest, n_bytes, keep_id, locator, n). A second call goes on from what is there."""
    before = {k: spark.conf.get(k, None) for k in _CONF}
    for k, v in _CONF.items():
        spark.conf.set(k, v)
    try:
        kept = stream.groupBy("digest", "n_bytes").agg(F.max(F.struct("doc_id", "locator")).alias("keep"), F.count("*").alias("n"))
        q = kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
        fields = [f.name for f in state.schema["value"].dataType.fields]
        out = state.select("key.digest", "key.n_bytes", F.col(f"value.`{fields[0]}`").alias("keep"), F.col(f"value.`{fields[1]}`").alias("n"))
        return common.staged(out.select("digest", "n_bytes", F.col("keep.doc_id").alias("keep_id"), F.col("keep.locator").alias("locator"), "n"), "dedup-index")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _verified(docs: DataFrame, slim: DataFrame, hits: DataFrame, n_hits: int, digest_bits: int) -> DataFrame:
    """Hits (digest, n_bytes) whose members' full bytes differ."""
    table, power = common.bitmap(hits, "digest", n_hits)

    def run(batches):
        for b in batches:
            norm = _normal(b.column(0))
            shas = [hashlib.sha256(t.as_py().encode()).hexdigest() for t in norm]
            short = shas if digest_bits >= 256 else [f"{int(s, 16) >> (256 - digest_bits):x}" for s in shas]
            sizes = pc.binary_length(norm).cast(pa.int64()) if digest_bits >= 256 else pa.array([0] * len(shas), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(short, pa.string()), sizes, norm.cast(pa.string())], ["digest", "n_bytes", "norm"])

    texts = docs.select(F.col("text").cast("string")).mapInArrow(run, "digest string, n_bytes long, norm string")
    suspect = common.in_bitmap(texts, F.col("digest"), table, power, "maybe").where("maybe").drop("maybe")
    ranged = suspect.groupBy("digest", "n_bytes").agg(F.min("norm").alias("a"), F.max("norm").alias("b"))
    return ranged.where("a <> b").select("digest", "n_bytes")


def dedup(docs: DataFrame, digest_bits: int = 256, files_per_trigger: int = 100_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = common.prepare(docs.sparkSession)
    slim = common.staged(digests(docs, digest_bits), "digests")
    source = slim.inputFiles()
    if not source:
        return spark.createDataFrame([], RESULT)
    stream = spark.readStream.schema(slim.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source[0].rsplit("/", 1)[0])
    index = stateful_index(spark, stream, common.stage_path(spark, "dedup-state"))
    hits = index.where("n > 1")
    n_hits = hits.count()
    slim = slim.select("doc_id", "sha", "digest", "n_bytes")
    alone = slim.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    if n_hits == 0:
        return alone
    key = F.concat_ws(":", "digest", F.col("n_bytes").cast("string"))
    wrong = common.staged(_verified(docs, slim, hits.select("digest"), n_hits, digest_bits), "collisions")
    collided = not wrong.isEmpty()
    groups = hits.withColumn("k", key).select("k", F.col("keep_id"), F.col("n").alias("group_size"))
    if collided:
        groups = groups.join(wrong.select(key.alias("k")), "k", "left_anti")
    rows = slim.withColumn("k", key)
    # rows whose digest occurs once never meet the join
    table, power = common.bitmap(hits.select(key.alias("k")), "k", n_hits)
    rows = common.in_bitmap(rows, F.col("k"), table, power, "maybe")
    found = common.skew_join(rows.where("maybe"), groups, "k", "group_size", "left")
    out = rows.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256")).unionByName(
        found.select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), "sha").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
    )
    if not collided:
        return out
    return _regroup(docs, slim, out, wrong, digest_bits)


def _regroup(docs: DataFrame, slim: DataFrame, out: DataFrame, wrong: DataFrame, digest_bits: int) -> DataFrame:
    """Members of collided digests, grouped by their text itself, in place of their rows in ``out``."""

    def run(batches):
        for b in batches:
            norm = _normal(b.column(1))
            shas = [hashlib.sha256(t.as_py().encode()).hexdigest() for t in norm]
            short = [f"{int(s, 16) >> (256 - digest_bits):x}" for s in shas]
            sizes = pc.binary_length(norm).cast(pa.int64()) if digest_bits >= 256 else pa.array([0] * len(shas), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shas, pa.string()), pa.array(short, pa.string()), sizes, norm.cast(pa.string())], ["doc_id", "text_sha256", "digest", "n_bytes", "norm"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text_sha256 string, digest string, n_bytes long, norm string")
    texts = texts.join(wrong, ["digest", "n_bytes"], "left_semi")
    sizes = texts.groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    again = common.skew_join(texts, common.staged(sizes, "regrouped"), "norm", "group_size")
    again = again.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    stale = slim.join(wrong, ["digest", "n_bytes"], "left_semi").select(F.col("sha").alias("text_sha256")).distinct()
    return out.join(stale, "text_sha256", "left_anti").select(again.columns).unionByName(again)


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each text; all columns stay. Only rows under suspicion are shuffled.

    The row with the largest doc_id stays; where ids repeat or are null, one of the rows with the largest, null being
    least. So rows go by what their own text says, whatever other rows share their doc_id.
    """
    keyed, key = common.with_row_key(docs)
    if key == "doc_id":
        gone = dedup(keyed.select("doc_id", "text")).where("not kept").select("doc_id")
    else:  # grouped by row number; of each group the rows but the one with the largest doc_id go
        judged = dedup(keyed.select(F.col(key).alias("doc_id"), "text")).where("group_size > 1")
        named = common.staged(keyed.select(F.col(key).alias("doc_id"), F.struct(F.col("doc_id").cast("long").alias("id"), F.col(key).alias("row")).alias("by")).join(judged.select("doc_id", "keep_id", "group_size"), "doc_id"), "copies")
        last = named.groupBy("keep_id").agg(F.max("by").alias("last"), F.count("*").alias("w"))
        gone = common.skew_join(named, common.staged(last, "last-copies"), "keep_id", "w").where("by.row <> last.row").select(F.col("by.row").alias(key))
    kept = common.without(keyed, key, common.staged(gone, "copies"))
    return kept if key == "doc_id" else kept.drop(key)
