"""Mixing sources to target weights (operator 5).

The words of each source form one stream, packed into blocks of ``block_words``. The mix has a fixed number of
slots, dealt to output shards. Each shard draws the number of slots per source from a multinomial, seeded by its
number. Draws are conditioned on the sources' quotas: a source's slots past its quota go, in order, to sources
that came out short, so each source's words miss its target by about a block. Slot j of a source takes block
pi(j mod n) in pass j div n, with pi a keyed Feistel permutation of the source's n blocks; so no block is used
more than ceil(quota / n) times, at most 3. Blocks are joined by (source, block).

Nothing holds a whole source: its stream is laid out by hash buckets of about ``bucket_rows`` documents,
whose totals alone are summed over the source.

Defined cases: null text has size 0 and takes no place; null source is a source of its own, last in order;
null doc_id is an id like any other; repeated rows each take part; an empty table gives an empty result; a
table without words has targets 0. Columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.llm import common, textkit

RESULT = "doc_id long, size long, source_size long, target double, taken long"


@dataclass(frozen=True)
class MixConfig:
    block_words: int = 128
    shard_slots: int = 8192
    weights: tuple[float, ...] = (1.0, 2.0, 3.0)
    most_passes: int = 3
    bucket_rows: int = 50_000
    seed: int = 20
    most_sources: int = 1_000_000  #: the multinomial needs one number per source in memory; beyond this it refuses


def targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; the excess is shared again by weight."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / w > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def permuted(index: np.ndarray, n: np.ndarray | int, key: np.ndarray | int) -> np.ndarray:
    """Images of ``index`` under keyed permutations of 0..n-1: a four-round Feistel network with cycle walking."""
    x = index.astype(np.uint64)
    n = np.broadcast_to(np.asarray(n, np.uint64), x.shape)
    key = np.broadcast_to(np.asarray(key, np.uint64), x.shape)
    half = np.ones(x.shape, np.uint64)
    while True:
        small = (np.uint64(1) << (half * np.uint64(2))) < n
        if not small.any():
            break
        half = half + small.astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(x))
    while len(todo):
        left, right, h, m, k = x[todo] >> half[todo], x[todo] & mask[todo], half[todo], mask[todo], key[todo]
        for r in range(4):
            left, right = right, left ^ (textkit.mix(right + k + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) & m)
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


@dataclass
class Plan:
    """What the driver decides: one number of each kind per source."""

    names: list[str | None]
    sizes: np.ndarray
    target: np.ndarray
    blocks: np.ndarray
    quota: np.ndarray


def plan_of(slim: DataFrame, config: MixConfig) -> Plan:
    rows = slim.groupBy("source").agg(F.sum("size").alias("size")).limit(config.most_sources + 1).collect()
    if len(rows) > config.most_sources:
        raise ValueError(f"more than {config.most_sources} sources: a multinomial over them doesn't fit one task")
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] or 0 for r in rows]
    w = [config.weights[i % len(config.weights)] for i in range(len(rows))]
    target = np.array(targets(sizes, w, sum(sizes), config.most_passes))
    size = np.array(sizes, np.int64)
    blocks = -(-size // config.block_words)
    quota = np.where(size > 0, np.rint(target * blocks / np.maximum(size, 1)), 0).astype(np.int64)
    return Plan([r["source"] for r in rows], size, target, blocks, np.minimum(quota, config.most_passes * blocks))


def slots(spark: SparkSession, plan: Plan, config: MixConfig) -> DataFrame:
    """(shard, sid, rank, pass_no, block): what each slot of each shard takes."""
    total = int(plan.quota.sum())
    schema = "shard long, sid int, rank long, pass_no int, block long"
    if total == 0:
        return spark.createDataFrame([], schema)
    size, seed, quota, blocks = config.shard_slots, config.seed, plan.quota, plan.blocks
    p = quota / quota.sum()

    def draw(batches):
        for b in batches:
            for shard in b.column(0).to_pylist():
                m = min(size, total - shard * size)
                c = np.random.default_rng([seed, shard]).multinomial(m, p)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), shard), pa.int64()), pa.array(np.arange(len(c)), pa.int32()), pa.array(c, pa.int64())], ["shard", "sid", "c"])

    drawn = common.staged(spark.range(-(-total // size)).mapInArrow(draw, "shard long, sid int, c long"), "draws")
    sums = {r["sid"]: r["n"] for r in drawn.groupBy("sid").agg(F.sum("c").alias("n")).collect()}
    n = np.array([sums.get(i, 0) for i in range(len(quota))], np.int64)
    surplus, short = np.maximum(n - quota, 0), np.maximum(quota - n, 0)
    surplus_from = np.cumsum(surplus) - surplus
    short_to = np.cumsum(short)
    before = W.partitionBy("sid").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    started = drawn.withColumn("start", F.coalesce(F.sum("c").over(before), F.lit(0))).where("c > 0")

    def deal(batches):
        for b in batches:
            for shard, sid, c, start in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                rank = np.arange(start, start + c)
                s = np.full(c, sid, np.int64)
                over = rank >= quota[sid]
                if over.any():
                    i = surplus_from[sid] + rank[over] - quota[sid]
                    t = np.searchsorted(short_to, i, "right")
                    s[over], rank[over] = t, n[t] + i - (short_to[t] - short[t])
                per = blocks[s]
                turn = rank // per
                key = textkit.mix((np.uint64(seed) << np.uint64(40)) + s.astype(np.uint64) * np.uint64(8) + turn.astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(c, shard), pa.int64()), pa.array(s, pa.int32()), pa.array(rank, pa.int64()), pa.array(turn, pa.int32()), pa.array(permuted(rank % per, per, key), pa.int64())], ["shard", "sid", "rank", "pass_no", "block"])

    return started.select("shard", "sid", "c", "start").mapInArrow(deal, schema)


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def layout(docs: DataFrame, config: MixConfig, extra: list[str] = []) -> tuple[DataFrame, Plan]:
    """Each document's place in its source's stream: (doc_id, size, sid, bucket, rn, start, *extra), and the plan."""
    spark = docs.sparkSession
    slim = common.staged(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text").cast("string")).alias("size"), *extra), "sizes")
    plan = plan_of(slim, config)
    if not plan.names:
        return slim.select("doc_id", "size", *extra), plan
    buckets = max(1, -(-slim.count() // config.bucket_rows))
    ids = spark.createDataFrame([(i, x) for i, x in enumerate(plan.names)], "sid int, name string")  # at most most_sources rows
    placed = slim.join(F.broadcast(ids), F.col("source").eqNullSafe(F.col("name"))).drop("source", "name")
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(config.seed)), F.lit(buckets)))
    inside = W.partitionBy("sid", "bucket").orderBy(F.xxhash64("doc_id"), "doc_id", "size")
    placed = placed.withColumn("rn", F.row_number().over(inside)).withColumn("until", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    sums = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("total"))
    over = W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("total").over(over), F.lit(0)).alias("base"))
    return placed.join(sums, ["sid", "bucket"]).withColumn("start", F.col("base") + F.col("until") - F.col("size")).drop("until", "base"), plan


def mix(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken."""
    spark = common.prepare(docs.sparkSession)
    placed, plan = layout(docs, config)
    if not plan.names:
        return spark.createDataFrame([], RESULT)
    b = config.block_words
    uses = slots(spark, plan, config).groupBy("sid", "block").agg(F.count("*").alias("uses"))
    first, last = F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b)
    pieces = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    lo, hi = F.greatest(F.col("start"), F.col("block") * b), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
    pieces = pieces.withColumn("words", F.coalesce(hi - lo, F.lit(0)))
    joined = pieces.join(uses.hint("merge"), ["sid", "block"], "left")  # its size can't be seen in advance, so it is never broadcast
    taken = joined.groupBy("sid", "bucket", "rn", "doc_id", "size").agg(F.sum(F.col("words") * F.coalesce("uses", F.lit(0))).alias("taken"))
    per = spark.createDataFrame([(i, int(s), float(t)) for i, (s, t) in enumerate(zip(plan.sizes, plan.target, strict=True))], "sid int, source_size long, target double")
    return taken.join(F.broadcast(per), "sid").select("doc_id", "size", "source_size", "target", F.col("taken").cast("long"))


def mixed_blocks(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """The mix itself: (shard, source, rank, pass_no, block, text), one row per slot, its words joined by spaces."""
    spark = common.prepare(docs.sparkSession)
    placed, plan = layout(docs, config, [F.col("text").cast("string").alias("text")])
    if not plan.names:
        return spark.createDataFrame([], "shard long, source string, rank long, pass_no int, block long, text string")
    b = config.block_words
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    pieces = placed.where("size > 0").withColumn("words", words)
    pieces = pieces.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))))
    lo, hi = F.greatest(F.col("start"), F.col("block") * b), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
    pieces = pieces.select("sid", "block", lo.alias("at"), F.slice("words", (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int")).alias("part"))
    whole = pieces.groupBy("sid", "block").agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"])), " ").alias("text"))  # a block has block_words words at most
    names = spark.createDataFrame([(i, x) for i, x in enumerate(plan.names)], "sid int, source string")
    return slots(spark, plan, config).hint("merge").join(whole, ["sid", "block"]).join(F.broadcast(names), "sid").select("shard", "source", "rank", "pass_no", "block", "text")
