"""Benchmark decontamination by winnowing (operator 9).

Both sides keep the minimum k-gram hash of each sliding window of w k-grams, with k + w - 1 = ``window``, so any
shared run of ``window`` words shares a fingerprint. Fingerprints are joined on their hash, and matches are extended word by
word in both directions, as far as the windows that hold them reach, all matches of a batch at once; matches that go on from
each other are one run, which is compared byte for byte, and runs of at least ``window`` words are hits. A place of an item
whose surroundings recur in it is kept once, so that periodic texts meet no more often than others. Items shorter than a window are looked up whole by the hash of their few words.

The benchmark is read in shards of at most ``shard_words`` words; a shard's index has a proven bound, so it is
sent to all tasks, and documents are scanned where they lie, without a shuffle. One shard gives the result
in one pass. More shards give one pass each; the hit spans (hit documents only) are united per document.

Defined cases: null or wordless text has no words and is clean; null or wordless items have no window; equal items
count each; a null item_id is written as "null"; doc_id may be null or repeat (each row is judged alone); an
empty benchmark leaves every document clean. Columns of other names pass unread.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import common, textkit

RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
GRAM = 5


def windows_minimum(h: np.ndarray, w: int) -> np.ndarray:
    """Flags of the hashes that are the least of some run of w consecutive ones."""
    n = len(h)
    if n < w:
        return np.zeros(n, bool)
    least = h[: n - w + 1].copy()
    for j in range(1, w):
        np.minimum(least, h[j : n - w + 1 + j], out=least)
    out = np.zeros(n, bool)
    for j in range(w):
        out[j : n - w + 1 + j] |= h[j : n - w + 1 + j] == least
    return out


@dataclass
class Index:
    """Fingerprints of a bounded set of items."""

    window: int
    hashes: np.ndarray  #: sorted fingerprints; the same hash may stand for many places
    where: np.ndarray  #: (sequence, position) of each
    short: dict[int, tuple[np.ndarray, np.ndarray]]  #: length: sorted hashes and their sequence
    words: np.ndarray  #: word hashes of all distinct word sequences, one after the other
    base: np.ndarray  #: n+1 offsets of the sequences' words
    text: bytes  #: their words, a space after each
    at: np.ndarray  #: n+1 offsets of the words in it
    ids: list[list[str]]  #: item_ids of each sequence


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = textkit.buffer_of(texts)
    data = textkit.LOWER[data]
    starts, ends, rows = textkit.spans(data, offsets, textkit.SYMBOL)
    return data, starts, ends, rows


def build(items: pa.Table, window: int = 10) -> Index:
    w = window - GRAM + 1
    data, starts, ends, rows = words_of(items.column("text").combine_chunks())
    raw = data.tobytes()
    known: dict[bytes, int] = {}
    ids: list[list[str]] = []
    kept: list[tuple[int, int]] = []  # word ranges of the distinct sequences
    for i, item in enumerate(items.column("item_id").to_pylist()):
        a, b = int(rows[i]), int(rows[i + 1])
        if a == b:
            continue
        text = b" ".join(raw[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True))
        s = known.setdefault(text, len(ids))
        if s == len(ids):
            kept.append((a, b))
            ids.append([])
        ids[s].append("null" if item is None else str(item))
    hashes = textkit.word_hashes(data, starts, ends)
    base = np.concatenate([[0], np.cumsum([b - a for a, b in kept], dtype=np.int64)])
    places = np.concatenate([np.arange(a, b) for a, b in kept]) if kept else np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(ends[places] - starts[places] + 1)])
    index = Index(window, np.zeros(0, np.uint64), np.zeros((0, 2), np.int64), {}, hashes[places], base, b"".join(t + b" " for t in known), at, ids)
    prints, where, short = [], [], {}
    for s in range(len(ids)):
        h = index.words[base[s] : base[s + 1]]
        if len(h) < window:
            short.setdefault(len(h), []).append((textkit.shingle_hashes(h, len(h))[0], s))
            continue
        g = textkit.shingle_hashes(h, GRAM)
        q = np.flatnonzero(windows_minimum(g, w))
        # surroundings: all words of windows that hold the gram; beyond the text's ends each place is one of its own
        around = np.concatenate([textkit.mix(np.arange(1, w, dtype=np.uint64)), h, textkit.mix(np.arange(w, 2 * w - 1, dtype=np.uint64))])
        q = q[np.sort(np.unique(textkit.shingle_hashes(around, GRAM + 2 * (w - 1))[q], return_index=True)[1])]
        prints.append(g[q])
        where.append(np.stack([np.full(len(q), s), q], axis=1))
    if prints:
        h, p = np.concatenate(prints), np.concatenate(where)
        order = np.argsort(h, kind="stable")
        index.hashes, index.where = h[order], p[order]
    for n, pairs in short.items():
        pairs.sort()
        index.short[n] = np.array([x[0] for x in pairs], np.uint64), np.array([x[1] for x in pairs], np.int64)
    return index


def _matches(keys: np.ndarray, values: np.ndarray, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in values, place in sorted keys) of equal hashes."""
    at = np.flatnonzero(usable)
    lo = np.searchsorted(keys, values[at], "left")
    some = np.flatnonzero(lo < len(keys))
    some = some[keys[lo[some]] == values[at[some]]]
    at, lo = at[some], lo[some]
    n = np.searchsorted(keys, values[at], "right") - lo
    return np.repeat(at, n), np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _runs(index: Index, h: np.ndarray, rows: np.ndarray, owner: np.ndarray, place: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, ...]:
    """(word, sequence, word in it, length) of the runs of at least a window that matching grams belong to, by word hashes."""
    s, q = index.where[key].T
    row, y = owner[place], index.base[s] + q
    w = index.window - GRAM + 1
    reach = []
    for step, room in ((-1, np.minimum(place - rows[row], q)), (1, np.minimum(rows[row + 1] - place, index.base[s + 1] - y) - GRAM)):
        n = np.zeros(len(place), np.int64)
        todo = np.arange(len(place))
        for i in range(1, w):
            todo = todo[room[todo] >= i]
            d = -i if step < 0 else GRAM - 1 + i
            todo = todo[h[place[todo] + d] == index.words[y[todo] + d]]
            n[todo] = i
        reach.append(n)
    full = np.flatnonzero(reach[0] + reach[1] + GRAM >= index.window)
    x, s, q = place[full] - reach[0][full], s[full], q[full] - reach[0][full]
    until = place[full] + GRAM + reach[1][full]
    order = np.lexsort((x, x - q, s, row[full]))
    x, s, q, until, row = x[order], s[order], q[order], until[order], row[full][order]
    # runs of one row, sequence and diagonal that touch are one
    new = np.ones(len(x), bool)
    new[1:] = (row[1:] != row[:-1]) | (s[1:] != s[:-1]) | ((x - q)[1:] != (x - q)[:-1]) | (x[1:] > until[:-1])
    first = np.flatnonzero(new)
    return x[first], s[first], q[first], (np.maximum.reduceat(until, first) if len(first) else until) - x[first]


def scan(index: Index, texts: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int, int]]]]:
    """Number of words of each text, and its hit spans (start, end, sequence)."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    counts = np.zeros(len(texts), np.int64)
    all_data, all_offsets = textkit.buffer_of(texts)
    w = index.window - GRAM + 1
    for a, b in textkit.chunks(all_offsets):
        offsets = all_offsets[a : b + 1] - all_offsets[a]
        data = textkit.LOWER[all_data[all_offsets[a] : all_offsets[b]]]
        starts, ends, rows = textkit.spans(data, offsets, textkit.SYMBOL)
        counts[a:b] = np.diff(rows)
        if not len(starts):
            continue
        h = textkit.word_hashes(data, starts, ends)
        owner = np.repeat(np.arange(b - a), np.diff(rows))
        same = lambda p, s, q, n: b"".join(data[starts[i] : ends[i]].tobytes() + b" " for i in range(p, p + n)) == index.text[index.at[index.base[s] + q] : index.at[index.base[s] + q + n]]  # noqa: E731, B023
        if len(index.hashes):
            g = textkit.shingle_hashes(h, GRAM)
            place, key = _matches(index.hashes, g, windows_minimum(g, w) & (owner[: len(g)] == owner[GRAM - 1 :]))
            for p, s, q, n in zip(*(x.tolist() for x in _runs(index, h, rows, owner, place, key)), strict=True):
                if same(p, s, q, n):
                    row = int(owner[p])
                    found[a + row].append((p - int(rows[row]), p - int(rows[row]) + n, s))
        for n, (keys, seq) in index.short.items():
            if len(h) < n:
                continue
            place, key = _matches(keys, textkit.shingle_hashes(h, n), owner[: len(h) - n + 1] == owner[n - 1 :])
            for p, k in zip(place.tolist(), key.tolist(), strict=True):
                s, row = int(seq[k]), int(owner[p])
                if same(p, s, 0, n):
                    found[a + row].append((p - int(rows[row]), p - int(rows[row]) + n, s))
    return counts, found


def covered(pieces: list[tuple[int, int]]) -> int:
    """Number of words in the union of spans."""
    total, until = 0, 0
    for a, b in sorted(pieces):
        total += max(0, b - max(a, until))
        until = max(until, b)
    return total


def _digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def shards_of(benchmark: DataFrame, shard_words: int) -> list[DataFrame]:
    """The items in parts of at most about ``shard_words`` words, by hash; one part for a small benchmark."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[A-Za-z0-9\x{80}-\x{10FFFF}]+")), F.lit(0))
    total = benchmark.agg(F.coalesce(F.sum(words), F.lit(0))).first()[0]
    n = max(1, -(-total // shard_words))
    return [benchmark] if n == 1 else [benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_words: int = 5_000_000) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    if window < GRAM:
        raise ValueError(f"window must be {GRAM} at least")
    spark = common.prepare(docs.sparkSession)
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = shards_of(items, shard_words)
    if len(parts) == 1:
        index = spark.sparkContext.broadcast(build(parts[0].toArrow(), window))

        def whole(batches):
            ix = index.value
            for b in batches:
                counts, found = scan(ix, b.column(1))
                hit = [covered([(x, y) for x, y, _ in f]) for f in found]
                ids = [[i for s in {s for *_, s in f} for i in ix.ids[s]] for f in found]
                columns = [b.column(0), pa.array(counts), pa.array(hit, pa.int64()), pa.array([len(i) for i in ids], pa.int64()), pa.array([_digest(i) for i in ids], pa.string()), pa.array([x > 0 for x in hit], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

        return slim.mapInArrow(whole, RESULT)
    return _in_shards(slim, parts, window)


def _in_shards(slim: DataFrame, parts: list[DataFrame], window: int) -> DataFrame:
    """One pass a shard; a document's hits meet by its row number in the staged table."""
    spark = slim.sparkSession
    rows = common.staged(slim.withColumn("row", F.monotonically_increasing_id()), "docs")
    hits = None
    for part in parts:
        index = spark.sparkContext.broadcast(build(part.toArrow(), window))

        def run(batches, index=index):
            ix = index.value
            for b in batches:
                _, found = scan(ix, b.column(1))
                keep = [(r, f) for r, f in zip(b.column(0).to_pylist(), found, strict=True) if f]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r for r, _ in keep], pa.int64()),
                        pa.array([[{"a": x, "b": y} for x, y, _ in f] for _, f in keep], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                        pa.array([[i for s in {s for *_, s in f} for i in ix.ids[s]] for _, f in keep], pa.list_(pa.string())),
                    ],
                    ["row", "spans", "ids"],
                )

        found = common.staged(rows.select("row", "text").mapInArrow(run, "row long, spans array<struct<a:long,b:long>>, ids array<string>"), "hits")
        hits = found if hits is None else hits.unionByName(found)
    # one row a document and shard with a hit
    united = hits.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.flatten(F.collect_list("ids")).alias("ids"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], acc["u"]))).cast("long").alias("n"), F.greatest(acc["u"], s["b"]).cast("long").alias("u"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("u"))
    united = united.select("row", F.aggregate("spans", zero, step, lambda acc: acc["n"]).alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("ids"), ","), 256).alias("items_sha256"))
    words = F.coalesce(F.regexp_count("text", F.lit(r"[A-Za-z0-9\x{80}-\x{10FFFF}]+")), F.lit(0)).cast("long")
    return rows.select("row", "doc_id", words.alias("n_words")).join(united, "row", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def _clean(index):
    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([not f for f in scan(index.value, texts)[1]], pa.bool_())

    return clean


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_words: int = 5_000_000) -> DataFrame:
    """docs without the contaminated ones; all columns and their order stay.

    One scan a shard, no shuffle: each row goes or stays by its own text, whatever its doc_id. What a shard leaves is written
    before the next one reads it, so that a task holds one shard's index.
    """
    spark = common.prepare(docs.sparkSession)
    parts = shards_of(benchmark.select("item_id", F.col("text").cast("string").alias("text")), shard_words)
    for i, part in enumerate(parts):
        docs = docs.where(_clean(spark.sparkContext.broadcast(build(part.toArrow(), window)))(F.col("text").cast("string")))
        if i < len(parts) - 1:
            docs = common.staged(docs, "cleaned")
    return docs
