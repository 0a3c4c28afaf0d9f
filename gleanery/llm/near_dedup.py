"""Near-duplicate grouping by SuperMinHash, banding, verification and union-find (operator 10).

One pass over the texts gives each document its set size, a digest of its word sequence, the band keys of a
SuperMinHash signature and a short sketch of it. Documents with the same word sequence form a class; one of each
class goes on. Per band key, members meet the least member only (a star: linear, whatever the bucket's size).
Pairs that the set sizes or the sketch rule out are dropped, the rest are confirmed on the full sets of the whole
texts, and the links are grouped. Buckets whose members are not in one component by then are searched for the
pairs that cross components, in blocks inside the tasks, which emit only pairs that size and sketch admit; these
are confirmed in turn. So every pair that shares a band is either confirmed, ruled out, or inside one component.

Buckets of over ``REFINE`` members that hold several components (documents with a passage in common, mostly) are not
compared pair by pair but by an exact prefix filter: shingles are ordered by how often these documents hold them, rare
first (counted in a table of fixed size, any order being right), and a document of n shingles files itself
under its first n - ceil(0.75 n) + 1; two linked sets share one of these, while what many share comes last.

Sets of up to ``SMALL`` shingles, where slots depend on each other most, also file themselves under as many of their
least hashes, the same filter under another order: links among them are all found, and no sketch rules them out.

SuperMinHash: element d has, at level j, the rank j + r_j(d) for slot p_j(d), where p_0(d), p_1(d)... is a
permutation of the slots (affine over a prime number of slots, keyed by the element); a slot keeps its least rank.
All elements of a chunk go level by level; a document leaves as soon as no slot is above the next level.
With 160 slots in 40 bands of 4, a pair at the threshold of 0.75 shares no band with probability 2.5e-7, and
the sketch (2 bits a slot, at least 102 of 160 equal) rules it out with under 1e-7.

Defined cases: texts that are null or have no words have an empty set, link with nothing and stay. A null doc_id
can't be a component: its row has component_id null and stays. Rows that share a doc_id are one document, with all
links of its texts. An empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import common, textkit

RESULT = "doc_id long, n_shingles long, component_id long, kept boolean"
SLOTS = 163  # a prime
BANDS, ROWS = 40, 4
USED = BANDS * ROWS
LEAST_EQUAL = 102
PERCENT = 75
BLOCK = 2048
REFINE = 512
SMALL = 21
COUNTERS = 1 << 20
_FULL = np.uint32(0xFFFFFFFF)


def superminhash(elements: np.ndarray, offsets: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (rows x slots, uint32: level and 24 bits of rank) of the sets ``elements[offsets[i]:offsets[i+1]]``."""
    n = len(offsets) - 1
    sig = np.full(n * slots, _FULL, np.uint32)
    own = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    h = elements.astype(np.uint64)
    a = (h % np.uint64(slots)).astype(np.int64)
    b = (textkit.mix(h) % np.uint64(slots - 1)).astype(np.int64) + 1
    at = a
    for j in range(slots):
        r = (textkit.mix(h + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(40)).astype(np.uint32)
        np.minimum.at(sig, own * slots + at, r | np.uint32(j << 24))
        live = np.zeros(n, bool)
        rows = np.unique(own) if j else np.flatnonzero(np.diff(offsets))
        live[rows] = sig.reshape(n, slots)[rows].max(axis=1) >= np.uint32((j + 1) << 24)
        if not live.any():
            break
        keep = live[own]
        if not keep.all():
            h, own, at, b = h[keep], own[keep], at[keep], b[keep]
        at = at + b
        at -= slots * (at >= slots)
    return sig.reshape(n, slots)


def band_keys(sig: np.ndarray) -> np.ndarray:
    out = np.empty((len(sig), BANDS), np.uint64)
    for i in range(BANDS):
        x = np.full(len(sig), np.uint64(i + 1))
        for j in range(ROWS):
            x = textkit.mix(x * np.uint64(0x9E3779B97F4A7C15) + sig[:, i * ROWS + j])
        out[:, i] = x
    return out.view(np.int64)


def sketches(sig: np.ndarray) -> np.ndarray:
    """2 bits of each used slot, 40 bytes."""
    bits = (textkit.mix(sig[:, :USED].astype(np.uint64)) & np.uint64(3)).astype(np.uint8)
    q = bits.reshape(len(sig), USED // 4, 4)
    return q[:, :, 0] | (q[:, :, 1] << 2) | (q[:, :, 2] << 4) | (q[:, :, 3] << 6)


def admitted(n_a, n_b, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pairs that set sizes and sketches (bytes, last axis) leave possible; of small sets the sizes alone decide."""
    d = np.bitwise_xor(x, y)
    unequal = np.bitwise_count((d | (d >> 1)) & np.uint8(0x55)).sum(axis=-1, dtype=np.int64)
    least = np.minimum(n_a, n_b)
    return (100 * least >= PERCENT * np.maximum(n_a, n_b)) & ((USED - unequal >= LEAST_EQUAL) | (least <= SMALL))


def prefix_length(n):
    """How many first elements of a set of n, in any order common to all sets, meet those of every linked set."""
    return n - -(-PERCENT * n // 100) + 1


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Per range of rows of a column: its first and last row, lowered bytes, their offsets, and each row's distinct shingle hashes, ascending."""
    all_data, all_offsets = textkit.buffer_of(texts)
    for lo, hi in textkit.chunks(all_offsets, textkit.CHUNK_BYTES // 2):
        data = textkit.LOWER[all_data[all_offsets[lo] : all_offsets[hi]]]
        offsets = all_offsets[lo : hi + 1] - all_offsets[lo]
        starts, ends, rows = textkit.spans(data, offsets, textkit.WHITE)
        words = textkit.word_hashes(data, starts, ends)
        per_row = (words[rows[i] : rows[i + 1]] for i in range(hi - lo))
        yield lo, hi, data, offsets, [np.unique(textkit.shingle_hashes(w, min(2, max(1, len(w))))) if len(w) else w for w in per_row]


def describe(texts: pa.Array) -> tuple[np.ndarray, list[bytes | None], list[np.ndarray], np.ndarray]:
    """Set sizes, class digests (None for an empty set), keys (bands, and the least hashes of small sets) and sketches of whole texts."""
    n = len(texts)
    sizes, classes, keys = np.zeros(n, np.int64), [None] * n, [np.zeros(0, np.int64)] * n
    sketch = np.zeros((n, USED // 4), np.uint8)
    for lo, hi, data, offsets, sets in shingle_sets(texts):
        for i, x in enumerate(sets):
            if len(x):
                whole = b" ".join(data[offsets[i] : offsets[i + 1]].tobytes().split())
                classes[lo + i] = hashlib.blake2b(whole, digest_size=16).digest()
        at = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        sizes[lo:hi] = np.diff(at)
        sig = superminhash(np.concatenate(sets), at)
        bands, sketch[lo:hi] = band_keys(sig), sketches(sig)
        for i, x in enumerate(sets):
            if len(x):
                keys[lo + i] = np.concatenate([bands[i], textkit.mix(x[: prefix_length(len(x))]).view(np.int64)]) if len(x) <= SMALL else bands[i]
    return sizes, classes, keys, sketch


def _describe(batches):
    for b in batches:
        sizes, classes, keys, sketch = describe(b.column(1))
        at = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(keys) if keys else [], pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(classes, pa.binary()), lists, pa.array([s.tobytes() for s in sketch], pa.binary())], ["doc_id", "n", "class", "bands", "sketch"])


def _sketch_array(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), USED // 4)


def _admit(batches):
    for b in batches:
        if b.num_rows == 0:
            continue
        ok = admitted(*(b.column(i).to_numpy() for i in (2, 3)), _sketch_array(b.column(4)), _sketch_array(b.column(5)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok))


def word_set(text: str | None) -> frozenset:
    """The set of a text, of its words themselves."""
    data = (text or "").encode()
    w = data.translate(bytes(textkit.LOWER)).split()
    if len(w) < 2:
        return frozenset([tuple(w)] if w else [])
    return frozenset(zip(w, w[1:], strict=False))


def linked(x: frozenset, y: frozenset) -> bool:
    both = len(x & y)
    return both > 0 and 100 * both >= PERCENT * (len(x) + len(y) - both)


def _confirm(batches):
    last, last_set = None, frozenset()
    for b in batches:
        out = []
        for a, c, ta, tb in zip(*(b.column(i) for i in range(4)), strict=True):
            a = a.as_py()
            if a != last:
                last, last_set = a, word_set(ta.as_py())
            if linked(last_set, word_set(tb.as_py())):
                out.append((a, c.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["a", "b"])


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of node numbers whose full sets are linked; docs: (node, text). Only the pairs' texts are moved."""
    ids = common.staged(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "pair-ids")
    texts = common.staged(common.only(docs, "node", ids), "pair-texts")
    weights = common.staged(pairs.groupBy("a").agg(F.count("*").alias("w")), "pair-weights")
    other = common.staged(pairs.groupBy("b").agg(F.count("*").alias("w")), "pair-weights")
    right = common.salted_join(pairs, texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b", other, "a")
    full = common.salted_join(right, texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a", weights, "b")
    return full.select("a", "b", "ta", "tb").mapInArrow(_confirm, "a long, b long")


def _with_sketches(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) that sizes and sketches admit."""
    w = common.staged(pairs.groupBy("a").agg(F.count("*").alias("w")), "star-weights")
    b = pairs.join(sigs.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    full = common.skew_join(b, sigs.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")).join(w, "a"), "a", "w")
    return full.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_admit, "a long, b long")


def _pairs_across(rows: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (part, node, component, n, sketch, side) of different components, one from each side, in bounded pieces."""
    columns = [np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3, 5)]
    sketch = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(-1, USED // 4)
    ia, ca, na, sa = (x[columns[3] != 1] for x in (*columns[:3], sketch))
    ib, cb, nb, sb = (x[columns[3] != 0] for x in (*columns[:3], sketch))
    left, right, held = [], [], 0
    for i in range(len(ia)):
        near = np.flatnonzero((cb != ca[i]) & (100 * np.minimum(nb, na[i]) >= PERCENT * np.maximum(nb, na[i])))
        near = near[admitted(na[i], nb[near], sa[i], sb[near])]
        left.append(np.minimum(ia[i], ib[near]))
        right.append(np.maximum(ia[i], ib[near]))
        held += len(near)
        if held > 100_000 or i == len(ia) - 1:
            both = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
            yield both[:, 0], both[:, 1]
            left, right, held = [], [], 0


def _cross(batches):
    """Pairs of different components, inside one block of a bucket or between two, that size and sketch admit."""
    key, rows = None, []

    def flush():
        for a, b in _pairs_across(rows):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if row[0] != key:
                if rows:
                    yield from flush()
                key, rows = row[0], []
            rows.append(row)  # at most two blocks
    if rows:
        yield from flush()


def _links(sigs: DataFrame, docs: DataFrame) -> DataFrame:
    """Confirmed links between class representatives (node, n, bands, sketch), enough to join all that are linked."""
    keyed = sigs.select("node", F.explode("bands").alias("key"))
    shared = common.staged(keyed.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("w")).where("w > 1"), "buckets")
    n = shared.count()
    table, power = common.bitmap(shared, "key", n)
    members = common.in_bitmap(keyed, F.col("key"), table, power, "maybe").where("maybe").drop("maybe")
    stars = common.staged(common.skew_join(members, shared, "key", "w").select("key", F.col("node").alias("b"), "a", "w"), "members")
    pairs = common.staged(stars.where("a <> b").select("a", "b").distinct(), "stars")
    admitted_pairs = common.staged(_with_sketches(pairs, sigs), "admitted")
    links = common.staged(confirm(admitted_pairs, docs), "links")
    # buckets that the stars did not bring into one component
    comp = common.staged(common.components(links), "components")
    known = sigs.select("node", "n", "sketch").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = common.staged(known.join(stars.select(F.col("b").alias("node")).distinct(), "node", "left_semi"), "known")
    rows = stars.select("key", F.col("b").alias("node")).join(known.select("node", "component"), "node")
    open_ = _mixed(rows)
    if open_.isEmpty():
        return links
    placed = _blocks(_refined(open_, docs)).join(known.select("node", "n", "sketch"), "node").select("part", "node", "component", "n", "sketch", "side")
    cross = placed.repartition("part").sortWithinPartitions("part").mapInArrow(_cross, "a long, b long").distinct()
    return links.unionByName(common.staged(confirm(common.staged(cross, "cross"), docs), "links"))


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows (key, node, component) of the buckets that hold several components, with the bucket's size w."""
    mixed = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("w")).where("lo <> hi")
    return common.staged(common.skew_join(rows, common.staged(mixed.select("key", "w"), "mixed"), "key", "w"), "open")


def _refined(open_: DataFrame, docs: DataFrame) -> DataFrame:
    """open_ with the members of each bucket of over REFINE filed under their rarest shingles instead: any linked pair of them meets there."""
    big = open_.where(F.col("w") > REFINE)
    if big.isEmpty():
        return open_
    nodes = common.staged(big.select("node", "component").distinct(), "crowded")
    texts = common.staged(common.only(docs, "node", nodes), "crowded-texts")
    sums = texts.select("text").mapInArrow(_count_shingles, "i int, c long").groupBy("i").agg(F.sum("c").alias("c")).toArrow()  # COUNTERS rows at most
    counts = np.zeros(COUNTERS, np.int64)
    counts[sums.column("i").to_numpy()] = sums.column("c").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def file(batches):
        for b in batches:
            nodes, keys = [], []
            for node, h in zip(b.column(0).to_pylist(), (x for *_, sets in shingle_sets(b.column(1)) for x in sets), strict=True):
                seen = shared.value[(h & np.uint64(COUNTERS - 1)).astype(np.int64)]
                first = np.lexsort((h, seen))[: prefix_length(len(h))]
                first = first[seen[first] > 1]  # what one text alone holds meets nothing
                keys.append(h[first].view(np.int64))
                nodes.append(np.full(len(first), node, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (keys, nodes)], ["key", "node"])

    filed = texts.select("node", "text").mapInArrow(file, "key long, node long").join(nodes, "node").select("key", "node", "component")
    return open_.where(F.col("w") <= REFINE).unionByName(_mixed(common.staged(filed, "filed")).select(open_.columns))


def _count_shingles(batches):
    """How often hashes fall on each counter, over a task's texts; a text counts each of its shingles once."""
    counts = np.zeros(COUNTERS, np.int64)
    for b in batches:
        for *_, sets in shingle_sets(b.column(0)):
            for x in sets:
                np.add.at(counts, (x & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
    i = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(counts[i])], ["i", "c"])


def _blocks(rows: DataFrame) -> DataFrame:
    """(part, node, component, side): a block of a bucket meets itself (side 2) and every other block (sides 0 and 1)."""
    placed = rows.withColumn("blocks", F.ceil(F.col("w") / BLOCK).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    return placed.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("part"), "node", "component", side.alias("side"))


def group(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept."""
    common.prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sigs = common.staged(docs.mapInArrow(_describe, "doc_id long, n long, class binary, bands array<long>, sketch binary"), "signatures")
    named = sigs.where("class is not null and doc_id is not null")
    classes = common.staged(named.groupBy("class").agg(F.min("doc_id").alias("node"), F.count("*").alias("w")), "classes")
    first = named.join(classes.select("class", F.col("node").alias("doc_id")), ["class", "doc_id"], "left_semi").dropDuplicates(["class"])
    reps = common.staged(first.select(F.col("doc_id").alias("node"), "n", "bands", "sketch"), "representatives")
    links = _links(reps, docs.withColumnRenamed("doc_id", "node").where("node is not null"))
    # a doc_id that stands for several texts links their classes
    several = named.groupBy("doc_id").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("doc_id")
    same = named.select("doc_id", "class").join(several, "doc_id", "left_semi").join(classes, "class").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    comp = common.staged(common.components(links.unionByName(same)), "components")
    of_class = common.staged(classes.join(comp, "node", "left").select("class", F.coalesce("component", "node").alias("component_id"), "w"), "class-components")
    out = common.skew_join(named.select("doc_id", "n", "class"), of_class, "class", "w").select("doc_id", "n", "component_id")
    rest = sigs.where("class is null or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = out.unionByName(rest)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of linked texts; all columns stay.

    The row with the least doc_id stays; where ids repeat or are null, rows count alone, each by its own text, and one of the
    rows with the least doc_id stays, null being largest. Rows without words are linked with nothing and stay.
    """
    keyed, key = common.with_row_key(docs)
    if key == "doc_id":
        gone = group(keyed.select("doc_id", "text")).where("not kept").select("doc_id")
    else:
        grouped = common.staged(group(keyed.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), "component_id"), "groups")
        by = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), F.col(key).alias("row")).alias("by")
        named = common.staged(keyed.select(key, by).join(grouped, key), "groups")
        first = named.groupBy("component_id").agg(F.min("by").alias("first"), F.count("*").alias("w")).where("w > 1")
        gone = common.skew_join(named, common.staged(first, "firsts"), "component_id", "w").where("by.row <> first.row").select(key)
    kept = common.without(keyed, key, common.staged(gone, "near-copies"))
    return kept if key == "doc_id" else kept.drop(key)
