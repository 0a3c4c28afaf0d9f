"""Line dedup by pairwise alignment (operator 8).

Lines are cut at line ends and at sentence ends (``. ! ?`` before white space), compared with white space normalised.
Documents that overlap are found through shared runs: of each document's lines, short ones too, the shortest runs of at
least ``block_words`` words from and to each place are hashed, and a run in more than one document pairs each later document
(larger doc_id) with the run's earliest holder. Any shared run of that many words is covered by such runs, so none is missed,
whichever documents hold its parts first. There is no cut by rarity: a run that many share makes one pair a document, never
all pairs, and so needs none. Pairs are aligned by patience diff (lines unique to both sides anchor the alignment,
recursively), and aligned runs of at least ``block_words`` words are deleted from the later document, at every place where it
holds them. So are the runs of that many words that the alignment leaves, as their lines repeat or their order differs: the
earlier side's shortest runs are indexed, and the later side's looked up among them. The earliest holder of a run keeps it.

Lines stand for themselves by 64-bit hashes until they are cut. Then the words of each run are compared by the SHA-256 of both
documents' own bytes, so that nothing is deleted because hashes collide.

Texts are read to hash, to prove (earliest holders only) and to cut, and move only where they prove or are cut; pairs move their
line hashes. An earliest holder of a third of all documents is spread over salts.

Defined cases: null text counts as empty and stays as it is (null in, null out); text without lines is left alone; a null
doc_id is neither earlier nor later, its row is left alone; rows that share a doc_id are not paired with each other, and
each is cut by what was found for any of them, if its own lines hold it. An empty table gives an empty result.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import common, textkit

RESULT = "doc_id long, n_lines long, n_dropped long, n_words_dropped long, text string"


_STOPS = np.zeros(256, bool)
_STOPS[[ord(x) for x in ".!?"]] = True


@dataclass(frozen=True)
class LineConfig:
    block_words: int = 20


@dataclass
class Lines:
    """Lines of all rows of a column, in order."""

    hashes: np.ndarray
    words: np.ndarray
    begin: np.ndarray  #: first byte, in the row
    end: np.ndarray  #: end of the last word, in the row
    rows: np.ndarray  #: n+1 offsets of the rows' lines


def lines_of(data: np.ndarray, offsets: np.ndarray) -> Lines:
    starts, ends, rows = textkit.spans(data, offsets, textkit.WHITE)
    n = len(starts)
    if not n:
        z = np.zeros(0, np.int64)
        return Lines(z.astype(np.uint64), z, z, z, np.zeros(len(offsets), np.int64))
    h = textkit.word_hashes(data, starts, ends)
    stop = _STOPS[data[ends - 1]]
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    stop[:-1] |= breaks[starts[1:]] > breaks[ends[:-1]]
    stop[rows[1:][rows[1:] > 0] - 1] = True
    last = np.flatnonzero(stop)
    first = np.concatenate([[0], last[:-1] + 1])
    up, down = textkit._power(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:n])])
    hashes = textkit.mix((total[last + 1] - total[first]) * down[first] + (last - first).astype(np.uint64))
    at = np.searchsorted(first, rows)
    base = np.repeat(offsets[:-1], np.diff(at))
    return Lines(hashes, last - first + 1, starts[first] - base, ends[last] - base, at)


def count_lines(texts: pa.Array) -> np.ndarray:
    """Number of lines of each text, without their hashes."""
    data, offsets = textkit.buffer_of(texts)
    counts = np.zeros(len(texts), np.int64)
    for a, b in textkit.chunks(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        n, word = len(part), ~textkit.WHITE[part]
        if not n:
            continue
        # a line ends in a last letter of a word that is . ! or ?, or that no other word follows before a line end
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        last = np.flatnonzero(word & np.append(~word[1:] | edge[1:-1], True))
        ends = _STOPS[part[last]]
        feeds = np.searchsorted(np.flatnonzero(part == 10), last)
        row = np.searchsorted(at, last, "right")
        ends[:-1] |= (feeds[1:] > feeds[:-1]) | (row[1:] != row[:-1])
        ends[-1:] = True
        counts[a:b] = np.diff(np.searchsorted(last[ends], at))
    return counts


def column_lines(texts: pa.Array) -> Lines:
    data, offsets = textkit.buffer_of(texts)
    parts = [lines_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in textkit.chunks(offsets)]
    if not parts:
        return lines_of(data, offsets)
    shift = np.cumsum([0] + [p.rows[-1] for p in parts])
    rows = np.concatenate([[0]] + [p.rows[1:] + s for p, s in zip(parts, shift, strict=False)])
    return Lines(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("hashes", "words", "begin", "end")), rows)


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places of two sequences, ascending in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once: dict = {}
        for side, x, lo, hi in ((0, a, a0, a1), (1, b, b0, b1)):
            for i in range(lo, hi):
                s = once.setdefault(x[i], [-1, -1])
                s[side] = i if s[side] == -1 else -2
        both = sorted((i, j) for i, j in once.values() if i >= 0 and j >= 0)
        # the longest run of anchors that ascends on both sides
        tops: list[int] = []
        piles: list[int] = []
        back = [-1] * len(both)
        for k, (_, j) in enumerate(both):
            p = bisect_left(tops, j)
            back[k] = piles[p - 1] if p else -1
            if p == len(tops):
                tops.append(j)
                piles.append(k)
            else:
                tops[p], piles[p] = j, k
        k, chain = (piles[-1] if piles else -1), []
        while k >= 0:
            chain.append(both[k])
            k = back[k]
        if not chain:
            continue
        x, y = a0, b0
        for i, j in reversed(chain):
            todo.append((x, i, y, j))
            out.append((i, j))
            x, y = i + 1, j + 1
        todo.append((x, a1, y, b1))
    return sorted(out)


def row_windows(words: np.ndarray, rows: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``windows`` of all rows of a column as (from, to, row); places count over the column, rows ascend."""
    sums = np.concatenate([[0], np.cumsum(words)])
    places, row = np.arange(len(words)), np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    j = np.searchsorted(sums, sums[:-1] + least)
    k = np.searchsorted(sums, sums[1:] - least, "right") - 1
    on, back = j <= rows[1:][row], k >= rows[:-1][row]
    size = len(sums)
    a, b = np.divmod(np.unique(np.concatenate([places[on] * size + j[on], k[back] * size + places[back] + 1])), size)
    return a, b, row[a]


def row_runs(x: Lines, least: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each of the rows' windows, each once a row, and n+1 offsets of the rows' hashes."""
    a, b, row = row_windows(x.words, x.rows, least)
    up, down = textkit._power(len(x.words) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x.hashes * up[: len(x.hashes)])])
    hashes = textkit.mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64)).view(np.int64)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.searchsorted(row[new], np.arange(len(x.rows)))


def windows(words: list[int], least: int) -> list[tuple[int, int]]:
    """Shortest runs [from, to) of at least ``least`` words: one from each place that has one, one to each place.

    Those within any run of that many words cover it: what follows the last that starts in it has less, so the one to its end covers that.
    """
    out, sums = set(), [0, *accumulate(words)]
    for i in range(len(words)):
        j = bisect_left(sums, sums[i] + least, i + 1)
        if j < len(sums):
            out.add((i, j))
        k = bisect_right(sums, sums[i + 1] - least, 0, i + 1) - 1
        if k >= 0:
            out.add((k, i + 1))
    return sorted(out)


def common_blocks(a: list, b: list, words: list[int], least: int) -> list[tuple[int, int, int]]:
    """Runs (place in a, place in b, lines) that cover every line of a within a common run of at least ``least`` words.

    First the aligned ones; what they leave (lines repeated on a side, passages in another order) is looked up among b's windows.
    """
    out, run = [], None
    for i, j in [*patience(a, b), (-1, -1)]:
        if run and (i, j) == (run[0] + run[2], run[1] + run[2]):
            run = (run[0], run[1], run[2] + 1)
            continue
        if run and sum(words[run[0] : run[0] + run[2]]) >= least:
            out.append(run)
        run = (i, j, 1)
    covered = np.zeros(len(a), bool)
    for i, _, n in out:
        covered[i : i + n] = True
    theirs = set(b)
    shared = np.array([x in theirs for x in a], bool)
    if (covered | ~shared).all():
        return out
    missing, alien = (np.concatenate([[0], np.cumsum(x)]) for x in (~covered, ~shared))
    wanted = [(i, j) for i, j in windows(words, least) if missing[j] > missing[i] and alien[j] == alien[i]]
    if wanted:
        known = dict(zip(a, words, strict=True))
        places: dict = {}
        for lo, hi in _stretches(b, known):
            for i, j in windows([known[x] for x in b[lo:hi]], least):
                places.setdefault(tuple(b[lo + i : lo + j]), lo + i)
        out += [(i, places[t], j - i) for i, j in wanted if (t := tuple(a[i:j])) in places]
    return out


def _stretches(x: list, known: dict) -> list[tuple[int, int]]:
    """Longest ranges of x that hold known lines alone."""
    edges = np.flatnonzero(np.diff([0, *(v in known for v in x), 0]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _lines(config: LineConfig):
    def run(batches):
        for b in batches:
            x = column_lines(b.column(1))
            at = pa.array(x.rows, pa.int32())
            runs, ends = row_runs(x, config.block_words)
            columns = [b.column(0), pa.ListArray.from_arrays(at, pa.array(x.hashes.view(np.int64))), pa.ListArray.from_arrays(at, pa.array(x.words, pa.int32())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(runs))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "hashes", "words", "runs"])

    return run


def _align(config: LineConfig):
    def run(batches):
        for b in batches:
            ids, later, words, earlier, holders = (b.column(i).to_pylist() for i in range(5))
            found = [(d, a, j, x[i : i + n]) for d, x, w, y, a in zip(ids, later, words, earlier, holders, strict=True) for i, j, n in common_blocks(x, y, w, config.block_words)]
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "a", "at", "block"])

    return run


def run_digest(raw: bytes, x: Lines, at: int, n: int) -> bytes:
    """SHA-256 of n lines of a text from line ``at``, white space normalised."""
    h = hashlib.sha256()
    for i in range(at, at + n):
        h.update(b" ".join(raw[x.begin[i] : x.end[i]].split()) + b"\n")
    return h.digest()


def _prove(batches):
    """Digests of the asked runs (at, n) of each earlier document, by its own bytes."""
    for b in batches:
        keys, proofs = [], []
        for a, text, asked in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            x, raw = column_lines(pa.array([text], pa.string())), text.encode()
            for s in asked:
                if s["at"] + s["n"] <= len(x.hashes):
                    keys.append(f"{a}:{s['at']}:{s['n']}")
                    proofs.append(run_digest(raw, x, s["at"], s["n"]))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(proofs, pa.binary())], ["run", "proof"])


def cut(text: str, blocks: list[dict]) -> tuple[str, int, int]:
    """The text without the lines of its blocks (runs of line hashes, and a digest of their words); its dropped lines and words."""
    x = column_lines(pa.array([text], pa.string()))
    h, raw = x.hashes.view(np.int64).tolist(), text.encode()
    drop = np.zeros(len(h), bool)
    places: dict[int, list[int]] = {}
    for i, v in enumerate(h):
        places.setdefault(v, []).append(i)
    known: dict[tuple[int, int], bytes] = {}
    for block in blocks:
        run, n = block["block"], len(block["block"])
        for i in places.get(run[0], ()):
            if h[i : i + n] == run:
                if (i, n) not in known:
                    known[i, n] = run_digest(raw, x, i, n)
                if known[i, n] == block["proof"]:
                    drop[i : i + n] = True
    kept, at = [], 0
    for i in np.flatnonzero(drop):
        kept.append(raw[at : x.begin[i]])
        at = x.begin[i + 1] if i + 1 < len(h) else len(raw)
    kept.append(raw[at:])
    return b"".join(kept).decode(), int(drop.sum()), int(x.words[drop].sum())


def line_table(docs: DataFrame, config: LineConfig = LineConfig()) -> DataFrame:
    """(doc_id, hashes, words, runs) of each row that has a doc_id and a text: of its lines, and the hashes of its shortest runs."""
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    return common.staged(rows.mapInArrow(_lines(config), "doc_id long, hashes array<long>, words array<int>, runs array<long>"), "lines")


def overlaps(table: DataFrame) -> DataFrame:
    """(a, b): each later document b with the earliest holders a of its runs."""
    rows = table.select("doc_id", F.explode("runs").alias("run"))
    shared = common.staged(rows.groupBy("run").agg(F.min("doc_id").alias("a"), F.count("*").alias("w"), F.max("doc_id").alias("z")).where("a < z").drop("z"), "shared-runs")
    bits, power = common.bitmap(shared, "run", shared.count())
    held = common.in_bitmap(rows, F.col("run"), bits, power, "maybe").where("maybe").drop("maybe")
    return common.skew_join(held, shared, "run", "w").where("doc_id > a").select("a", F.col("doc_id").alias("b")).distinct()


def blocks(docs: DataFrame, config: LineConfig = LineConfig()) -> DataFrame:
    """(doc_id, block, proof): runs of line hashes to delete from each later document, and the digest of their words in the earlier one."""
    table = line_table(docs, config)
    pairs = common.staged(overlaps(table), "overlaps")
    weigh = lambda c: common.staged(pairs.groupBy(c).agg(F.count("*").alias("w")), "weights")
    some = common.salted_join(pairs, table.select(F.col("doc_id").alias("a"), F.col("hashes").alias("ha")), "a", weigh("a"), "b")
    full = common.salted_join(some, table.select(F.col("doc_id").alias("b"), F.col("hashes").alias("hb"), "words"), "b", weigh("b"), "a")
    found = common.staged(full.select("b", "hb", "words", "ha", "a").mapInArrow(_align(config), "doc_id long, a long, at int, block array<long>"), "found")
    asked = found.select("a", "at", F.size("block").alias("n")).distinct().groupBy("a").agg(F.collect_list(F.struct("at", "n")).alias("asked"))  # runs of one document's lines
    asked = common.staged(asked.withColumnRenamed("a", "doc_id"), "asked")
    texts = common.only(docs.where("text is not null"), "doc_id", asked).join(asked.hint("merge"), "doc_id")
    proofs = common.staged(texts.select("doc_id", "text", "asked").mapInArrow(_prove, "run string, proof binary").distinct(), "proofs")
    named = found.select("doc_id", "block", F.concat_ws(":", "a", "at", F.size("block")).alias("run"))
    counts = named.groupBy("run").agg(F.count("*").alias("w"))
    return common.skew_join(named, common.staged(proofs.join(counts, "run"), "weighted-proofs"), "run", "w").select("doc_id", "block", "proof")


def dedup_lines(docs: DataFrame, config: LineConfig = LineConfig()) -> DataFrame:
    """Per row of docs: doc_id, n_lines, n_dropped, n_words_dropped, text (what is left)."""
    common.prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = blocks(docs, config).groupBy("doc_id").agg(F.collect_set(F.struct("block", "proof")).alias("blocks"))  # as many as the document has lines, at most, a partner
    found = common.staged(found, "blocks")
    bits, power = common.bitmap(found, "doc_id", found.count())
    marked = common.in_bitmap(docs, F.col("doc_id"), bits, power, "maybe")
    empty = F.array().cast(found.schema["blocks"].dataType)
    cutting = marked.where("maybe").drop("maybe").join(found.hint("merge"), "doc_id", "left")
    rows = marked.where("not maybe").select("doc_id", "text", empty.alias("blocks")).unionByName(cutting.select("doc_id", "text", F.coalesce("blocks", empty).alias("blocks")))

    def run(batches):
        for b in batches:
            counts = count_lines(b.column(1))
            dropped, words, texts, mask = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), [], np.zeros(b.num_rows, bool)
            sizes = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(sizes > 0).tolist():
                t = b.column(1)[i].as_py()
                if t:
                    t, dropped[i], words[i] = cut(t, b.column(2)[i].as_py())
                    texts.append(t)
                    mask[i] = True
            left = pc.replace_with_mask(b.column(1), pa.array(mask), pa.array(texts, b.column(1).type)) if texts else b.column(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts), pa.array(dropped), pa.array(words), left], ["doc_id", "n_lines", "n_dropped", "n_words_dropped", "text"])

    return rows.mapInArrow(run, RESULT)
