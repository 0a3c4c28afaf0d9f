"""Toxicity (operator 1): a convolutional text classifier, trained in numpy.

A word's vector is the sum of three hashed embeddings: of the word and of its first 6 and 8 bytes. Filters of
widths 1, 2 and 3 slide over the words, the largest activation of each over the whole text is kept (max pooling), and
a logistic unit weighs them. As the filters are linear before pooling, scoring looks up, per word, what it adds to each
filter, so a text costs a few table rows a word. The score is calibrated (Platt) on a part of the training sample
set aside, re-weighted to the labels' own frequencies. ``thresholds`` holds, by language, the score that does best
there (F1); ``flag`` applies them. Labels, lang, source and doc_id are never inputs of a score.

It learns on the driver from a bounded sample: at most about ``per_class`` labelled documents a class and ``sample_bytes`` of
text in all, whole texts, taken in the order of a hash of doc_id as long as they fit, so reruns agree.

Defined cases: null, empty and wordless texts get the score of an empty text. Rows whose label is null, or contested
for the same doc_id, teach with what they say. With no or one-sided labels the score is the share of toxic labels (0 if
none). A null doc_id hashes as an empty id. Columns other than those named are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import common, textkit
from gleanery.llm.langid import held_out

WIDTHS = (1, 2, 3)
PREFIXES = (6, 8)
FLOOR = -1e9


@dataclass(frozen=True)
class ToxicConfig:
    buckets: int = 1 << 16
    size: int = 12  #: of a word's vector
    filters: int = 6  #: of each width
    per_class: int = 6000
    sample_bytes: int = 64 << 20  #: half of it for each class
    epochs: int = 12
    batch: int = 64
    rate: float = 0.05
    seed: int = 7


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(words x 3) buckets and the rows' offsets; words are runs of letters, digits and non-ASCII."""
    data = textkit.LOWER[data]
    starts, ends, rows = textkit.spans(data, offsets, textkit.SYMBOL)
    out = np.empty((len(starts), 1 + len(PREFIXES)), np.int32)
    mask = np.uint64(buckets - 1)
    out[:, 0] = textkit.word_hashes(data, starts, ends) & mask
    for j, n in enumerate(PREFIXES):
        h = textkit.word_hashes(data, starts, np.minimum(starts + n, ends))
        out[:, j + 1] = textkit.mix(h + np.uint64(j + 1)) & mask
    return out, rows


@dataclass
class ToxicModel:
    table: np.ndarray | None  #: buckets x (sum of widths x filters): what a word adds to each filter at each place
    bias: np.ndarray
    out: np.ndarray
    scale: tuple[float, float]  #: calibration
    constant: float = 0.0  #: the score without a table
    thresholds: dict[str, float] = field(default_factory=dict)

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.table is None:
            return np.full(len(texts), self.constant)
        data, offsets = textkit.buffer_of(texts)
        z = np.empty(len(texts))
        for a, b in textkit.chunks(offsets, textkit.CHUNK_BYTES // 2):
            f, rows = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], len(self.table))
            z[a:b] = pooled(self.table, f, rows, self.bias)[0] @ self.out[:-1] + self.out[-1]
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * z + self.scale[1], -50, 50)))


def pooled(table: np.ndarray, f: np.ndarray, rows: np.ndarray, bias: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Pooled activations (rows x filters; 0 for a text shorter than the filter) and, if asked, the word where each filter is largest (-1: none)."""
    n, k = len(rows) - 1, len(bias) // len(WIDTHS)
    g = table[f[:, 0]]
    for j in range(1, f.shape[1]):
        g += table[f[:, j]]
    out = np.zeros((n, len(bias)), np.float32)
    best = np.full((n, len(bias)), -1, np.int64) if where else None
    column = 0
    for i, w in enumerate(WIDTHS):
        m = len(g) - w + 1
        counts = np.diff(rows) - w + 1
        some = np.flatnonzero(counts > 0)
        if m > 0 and len(some):
            z = g[:m, column : column + k].copy()
            for j in range(1, w):
                z += g[j : m + j, column + j * k : column + (j + 1) * k]
            for back in range(1, w):  # no window over a text's end
                cut = rows[1:] - back
                z[cut[(cut >= 0) & (cut < m)]] = FLOOR
            top = np.maximum.reduceat(z, rows[some], axis=0)
            out[some, i * k : (i + 1) * k] = top + bias[i * k : (i + 1) * k]
            if where:
                for r, t in zip(some, top, strict=True):
                    part = z[rows[r] : rows[r] + counts[r]]
                    best[r, i * k : (i + 1) * k] = rows[r] + part.argmax(axis=0)
        column += w * k
    return out, best


def fit(texts: pa.Array, labels: np.ndarray, langs: list[str | None], weights: tuple[float, float], config: ToxicConfig) -> ToxicModel:
    """Trains on texts; ``weights``: how many labelled rows a row of class 0 and of class 1 stands for."""
    rng = np.random.default_rng(config.seed)
    data, offsets = textkit.buffer_of(texts)
    parts = [features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], config.buckets) for a, b in textkit.chunks(offsets)]
    f = np.concatenate([p[0] for p in parts])
    rows = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))])
    del parts, data, offsets
    n, k, d, total = len(labels), config.filters, config.size, sum(WIDTHS)
    emb = (rng.standard_normal((config.buckets, d)) * 0.1).astype(np.float32)
    conv = (rng.standard_normal((d, total * k)) * 0.3).astype(np.float32)
    bias = np.zeros(len(WIDTHS) * k, np.float32)
    out = np.append(rng.random(len(bias)) * 0.5 + 0.1, -1.0).astype(np.float32)
    state = [np.full(x.shape, 1e-3, np.float32) for x in (emb, conv, bias, out)]
    order = rng.permutation(n)
    kept, train = order[: n // 6], order[n // 6 :]
    y = labels.astype(np.float32)

    def step(x, s, grad):
        s += grad * grad
        x -= config.rate * grad / np.sqrt(s)

    for _ in range(config.epochs):
        rng.shuffle(train)
        for at in range(0, len(train), config.batch):
            ids = train[at : at + config.batch]
            sizes = rows[ids + 1] - rows[ids]
            own = np.concatenate([[0], np.cumsum(sizes)])
            words = np.repeat(rows[ids] - own[:-1], sizes) + np.arange(own[-1])
            fb = f[words]
            used, inverse = np.unique(fb, return_inverse=True)
            act, best = pooled(emb[used] @ conv, inverse.reshape(fb.shape), own, bias, where=True)
            p = 1 / (1 + np.exp(-np.clip(act @ out[:-1] + out[-1], -30, 30)))
            err = ((p - y[ids]) / len(ids)).astype(np.float32)
            g_act = err[:, None] * out[:-1][None, :] * (best >= 0)
            g_out = np.append(err @ act, err.sum()).astype(np.float32)
            g_emb, g_conv = np.zeros((len(used), d), np.float32), np.zeros_like(conv)
            column = 0
            for i, w in enumerate(WIDTHS):
                r, q = np.nonzero((best[:, i * k : (i + 1) * k] >= 0) & (g_act[:, i * k : (i + 1) * k] != 0))
                g, start = g_act[r, i * k + q], best[r, i * k + q]
                for j in range(w):
                    c = column + j * k + q
                    feats = inverse.reshape(fb.shape)[start + j]
                    x = emb[used[feats]].sum(axis=1)
                    np.add.at(g_conv.T, c, g[:, None] * x)
                    for m in range(feats.shape[1]):
                        np.add.at(g_emb, feats[:, m], g[:, None] * conv[:, c].T)
                column += w * k
            s = state[0][used] + g_emb * g_emb
            state[0][used] = s
            emb[used] -= config.rate * g_emb / np.sqrt(s)
            step(conv, state[1], g_conv)
            step(bias, state[2], g_act.sum(axis=0))
            step(out, state[3], g_out)
            np.maximum(out[:-1], 0, out=out[:-1])  # filters speak for toxicity only
    model = ToxicModel(emb @ conv, bias, out, (1.0, 0.0))
    if len(kept):
        _calibrate(model, texts.take(pa.array(kept)), y[kept], [langs[i] for i in kept], weights)
    return model


def _calibrate(model: ToxicModel, texts: pa.Array, y: np.ndarray, langs: list[str | None], weights: tuple[float, float]) -> None:
    p = model.score(texts)
    z = np.log(np.clip(p, 1e-12, 1) / np.clip(1 - p, 1e-12, 1))
    w = np.where(y > 0, weights[1], weights[0])
    w /= w.sum()
    a, b = 1.0, 0.0
    for _ in range(200):  # Newton's method, damped
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, h = w * (q - y), w * q * (1 - q)
        ga, gb = (g * z).sum() + 1e-3 * (a - 1), g.sum() + 1e-4 * b
        haa, hab, hbb = (h * z * z).sum() + 1e-3, (h * z).sum(), h.sum() + 1e-4
        det = haa * hbb - hab * hab
        a, b = a - 0.5 * (hbb * ga - hab * gb) / det, b - 0.5 * (haa * gb - hab * ga) / det
    model.scale = (float(max(a, 0.05)), float(b))
    p = model.score(texts)
    for lang in sorted({x for x in langs if x is not None}):
        mine = np.array([x == lang for x in langs])
        best = max(((2 * (w[mine & (p >= t)] * y[mine & (p >= t)]).sum() / max(1e-12, w[mine & (p >= t)].sum() + (w[mine] * y[mine]).sum()), -abs(t - 0.7), t) for t in np.linspace(0.05, 0.95, 19)), default=(0, 0, 0.7))
        model.thresholds[lang] = float(best[2])


def train(docs: DataFrame, labels: DataFrame, config: ToxicConfig = ToxicConfig()) -> ToxicModel:
    """Learns from docs (doc_id, text, lang) and labels (doc_id, toxic)."""
    docs = docs.select("doc_id", "text", "lang")
    said = labels.where("doc_id is not null and toxic is not null").select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in said.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if not n0 or not n1:
        return ToxicModel(None, np.zeros(0), np.zeros(0), (1.0, 0.0), 1.0 if n1 else 0.0)
    share = F.when(F.col("toxic") == 1, min(1.0, config.per_class / n1)).otherwise(min(1.0, config.per_class / n0))
    chosen = common.staged(said.where((F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) / (1 << 30)) < share), "toxic-sample")
    drawn = common.only(docs.where("doc_id is not null"), "doc_id", chosen).join(chosen, "doc_id").select("doc_id", "text", "lang", "toxic")
    drawn = common.staged(drawn, "toxic-texts")
    sizes = drawn.groupBy("doc_id", "toxic").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size")).withColumn("turn", F.xxhash64("doc_id", F.lit(3)))
    wanted, room = [], {0: config.sample_bytes // 2, 1: config.sample_bytes // 2}
    for r in sorted(sizes.collect(), key=lambda r: (r["turn"], r["doc_id"])):  # a row for each of the chosen labels, whose number is bounded
        if r["size"] <= room[r["toxic"]]:
            room[r["toxic"]] -= r["size"]
            wanted.append((r["doc_id"], r["toxic"]))
    taken = F.broadcast(docs.sparkSession.createDataFrame(wanted, "doc_id long, toxic int"))
    found = drawn.join(taken, ["doc_id", "toxic"], "left_semi").toArrow()
    found = found.sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    y = found.column("toxic").to_numpy()
    if not 0 < y.sum() < len(y):
        return ToxicModel(None, np.zeros(0), np.zeros(0), (1.0, 0.0), n1 / (n0 + n1))
    return fit(found.column("text").combine_chunks(), y, found.column("lang").to_pylist(), (n0 / (y == 0).sum(), n1 / y.sum()), config)


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """docs (doc_id, held_out, text): doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            s = shared.value.score(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.7).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def predict(docs: DataFrame, labels: DataFrame, config: ToxicConfig = ToxicConfig()) -> DataFrame:
    """Learns from the labels that aren't held out (crc32 of doc_id, mod 3, is 1) and scores all documents."""
    common.prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id"), 3, 1).alias("held_out"), F.col("text").cast("string"), F.col("lang").cast("string"))
    said = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where(~held_out(F.col("doc_id"), 3, 1))
    return score(rows.select("doc_id", "held_out", "text"), train(rows, said, config))


def flag(scored: DataFrame, model: ToxicModel, lang: str = "lang", default: float = 0.7) -> DataFrame:
    """Adds boolean ``toxic_by_lang``: score against the threshold of the row's language (``default`` for others and null)."""
    cut = F.lit(default)
    for name, t in sorted(model.thresholds.items()):
        cut = F.when(F.col(lang).eqNullSafe(F.lit(name)), t).otherwise(cut)
    return scored.withColumn("toxic_by_lang", F.col("score") >= cut)
