"""Forward passes of the taggers and the aspect sentiment networks in numpy; weights come in ``.npz`` bundles.

No trained weights are shipped: ``random_tagger`` and ``random_gate`` make seeded ones for tests and shapes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.scores import ONTOLOGY, argmax_label

TAGS = 45
#: Padded tokens that go through a tagger at once.
PADDED_TOKENS = 128 * 256


def conv1d(x: np.ndarray, weight: np.ndarray, bias: np.ndarray, pad: int = 0) -> np.ndarray:
    """(.., length, in) to (.., length', out); weight: (width, in, out)."""
    x = np.pad(x, [(0, 0)] * (x.ndim - 2) + [(pad, pad), (0, 0)])
    n = x.shape[-2] - len(weight) + 1
    return sum(x[..., j : j + n, :] @ weight[j] for j in range(len(weight))) + bias


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


def tag_rows(general: np.ndarray, domain: np.ndarray, tags: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Logits (.., length, classes) of padded sentences; tags 1..45 as flags, 0 as none."""
    x = np.concatenate([general, domain], axis=-1)
    h = relu(np.concatenate([conv1d(x, w["c1"], w["c1b"], 2), conv1d(x, w["c2"], w["c2b"], 1)], axis=-1))
    for name in ("c3", "c4", "c5"):
        h = relu(conv1d(h, w[name], w[name + "b"], 2))
    flags = np.eye(TAGS + 1)[tags][..., 1:]
    h = relu(np.concatenate([h, flags, domain], axis=-1) @ w["l1"] + w["l1b"])
    return h @ w["l2"] + w["l2b"]


def labels_of(logits: np.ndarray, axis: str = "position") -> np.ndarray:
    """Class per token. ``position`` normalises each class over the padded positions first, as the older scorer did; ``class`` doesn't."""
    if axis == "position":
        top = logits.max(axis=-2, keepdims=True)
        logits = logits - (top + np.log(np.exp(logits - top).sum(axis=-2, keepdims=True)))
    return logits.argmax(axis=-1)


def viterbi(logits: np.ndarray, transition: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[int]:
    """The best path of a linear-chain model."""
    score, back = start + logits[0], []
    for row in logits[1:]:
        step = score[:, None] + transition
        back.append(step.argmax(axis=0))
        score = step.max(axis=0) + row
    path = [int((score + end).argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def random_tagger(general: int = 300, domain: int = 100, classes: int = 3, seed: int = 0, filters: int = 128) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    f = lambda *s: rng.standard_normal(s) / np.sqrt(np.prod(s[:-1]))
    d, h = general + domain, 2 * filters
    w = {"c1": f(5, d, filters), "c2": f(3, d, filters), "c3": f(5, h, h), "c4": f(5, h, h), "c5": f(5, h, h), "l1": f(h + TAGS + domain, 50), "l2": f(50, classes)}
    return w | {k + "b": np.zeros(v.shape[-1]) for k, v in w.items()}


def padded_width(df: DataFrame, toks: str, least: int = 130) -> int:
    """The width all sentences are padded to: one number over the corpus."""
    return max(least, df.agg(F.coalesce(F.max(F.size(toks)), F.lit(0))).first()[0])


class Lookup:
    """Words to rows of a matrix; unknown words have the last row, zeros."""

    def __init__(self, table: dict[str, np.ndarray]):
        self.at = {w: i for i, w in enumerate(table)}
        rows = [np.asarray(v, float) for v in table.values()]
        self.rows = np.array([*rows, np.zeros(len(rows[0]) if rows else 1)])

    def ids(self, words) -> np.ndarray:
        return np.array([self.at.get(w, len(self.rows) - 1) for w in words], np.int64)


def infer_labels(df: DataFrame, key: str, toks: str, tag_ids: str, general: dict[str, np.ndarray], domain: dict[str, np.ndarray], weights: dict[str, np.ndarray], width: int, axis: str = "position", crf: dict[str, np.ndarray] | None = None, batch: int = 128) -> DataFrame:
    """(key, labels): labels per token of rows (key, toks, tag_ids). Unknown words have zero vectors.

    Arrow batches, weights broadcast; ``batch`` sentences, fewer of great width, become lists and go through the network at a time, padded to
    one width: besides the Arrow batch a task holds no more than these."""
    sc = df.sparkSession.sparkContext
    shared = sc.broadcast((Lookup(general), Lookup(domain), weights, crf))

    def label(sentences: list, tags: list) -> list[list[int]]:
        g, d, w, c = shared.value
        sizes = [len(x) for x in sentences]
        shape = (len(sentences), max(width, *sizes))
        row, col = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes])
        flat = [x for s in sentences for x in s]
        ids = []
        for table in (g, d):
            at = np.full(shape, len(table.rows) - 1)
            at[row, col] = table.ids(flat)
            ids.append(table.rows[at])
        t = np.zeros(shape, np.int64)
        t[row, col] = [0 if x is None or x != x else int(x) for s in tags for x in s]
        z = tag_rows(*ids, t, w)
        if c:
            return [viterbi(z[i, :n], c["transition"], c["start"], c["end"]) for i, n in enumerate(sizes)]
        return [x[:n].tolist() for x, n in zip(labels_of(z, axis), sizes, strict=True)]

    most = max(1, min(batch, PADDED_TOKENS // max(1, width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, most) for whole in batches for at in range(0, whole.num_rows, most)):
            sentences, tags = ([x or [] for x in b.column(i).to_pylist()] for i in (1, 2))
            out: list[list[int]] = [[] for _ in sentences]
            groups = [[i for i, s in enumerate(sentences) if 0 < len(s) <= width]] + [[i] for i, s in enumerate(sentences) if len(s) > width]
            for group in filter(None, groups):
                for i, labels in zip(group, label([sentences[i] for i in group], [tags[i] for i in group]), strict=True):
                    out[i] = labels
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], [key, "labels"])

    schema = T.StructType([df.schema[key], T.StructField("labels", T.ArrayType(T.IntegerType()))])
    return df.select(key, toks, tag_ids).mapInArrow(run, schema)


def best_paths(logits: Column, crf: dict[str, np.ndarray]) -> Column:
    """Labels of an array of logits (position, class) by a linear-chain model; null and empty stay so."""

    @F.pandas_udf("array<int>")
    def paths(rows: pd.Series) -> pd.Series:
        return rows.map(lambda z: None if z is None else viterbi(np.array(list(z), float), crf["transition"], crf["start"], crf["end"]) if len(z) else [])

    return paths(logits)


def position_labels(logits: Column, axis: str = "position") -> Column:
    """labels_of() of an array of logits (position, class)."""

    @F.pandas_udf("array<int>")
    def labels(rows: pd.Series) -> pd.Series:
        return rows.map(lambda z: None if z is None else labels_of(np.array(list(z), float), axis).tolist() if len(z) else [])

    return labels(logits)


def kernels_of(w: dict[str, np.ndarray]) -> list[int]:
    return sorted(int(n[1:]) for n in w if n[0] == "x" and n[1:].isdigit())


def sentence_maps(sentence: np.ndarray, w: dict[str, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """What a sentence (length, dim) adds whatever the aspect, by kernel: tanh features, and gates before the aspect."""
    return [(np.tanh(conv1d(sentence, w[f"x{k}"], w[f"x{k}b"])), conv1d(sentence, w[f"y{k}"], w[f"y{k}b"])) for k in kernels_of(w)]


def gate_maps(maps: list[tuple[np.ndarray, np.ndarray]], aspect: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Logits for an aspect (words, dim): it is averaged, or, where the bundle has ``a3``, convolved and max-pooled."""
    v = relu(conv1d(aspect, w["a3"], w["a3b"], 1)).max(axis=0) if "a3" in w else aspect.mean(axis=0)
    v = v @ w["fa"] + w["fab"]
    return np.concatenate([(x * relu(y + v)).max(axis=0) for x, y in maps]) @ w["fc"] + w["fcb"]


def gate(sentence: np.ndarray, aspect: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Logits of a sentence for an aspect: gated convolutions."""
    return gate_maps(sentence_maps(sentence, w), aspect, w)


def random_gate(dim: int = 300, aspect_dim: int = 300, classes: int = 3, maps: int = 100, kernels: tuple[int, ...] = (3, 4, 5), target: bool = False, seed: int = 0) -> dict[str, np.ndarray]:
    """Seeded weights; ``target``: the variant that convolves the aspect phrase."""
    rng = np.random.default_rng(seed)
    f = lambda *s: rng.standard_normal(s) / np.sqrt(np.prod(s[:-1]))
    w = {f"{n}{k}": f(k, dim, maps) for k in kernels for n in "xy"} | {"fc": f(len(kernels) * maps, classes), "fa": f(maps if target else aspect_dim, maps)}
    if target:
        w["a3"] = f(3, aspect_dim, maps)
    return w | {k + "b": np.zeros(v.shape[-1]) for k, v in w.items()}


def score_aspects(rows: DataFrame, toks: str, aspect_toks: str, vectors: dict[str, np.ndarray], weights: dict[str, np.ndarray], classes: tuple[str, ...] = ONTOLOGY) -> DataFrame:
    """rows with ``score`` (logits in the order negative, neutral, positive) and ``sentiment``. Sentences shorter than the widest kernel give null.

    A sentence's convolutions are computed once for the aspects that follow each other."""
    shared = rows.sparkSession.sparkContext.broadcast((vectors, weights))
    order, widest = [classes.index(x) for x in ONTOLOGY], max(kernels_of(weights))

    @F.pandas_udf("array<double>")
    def logits(sentence: pd.Series, aspect: pd.Series) -> pd.Series:
        table, w = shared.value
        zero = np.zeros(len(next(iter(table.values()))))
        look = lambda ws: np.array([table.get(x, zero) for x in ws])
        out, last, maps = [], None, []
        for s, a in zip(sentence, aspect, strict=True):
            if s is None or a is None or len(s) < widest or not len(a):
                out.append(None)
                continue
            if (now := tuple(s)) != last:
                last, maps = now, sentence_maps(look(s), w)
            out.append(gate_maps(maps, look(a), w)[order].tolist())
        return pd.Series(out)

    return rows.withColumn("score", logits(F.col(toks), F.col(aspect_toks))).withColumn("sentiment", argmax_label(F.col("score")))


def save_bundle(path: str, weights: dict[str, np.ndarray]) -> None:
    np.savez(path, **weights)


def load_bundle(path: str) -> dict[str, np.ndarray]:
    with np.load(path, allow_pickle=False) as z:
        return {k: z[k] for k in z.files}
