"""Aspect sentiment end to end: inputs from detected aspects, gated scores, labels and compounds, back to sentences."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.scores import ONTOLOGY, compound
from gleanery.functions.text import clean_text, cyclic_pad, whitespace_tokens
from gleanery.operators.neural import score_aspects
from gleanery.operators.relational import aspect_rows, collect_scores
from gleanery.operators.sentiment import score_overall


@dataclass(frozen=True)
class ScoringMode:
    """Where a transfer table keeps its aspects, and the kernels of the mode's network."""

    name: str
    aspect_column: str
    kernels: tuple[int, ...] = (3, 4, 5)


MODES = {m.name: m for m in (ScoringMode("aspect", "keyword"), ScoringMode("topic", "aspect"))}


class AspectScorer:
    """Scores aspects of sentences with a gated network; ``vectors``: word to vector, ``weights``: a bundle of neural.gate()."""

    def __init__(self, vectors: dict[str, np.ndarray], weights: dict[str, np.ndarray], mode: str = "aspect", classes: tuple[str, ...] = ONTOLOGY):
        if mode not in MODES:
            raise ValueError(f"no mode {mode!r}: {sorted(MODES)}")
        self.mode, self.vectors, self.weights, self.classes = MODES[mode], vectors, weights, classes

    def examples(self, transfer: DataFrame) -> DataFrame:
        """(text, aspect, sentiment) of a transfer table, its aspects where the mode keeps them."""
        return transfer.select(F.col("Response").alias("text"), F.col(self.mode.aspect_column).alias("aspect"), F.col("sentiment_name").alias("sentiment"))

    def inputs(self, df: DataFrame) -> DataFrame:
        """Rows (.., sentence, aspect, sentiment): one per aspect, short sentences repeated up to the widest kernel."""
        padded = cyclic_pad(whitespace_tokens(F.col("sentence")), max(self.mode.kernels))
        return aspect_rows(df).withColumn("sentence", F.array_join(padded, " "))

    def score(self, df: DataFrame) -> DataFrame:
        """inputs() with ``sentiment``, ``score`` (logits) and ``compound``; a sentence without aspects gives no row."""
        rows = self.inputs(df).withColumn("s__", whitespace_tokens(clean_text(F.col("sentence")))).withColumn("a__", whitespace_tokens(clean_text(F.col("aspect"))))
        rows = score_aspects(rows, "s__", "a__", self.vectors, self.weights, self.classes)
        return rows.withColumn("compound", compound(F.col("score"))).drop("s__", "a__")

    def score_sentences(self, df: DataFrame, key: str) -> DataFrame:
        """One row per sentence that has aspects: key, sentence, aspect, sentiment, score, compound as arrays."""
        return collect_scores(self.score(df), key)

    @staticmethod
    def overall(text: Column, scorers: tuple[str, ...] = ("pattern", "vader")) -> Column:
        return score_overall(text, scorers)
