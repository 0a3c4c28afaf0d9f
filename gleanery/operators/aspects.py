"""Aspect detection: tokens, tags, raw labels, modifier relabelling, filters and phrases in one row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.scores import let
from gleanery.functions.text import detokenize, find_phrases, keep_alpha, tokens
from gleanery.operators.keywords import phrases
from gleanery.operators.tagging import WORD_TAGS, Tagger, default_tagger

SKIPPED_WORDS = ("am", "are", "be", "been", "being", "is", "ll", "re", "s")
SILENT_TAGS = ("DT", "CC", "EX", "MD", "PRP", "PRP$", "VBP", "WP", "WP$", "WRB")
TRIGGERS = ("IN", "TO", "RB", "JJ", "DT")
CHAINED = ("RB", "JJ")


def passes(token: Column, tag: Column) -> Column:
    """Whether a token is considered: letters left, no form of be, a word's tag."""
    bare = keep_alpha(token)
    return (bare != "") & ~bare.isin(*SKIPPED_WORDS) & tag.isin(*sorted(WORD_TAGS))


def triggers(toks: Column, tags: Column) -> Column:
    """Per token: it passes, its tag triggers, and a token follows."""
    n = F.size(toks)
    return F.transform(F.arrays_zip(toks.alias("w"), tags.alias("t")), lambda x, i: passes(x["w"], x["t"]) & x["t"].isin(*TRIGGERS) & (i + 1 < n))


def relabel(raw: Column, tags: Column, trig: Column) -> Column:
    """Labels after modifiers: a trigger is 0; its successor 1; the next too if the successor is an adjective or adverb."""
    at = lambda a, i: F.coalesce(F.get(a, i), F.lit(False))
    chained = lambda i: F.coalesce(F.get(tags, i).isin(*CHAINED), F.lit(False))
    return F.transform(raw, lambda x, i: F.when(at(trig, i), 0).when(at(trig, i - 1) | (at(trig, i - 2) & chained(i - 1)), 1).otherwise(x).cast("int"))


def aspect_words(toks: Column, tags: Column, labels: Column) -> Column:
    """Bare words of tokens that pass, are labelled 1 or 2 and whose tag isn't silent, in order."""
    zipped = F.arrays_zip(toks.alias("w"), tags.alias("t"), labels.alias("l"))
    kept = F.filter(zipped, lambda x: x["l"].isin(1, 2) & ~x["t"].isin(*SILENT_TAGS) & passes(x["w"], x["t"]))
    return F.transform(kept, lambda x: keep_alpha(x["w"]))


def found_aspects(text: Column, tagger: Tagger = default_tagger, raw: Column | None = None, extract_phrase: bool = True, most: int = 200) -> Column:
    """struct<sentence, aspect> of a text, as one expression in which each step is computed once, however often it is used
    or copied by the optimizer."""

    def expanded(words, listed):
        return F.flatten(F.transform(words, lambda w: let(find_phrases(w, listed), lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(w)))))

    def result(toks, tags, labels):
        words = aspect_words(toks, tags, labels)
        found = let(F.array_distinct(phrases(text)), lambda listed: expanded(words, listed)) if extract_phrase else words
        return F.struct(detokenize(toks).alias("sentence"), F.array_sort(F.array_distinct(found)).alias("aspect"))

    def labelled(toks, tags):
        first = F.transform(toks, lambda x: F.lit(0)) if raw is None else raw
        return let(triggers(toks, tags), lambda trig: let(relabel(first, tags, trig), lambda labels: result(toks, tags, labels)))

    return let(tokens(text, most), lambda toks: let(tagger(toks), lambda tags: labelled(toks, tags)))


def detect(df: DataFrame, text: str = "text", tagger: Tagger = default_tagger, labels: str | None = None, extract_phrase: bool = True, most: int = 200) -> DataFrame:
    """df with ``sentence`` (tokens joined) and ``aspect`` (sorted, distinct).

    ``labels``: a column of raw labels per token (0 outside, 1 begin, 2 inside), from a model; without one all are 0 and
    modifiers alone find aspects. Words become the phrases that contain them, where there are any."""
    found = found_aspects(F.coalesce(F.col(text), F.lit("")), tagger, F.col(labels) if labels else None, extract_phrase, most)
    rows = df.withColumn("found__", found)
    return rows.withColumn("sentence", F.col("found__.sentence")).withColumn("aspect", F.col("found__.aspect")).drop("found__")
