"""Text functions: Column in, Column out, no Python in the row path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.scores import let

#: What clean_text separates after its first substitution; the last three keep a backslash in compat mode.
_CONTRACTIONS = ("'s", "'ve", "n't", "'re", "'d", "'ll")
_PLAIN = (",", "!")
_GUARDED = ("(", ")", "?")

#: (pattern, replacement) steps of the tokenizer; the replacement in Java's notation.
TOKEN_STEPS = (
    (r"([,;:@#$%&?!\"()\[\]{}<>|*])", " $1 "),
    (r"\.\.\.", " ... "),
    (r"([^.\s])\.(\s|$)", "$1 . $2"),
    (r"(?i)([a-z])(n't)\b", "$1 $2"),
    (r"(?i)'(s|m|d|ll|re|ve)\b", " '$1"),
)


def clean_text(c: Column, compat: bool = True) -> Column:
    """Letters, digits and ``(),!?'`` and the back-quote stay; contractions and marks are set apart, spaces collapse.

    compat keeps a backslash before ``(``, ``)`` and ``?``, as users of the older cleaner expect; without it they stand plain."""
    x = F.regexp_replace(c, "[^`'!?,()0-9A-Za-z]", " ")
    for s in _CONTRACTIONS:
        x = F.replace(x, F.lit(s), F.lit(" " + s))
    for s in _PLAIN + _GUARDED:
        x = F.replace(x, F.lit(s), F.lit(f" \\{s} " if compat and s in _GUARDED else f" {s} "))
    return F.trim(F.regexp_replace(x, r"\s{2,}", " "))


def keep_alpha(c: Column) -> Column:
    """Drops all but ASCII letters, space and slash, then trailing spaces."""
    return F.rtrim(F.regexp_replace(c, "[^ /A-Za-z]+", ""))


def keep_alphanumeric(c: Column, slash: bool = False) -> Column:
    """Runs of anything but letters, digits, full stop, apostrophe, space (and slash) become one space."""
    return F.regexp_replace(c, "[^ './0-9A-Za-z]+" if slash else "[^ '.0-9A-Za-z]+", " ")


def text_md5(c: Column) -> Column:
    return F.md5(F.encode(c, "UTF-8"))


def whitespace_tokens(c: Column) -> Column:
    """Words between white space; no empty ones."""
    return F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")


def tokens(c: Column, most: int | None = 200) -> Column:
    """Treebank-like word tokens, at most ``most`` of them (None: all)."""
    x = c
    for pattern, into in TOKEN_STEPS:
        x = F.regexp_replace(x, pattern, into)
    out = whitespace_tokens(x)
    return out if most is None else F.slice(out, 1, most)


def sentences(c: Column) -> Column:
    """Sentences: cut after . ! ? before white space."""
    return F.filter(F.split(F.trim(c), r"(?<=[.!?])\s+"), lambda x: x != "")


def detokenize(toks: Column) -> Column:
    return F.array_join(toks, " ")


def find_phrases(word: Column, phrases: Column) -> Column:
    """Phrases that contain the word, whatever the case."""
    return F.filter(phrases, lambda p: F.lower(p).contains(F.lower(word)))


def cyclic_pad(toks: Column, kernel: int = 5, below: int = 6) -> Column:
    """Token lists shorter than ``below`` are repeated up to ``kernel`` tokens; empty lists give null."""

    def pad(t):
        need = F.ceil(F.lit(kernel) / F.greatest(F.size(t), F.lit(1))).cast("int")
        padded = F.slice(F.flatten(F.array_repeat(t, F.greatest(need, F.lit(1)))), F.lit(1), F.greatest(F.lit(kernel), F.size(t)))
        return F.when(F.size(t) == 0, None).when(F.size(t) < below, padded).otherwise(t)

    return let(toks, pad)


def first_word(c: Column) -> Column:
    return F.get(whitespace_tokens(c), F.lit(0))


def topic_label(topic: Column, words: Column) -> Column:
    return F.concat(topic, F.lit(" - "), F.array_join(words, " "))


def token_count(toks: Column) -> Column:
    return F.size(toks)


def sentiment_name(code: Column) -> Column:
    """-1, 0, 1 as negative, neutral, positive; null else."""
    return F.element_at(F.create_map(*[F.lit(x) for x in (-1, "negative", 0, "neutral", 1, "positive")]), code.cast("int"))


def entity_attribute(c: Column) -> Column:
    """``entity#attribute`` as a struct."""
    parts = F.split(c, "#")
    return F.struct(F.get(parts, F.lit(0)).alias("entity"), F.get(parts, F.lit(1)).alias("attribute"))


def highlight(toks: Column, marked: Column) -> Column:
    """Tokens joined by spaces, those whose flag is true in green (ANSI)."""
    return F.array_join(F.zip_with(toks, marked, lambda t, m: F.when(m, F.concat(F.lit("\x1b[6;30;42m"), t, F.lit("\x1b[0m"))).otherwise(t)), " ")
