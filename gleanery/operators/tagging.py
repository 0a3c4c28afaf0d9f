"""Part-of-speech tags by a lexicon and suffix rules: a default, labelled as such, for any Column -> Column tagger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Tagger = Callable[[Column], Column]

NOUNS, VERBS = ("NN", "NNS", "NNP", "NNPS"), ("VB", "VBD", "VBG", "VBN", "VBP", "VBZ")
ADJECTIVES, ADVERBS = ("JJ", "JJR", "JJS"), ("RB", "RBR", "RBS")
WH, PRONOUNS = ("WP", "WP$", "WDT", "WRB"), ("PRP", "PRP$")
SMALL = ("TO", "IN", "DT", "CC", "CD", "EX", "FW", "LS", "MD", "PDT", "POS", "RP", "SYM", "UH")
WORD_TAGS = frozenset(NOUNS + VERBS + ADJECTIVES + ADVERBS + WH + PRONOUNS + SMALL)
MARK_TAGS = frozenset(("``", "''", "#", "$", ",", ".", ":", "(", ")"))
TAG_IDS = {t: i + 1 for i, t in enumerate(sorted(WORD_TAGS | MARK_TAGS))}

#: First rule that fits gives the tag: (test, values, tag); tests are on the lower-cased token but for "mark".
RULES: tuple[tuple[str, tuple[str, ...], str], ...] = (
    ("mark", (",",), ","),
    ("mark", (".", "!", "?"), "."),
    ("mark", (":", ";", "...", "-", "--"), ":"),
    ("mark", ("(", "[", "{"), "("),
    ("mark", (")", "]", "}"), ")"),
    ("mark", ("$",), "$"),
    ("mark", ("#",), "#"),
    ("mark", ('"', "``"), "``"),
    ("mark", ("''", "'"), "''"),
    ("word", ("the", "a", "an", "this", "that", "these", "those", "each", "every", "some", "any", "no"), "DT"),
    ("word", ("to",), "TO"),
    ("word", ("in", "on", "at", "by", "of", "for", "with", "from", "as", "into", "over", "under", "after", "before", "if", "because", "than"), "IN"),
    ("word", ("and", "or", "but", "nor"), "CC"),
    ("word", ("i", "you", "he", "she", "it", "we", "they", "me", "him", "us", "them"), "PRP"),
    ("word", ("my", "your", "his", "her", "its", "our", "their"), "PRP$"),
    ("word", ("can", "could", "may", "might", "must", "shall", "should", "will", "would", "'ll", "'d"), "MD"),
    ("word", ("who", "whom", "what"), "WP"),
    ("word", ("whose",), "WP$"),
    ("word", ("which",), "WDT"),
    ("word", ("when", "where", "why", "how"), "WRB"),
    ("word", ("there",), "EX"),
    ("word", ("is", "has", "does"), "VBZ"),
    ("word", ("are", "am", "have", "do", "'re", "'ve", "'m"), "VBP"),
    ("word", ("was", "were", "had", "did"), "VBD"),
    ("word", ("be",), "VB"),
    ("word", ("been",), "VBN"),
    ("word", ("'s",), "POS"),
    ("word", ("not", "n't", "very", "too", "so", "just", "also", "never", "always", "really", "quite"), "RB"),
    ("word", ("good", "bad", "great", "nice", "poor", "slow", "fast", "easy", "hard", "new", "old", "big", "small", "best", "clean", "clear"), "JJ"),
    ("digit", (), "CD"),
    ("suffix", ("ly",), "RB"),
    ("suffix", ("ing",), "VBG"),
    ("suffix", ("ed",), "VBD"),
    ("suffix", ("ous", "ful", "ive", "able", "ible", "ish", "less", "ic", "al"), "JJ"),
    ("suffix", ("ness", "ment", "tion", "ity"), "NN"),
    ("suffix", ("s",), "NNS"),
)


def _fits(test: str, values: tuple[str, ...], t: Column) -> Column:
    if test == "mark":
        return t.isin(*values)
    if test == "word":
        return F.lower(t).isin(*values)
    if test == "digit":
        return t.rlike("^[0-9]+([.,][0-9]+)*$")
    out = F.lit(False)
    for v in values:
        out = out | F.lower(t).endswith(v)
    return out


def tag_token(t: Column) -> Column:
    out = F.when(t.rlike(r"^([A-Za-z]|[^\x00-\x7F])"), F.lit("NN")).otherwise(F.lit("SYM"))
    for test, values, tag in reversed(RULES):
        out = F.when(_fits(test, values, t), F.lit(tag)).otherwise(out)
    return out


def default_tagger(toks: Column) -> Column:
    return F.transform(toks, tag_token)


def tag_ids(tags: Column) -> Column:
    """1..45 by the sorted order of tags; null for unknown ones."""
    table = F.create_map(*[F.lit(x) for kv in TAG_IDS.items() for x in kv])
    return F.transform(tags, lambda t: F.try_element_at(table, t))


def tag_sql(token: str) -> str:
    """The same rules as an SQL expression."""
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    parts = []
    for test, values, tag in RULES:
        inside = ", ".join(map(quote, values))
        if test == "mark":
            when = f"{token} IN ({inside})"
        elif test == "word":
            when = f"lower({token}) IN ({inside})"
        elif test == "digit":
            when = f"regexp_full_match({token}, '[0-9]+([.,][0-9]+)*')"
        else:
            when = "(" + " OR ".join(f"ends_with(lower({token}), {quote(v)})" for v in values) + ")"
        parts.append(f"WHEN {when} THEN {quote(tag)}")
    return f"CASE {' '.join(parts)} WHEN regexp_matches({token}, '^([A-Za-z]|[^\\x00-\\x7F])') THEN 'NN' ELSE 'SYM' END"
