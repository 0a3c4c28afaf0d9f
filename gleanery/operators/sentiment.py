"""Sentence and document sentiment from pluggable lexicons; the default lexicon is a small one of our own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.scores import ONTOLOGY, add, argmax_label, divide, let, normalize
from gleanery.functions.text import sentences, tokens

#: word: valence from -4 to 4.
LEXICON = {
    **dict.fromkeys("excellent amazing outstanding perfect wonderful superb".split(), 3.2),
    **dict.fromkeys("great love loved best fantastic awesome".split(), 2.8),
    **dict.fromkeys("good nice happy helpful easy useful enjoy enjoyed pleasant".split(), 1.9),
    **dict.fromkeys("ok fine clear clean fast reliable".split(), 1.1),
    **dict.fromkeys("slow clunky hard confusing dull weak noisy".split(), -1.2),
    **dict.fromkeys("bad poor sad annoying broken difficult wrong".split(), -2.1),
    **dict.fromkeys("terrible horrible awful worst hate hated useless disgusting pathetic".split(), -3.0),
}
NEGATIONS = ("not", "n't", "no", "never", "none", "nor", "hardly", "without")
BOOSTERS = {"very": 0.293, "really": 0.293, "extremely": 0.293, "so": 0.293, "too": 0.293, "slightly": -0.293, "somewhat": -0.293, "barely": -0.293}
DAMP = 0.74

Scorer = Callable[[Column], Column]  #: text to struct<polarity: double, scores: array<double>>


def _look(values: dict[str, float], key: Column) -> Column:
    """The value of a key, else null; a hash of the keys is asked before the map, whose search is linear."""
    return F.when(key.isin(*values), F.try_element_at(_table(values), key))


def _table(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def may_hold(text: Column, lexicon: dict[str, float] = LEXICON) -> Column:
    """False only where no token of the text can be a word of the lexicon: one regular expression, asked before any token is cut.

    The tokenizer parts letters from letters before n't alone, so elsewhere a word of letters has none beside it."""
    plain = sorted(w for w in lexicon if w.isascii() and w.isalpha())
    parts = [rf"(?<![a-z])(?:{'|'.join(plain)})(?:(?![a-z])|(?=n't))"] if plain else []
    parts += [rf"\Q{w}\E" for w in sorted(lexicon) if w not in plain]
    return F.lower(text).rlike("|".join(parts)) if parts else F.lit(False)


def valences(toks: Column, lexicon: dict[str, float] = LEXICON) -> Column:
    """Per token: its valence, raised by a booster just before, turned and damped by a negation among the three before."""
    def of(low):
        def one(t, i):
            def scored(v):
                b = F.coalesce(let(F.coalesce(F.get(low, i - 1), F.lit("")), lambda w: _look(BOOSTERS, w)), F.lit(0.0))
                raised = F.when(v > 0, v + b).when(v < 0, v - b).otherwise(0.0)
                before = F.slice(low, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3)))
                denied = F.exists(before, lambda w: w.isin(*NEGATIONS))
                return F.when(v == 0, 0.0).when(denied, raised * -DAMP).otherwise(raised)

            return let(F.coalesce(_look(lexicon, t), F.lit(0.0)), scored)

        return F.transform(low, one)

    return let(F.transform(toks, lambda t: F.lower(t)), of)


def _sum(a: Column, f: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))


def sentence_scores(sentence: Column, lexicon: dict[str, float] = LEXICON) -> Column:
    """struct<scores: [neg, neu, pos], compound> of one sentence; shares of the valence mass, compound from -1 to 1."""

    def of(v):
        neg = _sum(v, lambda x: F.when(x < 0, 1 - x).otherwise(0.0))
        neu = F.size(F.filter(v, lambda x: x == 0)).cast("double")
        pos = _sum(v, lambda x: F.when(x > 0, x + 1).otherwise(0.0))
        shares = lambda m: let(_sum(m), lambda mass: F.transform(m, lambda x: F.when(mass > 0, x / mass).otherwise(0.0)))
        return F.struct(let(F.array(neg, neu, pos), shares).alias("scores"), let(_sum(v), lambda t: t / F.sqrt(t * t + 15)).alias("compound"))

    # without a known word all of a sentence's mass is neutral
    quiet = F.struct(F.array(F.lit(0.0), F.when(sentence.rlike(r"\S"), 1.0).otherwise(0.0), F.lit(0.0)).alias("scores"), F.lit(0.0).alias("compound"))
    return F.when(may_hold(sentence, lexicon), let(valences(tokens(sentence, None), lexicon), of)).otherwise(quiet)


def lexicon_score(text: Column, lexicon: dict[str, float] = LEXICON) -> Column:
    """Means over the sentences of a text: struct<polarity 0..1, scores>; null where there is no sentence."""
    zero = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))

    def of(each):
        n = F.size(each)
        mean = divide(F.aggregate(each, zero, lambda s, x: add(s, x["scores"])), F.greatest(n, F.lit(1)))
        polarity = normalize(F.aggregate(each, F.lit(0.0), lambda s, x: s + x["compound"]) / F.greatest(n, F.lit(1)))
        return F.when(n > 0, F.struct(polarity.alias("polarity"), mean.alias("scores")))

    return let(F.transform(sentences(F.coalesce(text, F.lit(""))), lambda s: sentence_scores(s, lexicon)), of)


def pattern_score(text: Column, lexicon: dict[str, float] = LEXICON) -> Column:
    """Mean valence of the known words: polarity p from 0 to 1, scores [1 - p, 0, p]."""
    whole = F.coalesce(text, F.lit(""))
    low = F.transform(tokens(whole, None), lambda t: F.lower(t))
    known = F.filter(F.transform(low, lambda t: _look(lexicon, t)), lambda x: x.isNotNull())
    known = F.when(may_hold(whole, lexicon), known).otherwise(F.array().cast("array<double>"))
    mean = let(known, lambda k: F.when(F.size(k) > 0, _sum(k) / F.size(k) / 4).otherwise(0.0))
    return let(normalize(mean), lambda p: F.struct(p.alias("polarity"), F.array(1 - p, F.lit(0.0), p).alias("scores")))


SCORERS: dict[str, Scorer] = {"vader": lexicon_score, "pattern": pattern_score}


def score_sentiment(text: Column, classifier: str = "vader") -> Column:
    """By name, whatever its case; an unknown name scores 0.5 throughout."""
    f = SCORERS.get(classifier.lower())
    half = F.lit(0.5)
    return f(text) if f else F.struct(half.alias("polarity"), F.array(half, half, half).alias("scores"))


def score_overall(text: Column, scorers: tuple[str, ...] = ("pattern", "vader")) -> Column:
    """struct<label, scores>: mean of the scorers' triples and its largest entry's name; null where a scorer gives null."""
    triples = [score_sentiment(text, s)["scores"] for s in scorers]
    total = triples[0]
    for t in triples[1:]:
        total = add(total, t)
    return let(divide(total, float(len(scorers))), lambda m: F.struct(argmax_label(m, ONTOLOGY).alias("label"), m.alias("scores")))


def sentence_means(df: DataFrame, key: str) -> DataFrame:
    """Mean triples and compound over rows (key, neg, neu, pos, compound)."""
    return df.groupBy(key).agg(*[F.avg(c).alias(c) for c in ("neg", "neu", "pos", "compound")])
