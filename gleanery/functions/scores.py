"""Score functions over Columns and arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ONTOLOGY = ("negative", "neutral", "positive")


def let(value: Column, f) -> Column:
    """f(value) with the value computed once: an expression used in several places, or in a lambda, is otherwise computed in each."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def rounded(x: Column | str, places: int) -> Column:
    """To so many places as DuckDB's round() does it: of the product in doubles. Spark's round() goes by the shortest decimal, so that
    at ties, where doubles lie on either side of the decimal, the two may differ by one in the last place."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x.cast("double") * float(10**places)) / float(10**places)


def normalize(s: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return (s - low) / (high - low)


def softmax(s: Column, scale: float = 1.0) -> Column:
    """Softmax of an array, shifted by its maximum so that no logit overflows."""
    shares = lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda z: F.transform(e, lambda x: x / z))
    return let(F.array_max(s), lambda top: let(F.transform(s, lambda x: F.exp((x - top) / scale)), shares))


def compound(s: Column, scale: float = 1.0) -> Column:
    """Logits [neg, neu, pos] as one number from 0 to 1: (1 - neu) * (pos - neg) of their softmax, normalized."""
    return let(softmax(s, scale), lambda p: normalize((1 - F.get(p, F.lit(1))) * (F.get(p, F.lit(2)) - F.get(p, F.lit(0)))))


def argmax_label(s: Column, names: tuple[str, ...] = ONTOLOGY) -> Column:
    """Name of the largest entry, the first of equals."""
    return F.get(F.array(*[F.lit(x) for x in names]), (F.array_position(s, F.array_max(s)) - 1).cast("int"))


def argmax_index(s: Column) -> Column:
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def reorder(s: Column, have: tuple[str, ...], want: tuple[str, ...] = ONTOLOGY) -> Column:
    """Entries of an array in the order ``have``, in the order ``want``."""
    return F.array(*[F.get(s, F.lit(have.index(x))) for x in want])


def one_hot(tag: Column, n: int = 45) -> Column:
    """n flags, all 0 for tag 0."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: (k == tag).cast("int"))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def divide(a: Column, n: Column | float) -> Column:
    return F.transform(a, lambda x: x / n)


def perplexity(loss: Column, count: Column) -> Column:
    """Aggregate: exp of the mean loss per counted token."""
    return F.exp(F.avg(loss / count))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if one is zero. An extension."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
