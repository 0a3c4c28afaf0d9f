import string

import pytest
from pyspark.sql import functions as F

from gleanery.functions import scores, text


def one(spark, c, value="x", kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(c(F.col("c")).alias("o")).first()["o"]


def cleaned(s):
    kept = set("`'!?,()" + string.ascii_letters + string.digits)
    s = "".join(c if c in kept else " " for c in s)
    for x in ("'s", "'ve", "n't", "'re", "'d", "'ll"):
        s = s.replace(x, " " + x)
    for x in ",!":
        s = s.replace(x, f" {x} ")
    for x in "()?":
        s = s.replace(x, f" \\{x} ")
    return " ".join(s.split())


@pytest.mark.parametrize("s", ["It's fine, isn't it?", "(a)(b)!", "we've  they're I'd you'll.", "", "  é  ", "a`b'c", "don't?!,"])
def test_clean_text(spark, s):
    assert one(spark, text.clean_text, s) == cleaned(s)


def test_clean_text_plain_and_null(spark):
    assert one(spark, lambda c: text.clean_text(c, compat=False), "a(b)?") == "a ( b ) ?"
    assert one(spark, text.clean_text, None) is None


def test_keeps(spark):
    assert one(spark, text.keep_alpha, "a1-b/c é ") == "ab/c"
    assert one(spark, text.keep_alphanumeric, "a/b--c.d'e") == "a b c.d'e"
    assert one(spark, lambda c: text.keep_alphanumeric(c, slash=True), "a/b--c") == "a/b c"
    assert one(spark, text.text_md5, "abc") == "900150983cd24fb0d6963f7d28e17f72"


def test_tokens_and_sentences(spark):
    assert one(spark, text.tokens, 'Don\'t stop. It\'s "good", ok?') == ["Do", "n't", "stop", ".", "It", "'s", '"', "good", '"', ",", "ok", "?"]
    assert len(one(spark, text.tokens, "w " * 500)) == 200 and len(one(spark, lambda c: text.tokens(c, None), "w " * 500)) == 500
    assert one(spark, text.tokens, "  ") == []
    assert one(spark, text.sentences, "One. Two!  Three? four") == ["One.", "Two!", "Three?", "four"]
    assert one(spark, text.whitespace_tokens, " a  b\tc ") == ["a", "b", "c"]


@pytest.mark.parametrize("n", range(9))
def test_cyclic_pad(spark, n):
    words = [f"w{i}" for i in range(n)]
    want = None if n == 0 else [words[i % n] for i in range(5)] if n < 5 else words
    assert one(spark, text.cyclic_pad, words, "array<string>") == want


def test_small_functions(spark):
    assert one(spark, lambda c: text.find_phrases(F.lit("Price"), c), ["the price tag", "pric", "PRICEY"], "array<string>") == ["the price tag", "PRICEY"]
    assert one(spark, text.first_word, " two words") == "two" and one(spark, text.first_word, "") is None
    assert one(spark, lambda c: text.topic_label(F.lit(""), c), ["a", "b"], "array<string>") == " - a b"
    assert [one(spark, text.sentiment_name, v, "int") for v in (-1, 0, 1, 5)] == ["negative", "neutral", "positive", None]
    assert tuple(one(spark, text.entity_attribute, "food#price")) == ("food", "price")
    assert "\x1b[" in one(spark, lambda c: text.highlight(F.array(c), F.array(F.lit(True))), "w")
    assert one(spark, text.token_count, ["a", "b"], "array<string>") == 2


def test_scores(spark):
    arr = "array<double>"
    assert one(spark, scores.compound, [0.0, 0.0, 0.0], arr) == pytest.approx(0.5)
    assert one(spark, scores.compound, [0.0, 0.0, 900.0], arr) == pytest.approx(1.0)
    assert one(spark, scores.argmax_label, [0.5, 0.5, 0.1], arr) == "negative"
    assert one(spark, scores.argmax_index, [0.1, 0.7, 0.7], arr) == 1
    assert one(spark, lambda c: scores.reorder(c, ("positive", "negative", "neutral")), [1.0, 2.0, 3.0], arr) == [2.0, 3.0, 1.0]
    assert one(spark, lambda c: scores.normalize(c), 0.0, "double") == 0.5
    hot = one(spark, scores.one_hot, 3, "int")
    assert sum(hot) == 1 and hot[2] == 1 and len(hot) == 45 and sum(one(spark, scores.one_hot, 0, "int")) == 0
    assert sum(one(spark, scores.softmax, [1.0, 2.0, 3.0], arr)) == pytest.approx(1)
    assert one(spark, lambda c: scores.divide(scores.add(c, c), 2.0), [1.0, 2.0], arr) == [1.0, 2.0]
    assert one(spark, lambda c: scores.cosine(c, F.array(F.lit(0.0))), [1.0], arr) is None
    rows = spark.createDataFrame([(2.0, 2), (4.0, 2)], "loss double, n int")
    assert rows.select(scores.perplexity(F.col("loss"), F.col("n")).alias("p")).first()["p"] == pytest.approx(2.718281828**1.5)
