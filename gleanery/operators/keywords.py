"""Key phrases: runs of content words between stop words and punctuation, scored by degree over frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.functions.scores import rounded
from gleanery.functions.text import tokens

STOP_WORDS = tuple(
    sorted(
        set(
            """the a an and or but nor so yet if then else than that this these those there here who whom whose which what when where why how
            i me my mine we us our ours you your yours he him his she her hers it its they them their theirs myself ourselves yourself himself herself itself themselves
            am is are was were be been being do does did doing done have has had having will would shall should can could may might must ought
            not no only own same too very just about above after again against all any because before below between both by down during each few for from further
            in into more most of off on once other out over some such through to under until up while with at as n't 's 're 've 'd 'll 'm""".split()
        )
    )
)


def is_delimiter(t: Column) -> Column:
    return F.lower(t).isin(*STOP_WORDS) | ~t.rlike(r"[A-Za-z0-9]|[^\x00-\x7F]")


def phrases(text: Column) -> Column:
    """Lower-cased phrases of a text in order, repeats kept. Within the row: no shuffle, no window."""
    marked = F.transform(tokens(text, None), lambda t: F.when(is_delimiter(t), F.lit("\n")).otherwise(F.lower(t)))
    return F.filter(F.transform(F.split(F.array_join(marked, " "), "\n"), lambda p: F.trim(p)), lambda p: p != "")


def ranked_phrases(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, phrase, score, rank): score is the sum over words of degree / frequency within the document.

    Rank 1 is best; equal scores rank by phrase, greatest first."""
    rows = df.select(*key, F.posexplode(F.col("p")).alias("at", "phrase")) if "p" in df.columns else df.select(*key, F.posexplode(phrases(F.col(text))).alias("at", "phrase"))
    words = rows.select(*key, "at", "phrase", F.explode(F.split("phrase", " ")).alias("word"), F.size(F.split("phrase", " ")).alias("len"))
    per_word = W.partitionBy(*key, "word")
    scored = words.withColumn("s", F.sum("len").over(per_word) / F.count("*").over(per_word))
    each = scored.groupBy(*key, "at", "phrase").agg(F.sum("s").alias("score"))
    best = each.groupBy(*key, "phrase").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(rounded("score", 9).desc(), F.col("phrase").desc())))
