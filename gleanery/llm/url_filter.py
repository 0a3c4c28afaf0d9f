"""URL filters by association rules (operator 3).

FP-growth mines combinations of URL tokens (host suffixes, path segments with digits folded, query keys) and a
label from labelled URLs. Rules with the label as consequent are pruned by support and confidence; by chance (the exact
probability that so many of a rule's URLs are blocked at the base rate, times the number of token sets tried, must be
at most ``chance``); and by any shorter rule at least as confident. Matching uses an inverted index: each rule is filed under its rarest token, a URL looks up
only rules filed under its own tokens and checks that the rest are there. The index is checked against ``most_rules``
before it goes to all tasks; beyond it rules and URLs meet by a join on the token.

Stated host rules come first: a rule ``host/path`` fits its host and all subdomains where the URL's path starts with
the rule's; the longest wins. Where none fits, a URL is blocked if a mined rule fits it, else allowed.

Defined cases: host and path are empty for null URLs and those without ``://``; such URLs fit no rule and are allowed. Host
names fold A-Z only. Null page_id and repeated rows stay, each judged alone. Labels that are null, or without a page, teach
nothing; no labels give no mined rules. Columns other than those named are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm import common

#: The stated rules of the query: (verdict, rule).
STATED = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
LABEL = "label=block"


@dataclass(frozen=True)
class UrlConfig:
    support: float = 0.002
    confidence: float = 0.6
    chance: float = 0.01  #: of one rule or more among all that hold by luck alone
    most_rules: int = 100_000
    sample: int = 500_000  #: labelled URLs to learn from, at most about so many


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens: host suffixes from one label on, path segments with digits as 0, query keys."""
    labels = F.split(host_of(url), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, -i, i), ".")))
    parts = F.filter(F.split(F.regexp_replace(path_of(url), r"[0-9]+", "0"), "/"), lambda x: x != "")
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    made = F.array_distinct(F.concat(suffixes, F.transform(parts, lambda x: F.concat(F.lit("p:"), x)), F.transform(keys, lambda x: F.concat(F.lit("q:"), x))))
    return F.when(host_of(url) == "", F.array().cast("array<string>")).otherwise(made)


def tail(hits: np.ndarray, rows: np.ndarray, base: float) -> np.ndarray:
    """Logarithm of the probability of ``hits`` or more among ``rows`` draws at rate ``base`` (0 < base < 1); exact sums of the binomial."""
    out = np.empty(len(hits))
    for i, (k, n) in enumerate(zip(hits.tolist(), rows.tolist(), strict=True)):
        x = np.arange(k, n + 1)
        choose = math.lgamma(n + 1) - _lgamma(x + 1) - _lgamma(n - x + 1)
        terms = choose + x * math.log(base) + (n - x) * math.log1p(-base)
        out[i] = terms.max() + math.log(np.exp(terms - terms.max()).sum())
    return np.minimum(out, 0.0)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma of positive integers: Stirling's series from 8 on, which is exact to 1e-12 there, sums below."""
    small = np.array([0.0] + [math.lgamma(i) for i in range(1, 8)])
    y = np.maximum(x, 8).astype(float)
    series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return np.where(x < 8, small[np.minimum(x, 7)], series)


def least_hits(base: float, chance: float) -> int:
    """Blocked URLs that a rule needs at least to pass: with fewer, even a rule that is always right may be luck."""
    return max(1, math.ceil(math.log(chance) / math.log(base))) if 0 < base < 1 else 1


def filed(rules: DataFrame) -> DataFrame:
    """rules with ``token__``, the one of their items that fewest rules have."""
    frequency = rules.select(F.explode("items").alias("t")).groupBy("t").agg(F.count("*").alias("f"))
    rarest = rules.select("rule_id", F.explode("items").alias("t")).join(frequency, "t").groupBy("rule_id").agg(F.min(F.struct("f", "t")).alias("m"))
    return rules.join(rarest.select("rule_id", F.col("m.t").alias("token__")), "rule_id")


def mine(labelled: DataFrame, config: UrlConfig = UrlConfig()) -> DataFrame:
    """Rules (rule_id, items, confidence, support) for blocking, from labelled (url, block boolean)."""
    known = labelled.where("url is not null and block is not null")
    schema = "rule_id long, items array<string>, confidence double, support double"
    spark = labelled.sparkSession
    n = known.count()
    if n > config.sample:
        known = known.where(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) / (1 << 30) < config.sample / n)
    baskets = common.staged(known.select(F.concat(tokens(F.col("url")), F.when(F.col("block"), F.array(F.lit(LABEL))).otherwise(F.array().cast("array<string>"))).alias("items")), "url-baskets")
    n, blocked = baskets.agg(F.count("*"), F.count_if(F.array_contains("items", LABEL))).first()
    if not 0 < blocked < n:  # labels that don't differ say nothing of URLs
        return spark.createDataFrame([], schema)
    base = blocked / n
    support = max(config.support, least_hits(base, config.chance) / n)
    if support > 1:
        return spark.createDataFrame([], schema)
    # partitions of the growth hold conditional trees by token, so no token's rows meet in one task
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=config.confidence).fit(baskets)
    tried = model.freqItemsets.where(~F.array_contains("items", LABEL)).count()
    rules = model.associationRules.where(F.array_contains("consequent", LABEL)).select(F.array_sort("antecedent").alias("items"), "confidence", "support")

    def unlikely(batches):
        for b in batches:
            c, s = b.column("confidence").to_numpy(), b.column("support").to_numpy()
            k = np.rint(s * n).astype(np.int64)
            yield b.filter(pa.array(tail(k, np.rint(k / c).astype(np.int64), base) <= math.log(config.chance / max(1, tried))))

    rules = rules.withColumn("rule_id", F.xxhash64("items")).select("rule_id", "items", "confidence", "support")
    rules = common.staged(rules.mapInArrow(unlikely, schema), "url-rules")
    # a rule is idle if a subset of its items is a rule at least as confident; subsets are looked up under their rarest item
    short = filed(rules).select(F.col("items").alias("s"), F.col("confidence").alias("c"), F.col("token__").alias("t"))
    idle = rules.select("items", "confidence", F.explode("items").alias("t")).join(short, "t").where((F.size("s") < F.size("items")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("s", "items")) == 0)).select("items").distinct()
    return common.staged(rules.join(idle, "items", "left_anti").select(rules.columns), "url-rules")


def match(urls: DataFrame, rules: DataFrame, config: UrlConfig = UrlConfig()) -> DataFrame:
    """urls (with ``url``) plus ``mined``: the id of the most confident mined rule that fits, else null."""
    n = rules.count()
    if n == 0:
        return urls.withColumn("mined", F.lit(None).cast("long"))
    index = filed(rules).groupBy("token__").agg(F.collect_list(F.struct("rule_id", "items", "confidence")).alias("rules__"))
    if n <= config.most_rules:
        index = F.broadcast(index)
    keyed = common.staged(urls.withColumn("tokens__", tokens(F.col("url"))).withColumn("row__", F.monotonically_increasing_id()), "url-rows")
    fits = keyed.select("row__", "tokens__", F.explode("tokens__").alias("token__")).join(index, "token__").select("row__", "tokens__", F.explode("rules__").alias("r")).where(F.size(F.array_except("r.items", "tokens__")) == 0)
    best = fits.groupBy("row__").agg(F.max(F.struct(F.col("r.confidence"), F.col("r.rule_id").alias("rule_id"))).alias("b")).select("row__", F.col("b.rule_id").alias("mined"))
    return keyed.join(best, "row__", "left").drop("row__", "tokens__")


def stated_rule(host: Column, path: Column, stated=STATED) -> tuple[Column, Column]:
    """The longest stated rule that fits, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(stated, key=lambda x: len(x[1])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, labelled: DataFrame, config: UrlConfig = UrlConfig(), stated=STATED) -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict, mined."""
    common.prepare(pages.sparkSession)
    rules = mine(labelled, config)
    rows = match(pages.select("page_id", F.col("url").cast("string")), rules, config)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = stated_rule(F.col("host"), F.col("path"), stated)
    rows = rows.withColumn("host", host).withColumn("path", path)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, block): a page is labelled by the document its path ends in; low quality or toxic means block."""
    number = F.expr(r"try_cast(regexp_extract(url, '^[^?#]*/([0-9]+)(?:/|[.]html)?(?:[?#]|$)', 1) as bigint)")
    said = labels.select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("block"))
    return pages.select("url", number.alias("doc_id")).where("doc_id is not null").join(said, "doc_id").select("url", "block")
