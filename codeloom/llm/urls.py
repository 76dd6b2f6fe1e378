"""URL filter: a rule list first, then a weighted vocabulary found by Aho-Corasick.

The longest rule that fits decides. Where none fits, one strict term or ``SOFT_HITS`` distinct soft terms
block. A term counts where no letter or digit touches it.

Cases: a url that is null or has no ``://`` has an empty host and path, fits no rule and is judged by the
vocabulary like any other (a null one is allowed); repeated rows give repeated verdicts; of two rules of
one length, the blocking one wins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (verdict, host and path) of the contract's rules.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

#: One of these rejects.
STRICT = ("adult", "porn", "xxx", "nsfw", "hentai", "camgirls", "escorts", "casino", "slots", "warez", "phishing", "malware", "viagra", "cialis", "jackpot")
#: Several distinct ones of these reject.
SOFT = ("spam", "farm", "cheap", "pills", "free", "bet", "bets", "betting", "win", "winner", "bonus", "poker", "ads", "track", "tracker", "click",
    "popup", "banner", "affiliate", "sexy", "dating", "loan", "loans", "payday", "crack", "keygen", "torrent", "pharmacy", "replica", "discount")
SOFT_HITS = 2

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def automaton(strict: Sequence[str], soft: Sequence[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for weight, words in ((1, soft), (2, strict)):
        for w in words:
            a.add_word(w, (weight, w))
    a.make_automaton()
    return a


def _joins(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def rejects(a: ahocorasick.Automaton, url: str, soft_hits: int = SOFT_HITS) -> tuple[int, int]:
    """Strict and distinct soft terms in a lower-cased url."""
    strict, soft = set(), set()
    for end, (weight, word) in a.iter(url):
        at = end - len(word) + 1
        if (at == 0 or not _joins(url[at - 1])) and (end + 1 == len(url) or not _joins(url[end + 1])):
            (strict if weight == 2 else soft).add(word)
    return len(strict), len(soft)


def vocabulary_hits(url: Column, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT) -> Column:
    """Struct of the counts of distinct strict and soft terms."""

    @F.pandas_udf("strict int, soft int")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        a = automaton(strict, soft)
        for b in batches:
            yield pd.DataFrame([rejects(a, u or "") for u in b], columns=["strict", "soft"]).astype("int32")

    return hits(url)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null where none does."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
        top, slash, rest = rule.partition("/")
        fits = ((host == top) | host.endswith(f".{top}")) & path.startswith(slash + rest)
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def judge_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT, soft_hits: int = SOFT_HITS) -> DataFrame:
    """id, host, path, rule, verdict, and the counts of strict and of distinct soft terms."""
    url = F.col("url")
    parts = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host_of(url).alias("host"), path_of(url).alias("path"),
        vocabulary_hits(F.translate(url, UPPER, LOWER), strict, soft).alias("hits"))
    ruled = parts.withColumn("ruled", longest_rule(F.col("host"), F.col("path"), rules))
    by_method = F.when((F.col("hits.strict") >= 1) | (F.col("hits.soft") >= soft_hits), "block").otherwise("allow")
    return ruled.select(F.col("id").alias(id_col), "host", "path", F.col("ruled.rule").alias("rule"),
        F.coalesce(F.col("ruled.verdict"), by_method).alias("verdict"), F.col("hits.strict").alias("strict_hits"), F.col("hits.soft").alias("soft_hits"))
