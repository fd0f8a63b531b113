"""URL filters: pattern rules indexed by their rarest literal token, in DataFrame functions.

A rule's literal tokens are runs of letters and digits that end where the rule
ends them, so that a URL that fits the rule has them as whole tokens. The rule
is filed under the one that fewest of the URLs hold. A URL's tokens fetch the
rules filed under them, and only those run their regular expressions.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to this number are one literal map in the plan; more are joined as a table.
INLINE = 2000
#: The token under which rules without a literal token are filed; every URL has it.
ANY = ""


@dataclass(frozen=True)
class Rule:
    """name, verdict, the length that ranks it, a Java regular expression over host and path, and its literal tokens."""

    name: str
    verdict: str
    size: int
    pattern: str
    tokens: tuple[str, ...]


def host_path(verdict: str, rule: str) -> Rule:
    """The rule of a host with all its subdomains and of paths that start with its own, such as "example.com/en/"."""
    host, slash, path = rule.partition("/")
    quoted = "\\Q" + rule + "\\E"
    whole = re.findall("[A-Za-z0-9]+", host) + re.findall(r"(?<=[^A-Za-z0-9])[A-Za-z0-9]+(?=[^A-Za-z0-9])", slash + path)
    end = "" if slash else "(?=/|$)"
    return Rule(rule, verdict, len(rule), f"^(?:[^/]*\\.)?{quoted}{end}", tuple(whole))


def word_rule(verdict: str, word: str) -> Rule:
    """The rule of hosts that have the word between other characters than letters and digits."""
    return Rule(f"~{word}", verdict, 0, f"^(?:[^/]*[^A-Za-z0-9/])?{word}(?![A-Za-z0-9])", (word,))


#: Hosts that the filter blocks by itself, where no rule says otherwise.
WORDS = ("adult", "bets", "casino", "porn", "xxx")


def index(rules: list[Rule], held: dict[str, int]) -> dict[str, list[Rule]]:
    """Rules by the token they are filed under: of a rule's tokens the one that fewest URLs hold, then the one in fewest rules, the longer and the lesser of equals."""
    shared = Counter(t for r in rules for t in set(r.tokens))
    out: dict[str, list[Rule]] = {}
    for r in rules:
        out.setdefault(min(r.tokens, key=lambda t: (held.get(t, 0), shared[t], -len(t), t), default=ANY), []).append(r)
    return out


def _held(address: DataFrame, rules: list[Rule], inline: int) -> dict[str, int]:
    """How many rows of address hold each token among which a rule has a choice; as many entries as the rules have tokens, at most."""
    wanted = sorted({t for r in rules if len(set(r.tokens)) > 1 for t in r.tokens})
    if not wanted:
        return {}
    tokens = address.select(F.explode(_tokens(F.col("address"))).alias("token"))
    tokens = tokens.where(F.col("token").isin(wanted)) if len(wanted) <= inline else tokens.join(address.sparkSession.createDataFrame([(t,) for t in wanted], "token string"), "token", "left_semi")
    return {r["token"]: r["n"] for r in tokens.groupBy("token").agg(F.count("*").alias("n")).collect()}


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without :// or url."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without :// or url."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(address: Column) -> Column:
    return F.array_distinct(F.concat(F.array(F.lit(ANY)), F.split(address, "[^A-Za-z0-9]+")))


def _best(found: Column) -> Column:
    return F.array_max(F.transform(found, lambda r: F.struct(r["size"].alias("size"), r["name"].alias("name"), r["verdict"].alias("verdict"))))


def judge(pages: DataFrame, rules: list[Rule], words: tuple[str, ...] = WORDS, default: str = "allow", inline: int = INLINE) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages (page_id long, url string).

    Of the rules that fit, the longest wins, of equals the one greater by name.
    Where none fits, rule is null and the verdict is block if the host has one
    of the words as a token, else the default. A null url or one without ://
    has an empty host and path and fits no host's rule. Rows are kept as they
    are, repeated or with null ids; other columns aren't read. words, hosts
    that are blocked though no rule names them, are a parameter. A first pass
    counts how many URLs hold each token of the rules, which only decides under
    which token a rule is filed. Up to `inline` rules the plan is one
    projection without shuffle; more rules are a table that is joined with the
    tokens of the distinct addresses.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    split = base.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    address = F.concat("host", "path")
    every = [*rules, *(word_rule("block", w) for w in words)]
    filed = index(every, _held(split.select(address.alias("address")), every, inline))
    if sum(map(len, filed.values())) <= inline:
        row = lambda r: F.struct(F.lit(r.size).alias("size"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"))
        keys = sorted(filed)
        # the lists of a token stand at its number
        number = F.create_map(*(F.lit(x) for i, t in enumerate(keys) for x in (t, i)))
        lists = F.array(*(F.array(*map(row, filed[t])) for t in keys))
        fetched = F.flatten(F.transform(F.filter(F.transform(_tokens(address), lambda t: number[t]), lambda i: i.isNotNull()), lambda i: F.get(lists, i)))
        fits = F.filter(fetched, lambda r: F.regexp_like(address, r["pattern"]))
        judged = split.withColumn("_best", _best(fits))
    else:
        spark = pages.sparkSession
        table = spark.createDataFrame([(t, r.size, r.name, r.verdict, r.pattern) for t, rs in filed.items() for r in rs], "token string, size int, name string, verdict string, pattern string")
        apart = split.select(address.alias("address")).distinct()
        met = apart.select("address", F.explode(_tokens(F.col("address"))).alias("token")).join(table, "token").where(F.regexp_like("address", F.col("pattern")))
        best = met.groupBy("address").agg(F.max(F.struct("size", "name", "verdict")).alias("_best"))
        judged = split.withColumn("address", address).join(best, "address", "left")
    own = F.when(F.col("_best.size") > 0, F.col("_best.name"))
    return judged.select("page_id", "host", "path", own.alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
