"""URL filters: rules stand under their rarest literal token; only rules a URL's tokens fetch are run.

Native: DataFrame functions throughout.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many rules are constants of the plan at most; more are joined by a shuffle on the token.
MOST_BROADCAST = 10_000


@dataclass(frozen=True)
class Rule:
    """`pattern` is searched in host + path; `literals` are tokens that any URL it fits holds as whole tokens."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    site: bool = False


def site_rule(name: str, verdict: str) -> Rule:
    """A rule (host, path) such as example.net/en/: the host or a subdomain of it, and paths that start so."""
    host, slash, path = name.partition("/")
    literals = re.findall("[a-z0-9]+", host.lower()) + re.findall("[a-z0-9]+(?=[^a-z0-9])", f"{slash}{path}".lower())
    return Rule(name, verdict, rf"\A(?:[^/]*\.)?\Q{host}\E\Q{slash}{path}\E", tuple(dict.fromkeys(literals)), True)


def word_rule(word: str, verdict: str = "block") -> Rule:
    """A path segment that is this word."""
    return Rule(word, verdict, rf"\A[^/]*/(?:[^/]*/)*\Q{word}\E(?:/|\z)", (word,))


#: Path segments of pages without prose.
PLAIN_PAGES = ("login", "signin", "signup", "logout", "cart", "checkout", "cgi", "xmlrpc", "adserver", "captcha")


def default_rules() -> list[Rule]:
    return [word_rule(w) for w in PLAIN_PAGES]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to a slash, question mark, hash or the end, A-Z lower-cased. Path:
    from there up to a question mark, hash or the end. Both are empty without :// or for null."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), upper, upper.lower())
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


ENTRY = "struct<token:string,rule:string,verdict:string,pattern:string,site:boolean>"


def _rarest(pages: DataFrame, tokens: Column, rules: Sequence[Rule]) -> list[str]:
    """Each rule's literal token that the fewest URLs hold, ties by the alphabet; "" without literals."""
    spark = pages.sparkSession
    literals = sorted({t for r in rules for t in r.literals})
    given = spark.createDataFrame([(t,) for t in literals], "token string")
    small = F.broadcast if len(literals) <= MOST_BROADCAST else (lambda frame: frame)
    seen = pages.select(F.explode(tokens).alias("token")).join(small(given), "token", "left_semi")
    times = dict(seen.groupBy("token").agg(F.count("*").alias("times")).collect()) if literals else {}  # a row for each literal
    return [min(((times.get(t, 0), t) for t in r.literals), default=(0, ""))[1] for r in rules]


def _fetched(pages: DataFrame, tokens: Column, entries: list[tuple]) -> DataFrame:
    """The pages with `rules`: the entries that stand under one of their tokens."""
    spark = pages.sparkSession
    if len(entries) <= MOST_BROADCAST:
        # Entries in slots by their token's hash: a constant of the plan, so no row is moved.
        size = 1 << max(4, len(entries).bit_length())
        given = spark.createDataFrame(entries, ENTRY[7:-1].replace(":", " ")).withColumn("slot", F.pmod(F.xxhash64("token"), F.lit(size)))
        slots: list[list] = [[] for _ in range(size)]
        for e in given.collect():
            slots[e["slot"]].append({n: e[n] for n in ("token", "rule", "verdict", "pattern", "site")})
        index = F.from_json(F.lit(json.dumps(slots)), f"array<array<{ENTRY}>>")
        under = lambda t: F.filter(F.get(index, F.pmod(F.xxhash64(t), F.lit(size)).cast("int")), lambda e: e["token"] == t)
        return pages.withColumn("rules", F.flatten(F.transform(tokens, under)))
    given = spark.createDataFrame(entries, ENTRY[7:-1].replace(":", " "))
    found = pages.select("page_id", "url", F.explode(tokens).alias("token")).distinct().join(given, "token")
    found = found.groupBy(F.col("page_id").alias("of_page"), F.col("url").alias("of_url")).agg(F.collect_list(F.struct(*given.columns)).alias("rules"))
    joined = pages.join(found, F.col("page_id").eqNullSafe(F.col("of_page")) & F.col("url").eqNullSafe(F.col("of_url")), "left")
    return joined.select("page_id", "url", "host", "path", F.coalesce("rules", F.array().cast(f"array<{ENTRY}>")).alias("rules"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], otherwise: str = "allow") -> DataFrame:
    """(page_id, url, host, path, rule, fetched, verdict), a row for each row of pages.

    The longest site rule that fits decides and is named in `rule`; without one the first fitting
    pattern rule by name decides, else `otherwise`, and `rule` is null. `fetched` counts the rules
    whose pattern ran. Null URLs fit no rule. Null and repeated page_ids keep their rows. Tokens are
    counted over all URLs to find each rule's rarest; ties go to the first in the alphabet. A rule
    without literals is run on every URL. No page is shuffled, unless there are more rules than a
    plan should carry.
    """
    host, path = host_and_path(F.col("url"))
    pages = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    tokens = F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.lower(F.concat("host", "path")), "[^a-z0-9]+")))
    entries = [(t, r.name, r.verdict, r.pattern, r.site) for t, r in zip(_rarest(pages, tokens, rules), rules, strict=True)]
    if not entries:
        return pages.select("page_id", "url", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(0).cast("long").alias("fetched"), F.lit(otherwise).alias("verdict"))
    pages = _fetched(pages, tokens, entries)
    out = pages.withColumn("fits", F.filter("rules", lambda r: F.call_function("rlike", F.concat("host", "path"), r["pattern"])))
    longest = F.array_max(F.transform(F.filter("fits", lambda r: r["site"]), lambda r: F.struct(F.length(r["rule"]).alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    first = F.array_min(F.transform(F.filter("fits", lambda r: ~r["site"]), lambda r: F.struct(r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return out.select(
        "page_id", "url", "host", "path", longest["rule"].alias("rule"), F.size("rules").cast("long").alias("fetched"),
        F.coalesce(longest["verdict"], first["verdict"], F.lit(otherwise)).alias("verdict"),
    )
