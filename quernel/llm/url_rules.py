"""URL filters in DataFrame operations only: rules indexed by their rarest literal token.

A rule is a regular expression over a host, path and query, with the whole tokens it cannot match without. Token
frequencies over all URLs choose the rarest one as its index key. A URL's tokens fetch candidate rules by a join on that
key, and only these candidates run their expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.shared import small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """pattern is searched in host + path + query, but for prefix rules with A-Z lower-cased; literals are tokens that any
    match holds whole."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    prefix: bool = True  #: a host and path rule; the others are only asked when none of these fits


def prefix_rule(verdict: str, target: str) -> Rule:
    """The rule for a host, its subdomains and the paths that start as target's."""
    host, slash, path = target.partition("/")
    tokens = re.findall(r"[a-z0-9]+", host) + re.findall(r"(?<=/)[A-Za-z0-9]+(?=[^A-Za-z0-9])", slash + path)
    end = re.escape(slash + path) if slash else "(?=[/?]|$)"
    return Rule(target, verdict, rf"^(?:[^/?#]*\.)?{re.escape(host)}{end}", tuple(t.lower() for t in tokens))


def _tokens(words: str) -> tuple[str, ...]:
    return tuple(re.findall(r"[a-z0-9]+", words))


def host_word(word: str) -> Rule:
    """Blocks hosts with this word between separators."""
    return Rule(f"host:{word}", "block", rf"^(?:[^/?#]*[.-])?{re.escape(word)}(?:[.-]|[/?#:]|$)", _tokens(word), prefix=False)


def path_part(part: str) -> Rule:
    """Blocks paths with this part between slashes, before a file's ending or at the end."""
    return Rule(f"path:{part}", "block", rf"^[^/?]*/(?:[^?]*/)?{re.escape(part)}(?:[/?.]|$)", _tokens(part), prefix=False)


def query_key(key: str) -> Rule:
    """Blocks queries with this key."""
    return Rule(f"query:{key}", "block", rf"\?(?:.*&)?{re.escape(key)}=", _tokens(key), prefix=False)


#: Fixed by the query's contract.
CONTRACT = (
    prefix_rule("block", "com/en/"),
    prefix_rule("allow", "example.com/en/7"),
    prefix_rule("allow", "net/de/"),
    prefix_rule("block", "example.net/de/8"),
    prefix_rule("block", "org/es/"),
)
#: Words of hosts that sell, gamble, track or spam.
HOST_WORDS = (
    "ad ads adserver adult affiliate bet bets bingo bitcoin-casino casino click clicks coupon coupons dating doubleclick escort forex "
    "gambling hentai jackpot loan loans lottery malware payday phishing pills poker popup porn porno sex slots spam torrent torrents track tracker viagra warez webcam xxx"
).split()
#: Parts of paths that lead to accounts, shops, searches, archives and machines rather than to texts.
PATH_PARTS = (
    "account accounts ads add-to-cart admin ajax api author authors basket cart cgi-bin checkout comment-page cookie-policy dashboard download downloads error-404 "
    "feed feeds forgot-password gdpr login logout lost-password my-account newsletter oauth order-status password-reset print privacy-policy product-compare register "
    "rss search search-results shopping-cart sign-in sign-out sign-up signin signup sitemap subscribe tag tags terms-of-service trackback unsubscribe wishlist wp-admin wp-json wp-login xmlrpc"
).split()
#: Keys of queries that repeat a page under many addresses, or act on it.
QUERY_KEYS = "add-to-cart addtocart affid affiliate_id attachment_id comment_reply currency filter_by jsessionid orderby phpsessid preview_id print_view redirect_to replytocom reset_key return_to session_id sessionid share_to sid sort_by trackback_url unsubscribe_token view_mode wishlist_id".split()
WORDS = (*map(host_word, HOST_WORDS), *map(path_part, PATH_PARTS), *map(query_key, QUERY_KEYS))


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"^(?s:.*?)://((?s:[^/?#]*))", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*(?:/[^?#]*)?(\?[^#]*)", 1), F.lit(""))


def tokens_of(place: Column) -> Column:
    """The distinct runs of ASCII letters and digits, lower-cased."""
    return F.array_remove(F.array_distinct(F.split(F.translate(place, UPPER, LOWER), "[^a-z0-9]+")), "")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = CONTRACT + WORDS, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url).

    A null URL or one without :// has an empty host and path, fits no rule and gets the default. Among fitting prefix
    rules the longest wins (the first given on a tie) and is named in rule; otherwise rule is null and any fitting
    word rule decides, block before allow. Repeated rows give repeated rows, an empty table an empty one; very long URLs
    are read whole; other columns are ignored.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), query_of(F.col("url")).alias("query"))
    rows = rows.select("page_id", "host", "path", F.concat("host", "path", "query").alias("place"))
    places = rows.select("place").distinct()
    tokens = places.select("place", F.explode(tokens_of(F.col("place"))).alias("token"))
    given = [F.struct(F.lit(i).alias("rule_id"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("says"), F.lit(r.pattern).alias("pattern"), F.lit(r.prefix).alias("prefix"), F.array(*map(F.lit, r.literals)).alias("literals")) for i, r in enumerate(rules)]
    listed = spark.range(1).select(F.inline(F.array(*given)))
    literals = listed.select("rule_id", F.explode("literals").alias("token"))
    size = sum(len(r.pattern) + len(r.name) + 40 for r in rules)
    seen = tokens.join(small(literals.select("token").distinct(), len(rules) * 4, 64), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = literals.join(seen, "token", "left").groupBy("rule_id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("token"))
    index = listed.drop("literals").join(rarest, "rule_id")
    hits = tokens.join(small(index, 1, size), "token").filter(F.when(F.col("prefix"), F.expr("place rlike pattern")).otherwise(F.expr(f"translate(place, '{UPPER}', '{LOWER}') rlike pattern")))
    longest = F.max(F.when(F.col("prefix"), F.struct(F.length("name").alias("n"), (-F.col("rule_id")).alias("order"), "name", "says")))
    word = F.max(F.when(~F.col("prefix"), F.col("says")))
    best = hits.groupBy("place").agg(longest.alias("best"), word.alias("word"))
    joined = rows.join(best, "place", "left")
    return joined.select("page_id", "host", "path", F.col("best.name").alias("rule"), F.coalesce("best.says", "word", F.lit(default)).alias("verdict"))
