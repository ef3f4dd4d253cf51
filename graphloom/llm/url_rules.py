"""URL filters: pattern rules found by their rarest literal token, and host rules of which the longest fitting one wins.

A pattern rule holds literal tokens (runs of letters and digits that every match must contain as whole tokens) and a regular
expression. Rules are a table (name, tokens, pattern), read from a file or given as a DataFrame of any size. The token of a rule that
is rarest among the tokens of all URLs indexes it. URLs are exploded into tokens and joined with the index on the token; only the
expressions of the rules that a URL fetches run, and the first name by the alphabet counts. What matches is joined back by URL. The
index is broadcast up to a checked number of rules; beyond it, and for the way back, hot keys are dealt to several tasks. All of it
is DataFrame operations, without Python on the executors.

Defined results: a null url, or one without "://", has an empty host and path; no rule fits an empty host; pattern rules see a
null url as empty, so none is fetched and it is allowed; repeated rows are judged alike; other columns pass unless they are called
host, path, rule or verdict, or pattern_rule, which are replaced; a rule without tokens is an error; an empty table of rules or pages
gives no match and no rows.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.joins import spread_join

from .common import stored

#: The host rules of the query's contract, (verdict, host, path).
HOST_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


@dataclass(frozen=True)
class PatternRule:
    name: str
    tokens: tuple[str, ...]  #: lower-case tokens that any match has, whole
    pattern: str  #: matched against the lower-cased url; the same in Java and RE2 syntax


#: The default pattern rules.
PATTERN_RULES = (
    PatternRule("adult categories", ("adult",), r"/adult(/|$)|[?&]category=adult([&#]|$)"),
    PatternRule("adult hosts", ("xxx",), r"://([^/?#]*[.-])?xxx[.-]"),
    PatternRule("advertising servers", ("ads",), r"://ads\.|/ads/"),
    PatternRule("affiliate redirects", ("aff", "id"), r"[?&]aff_id="),
    PatternRule("banner scripts", ("banner", "js"), r"/banner\.js([?#]|$)"),
    PatternRule("betting hosts", ("betting",), r"://([^/?#]*[.-])?betting[.-]"),
    PatternRule("casinos", ("casino",), r"://([^/?#]*[.-])?casino[.-]"),
    PatternRule("calendar traps", ("calendar", "month"), r"/calendar[/?].*month="),
    PatternRule("cart actions", ("add", "to", "cart"), r"[?&]add-to-cart="),
    PatternRule("checkouts", ("checkout",), r"/checkout([/?#]|$)"),
    PatternRule("comment replies", ("replytocom",), r"[?&]replytocom="),
    PatternRule("consent pages", ("consent",), r"://consent\."),
    PatternRule("cracked software", ("keygen",), r"[/.-]keygen([/.?#-]|$)"),
    PatternRule("crypto giveaways", ("crypto", "giveaway"), r"crypto-giveaway"),
    PatternRule("dating hosts", ("dating",), r"://([^/?#]*[.-])?dating[.-]"),
    PatternRule("doorway pages", ("doorway",), r"/doorway[/.-]"),
    PatternRule("feeds by campaign", ("utm", "source", "spam"), r"[?&]utm_source=spam([&#]|$)"),
    PatternRule("installers", ("msi",), r"\.msi([?#]|$)"),
    PatternRule("link farms", ("linkfarm",), r"://([^/?#]*[.-])?linkfarm[.-]"),
    PatternRule("log-in pages", ("login",), r"/login([/?#.]|$)"),
    PatternRule("log-out links", ("logout",), r"/logout([/?#.]|$)"),
    PatternRule("loans by the day", ("payday", "loans"), r"payday-loans"),
    PatternRule("malware downloads", ("exe",), r"\.exe([?#]|$)"),
    PatternRule("password resets", ("password", "reset"), r"/password[/-]reset([/?#]|$)"),
    PatternRule("phishing mirrors", ("secure", "verify", "account"), r"secure[.-].*verify[.-]account"),
    PatternRule("pill shops", ("cheap", "pills"), r"://([^/?#]*\.)?cheap-pills\."),
    PatternRule("pixel beacons", ("pixel", "gif"), r"/pixel\.gif([?#]|$)"),
    PatternRule("poker rooms", ("poker",), r"://([^/?#]*[.-])?poker[.-]"),
    PatternRule("pop-unders", ("popunder",), r"/popunder([/.?#]|$)"),
    PatternRule("printed views", ("print", "1"), r"[?&]print=1([&#]|$)"),
    PatternRule("replica watches", ("replica", "watches"), r"replica-watches"),
    PatternRule("session links", ("sessionid",), r"[?&]sessionid="),
    PatternRule("session links of servlets", ("jsessionid",), r";jsessionid="),
    PatternRule("shell archives", ("sh", "run"), r"\.run\.sh([?#]|$)"),
    PatternRule("sorted listings", ("sort", "order"), r"[?&]sort=[^&#]*&order="),
    PatternRule("spam farms", ("spam",), r"://([^/?#]*[.-])?spam[.-]"),
    PatternRule("torrents", ("torrent",), r"\.torrent([?#]|$)"),
    PatternRule("trackers", ("track", "click"), r"/track/click([/?#]|$)"),
    PatternRule("video hosts for adults", ("porn",), r"://([^/?#]*[.-])?porn[.-]"),
    PatternRule("wish lists", ("wishlist",), r"/wishlist([/?#]|$)"),
)
ASCII_LOWER = (string.ascii_uppercase, string.ascii_lowercase)
BROADCAST_RULES = 100_000  #: most rules (some 20 MB) that are broadcast
BROADCAST_URLS = 100_000  #: most matching URLs that are broadcast on the way back


def rule_table(spark: SparkSession, rules: tuple[PatternRule, ...] = PATTERN_RULES) -> DataFrame:
    """Rules as a table: name, tokens, pattern."""
    if not rules:
        return spark.range(0).select(F.lit("").alias("name"), F.array(F.lit("")).alias("tokens"), F.lit("").alias("pattern"))
    held = [F.struct(F.lit(r.name).alias("name"), F.array(*map(F.lit, r.tokens)).alias("tokens"), F.lit(r.pattern).alias("pattern")) for r in rules]
    return spark.range(1).select(F.inline(F.array(*held)))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from a tab-separated file with a header: name, tokens with blanks between, pattern."""
    read = spark.read.csv(path, sep="\t", header=True, quote="", schema="name string, tokens string, pattern string")
    return read.withColumn("tokens", F.split("tokens", " +"))


def lowered(c: Column) -> Column:
    return F.translate(c, *ASCII_LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(lowered(host), F.lit("")), F.coalesce(path, F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct lower-case runs of ASCII letters and digits."""
    return F.array_distinct(F.filter(F.split(lowered(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"), lambda t: t != ""))


def rule_index(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """token, name, pattern of the rules, each under the one of its tokens that is rarest in the URLs (ties: first in the alphabet)."""
    sound = F.forall("tokens", lambda t: t.rlike("^[a-z0-9]+$")) & (F.size("tokens") > 0)
    checked = rules.withColumn("tokens", F.when(sound, F.col("tokens")).otherwise(F.raise_error(F.concat(F.lit("rule without literal tokens of letters and digits: "), "name"))))
    wanted = checked.select("name", "pattern", F.explode("tokens").alias("token"))
    asked = wanted.select("token").distinct()
    tokens = pages.select(F.explode(url_tokens(F.col(url_col))).alias("token"))
    if asked.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        counts = tokens.join(F.broadcast(asked), "token").groupBy("token").agg(F.count("*").alias("n"))
    else:  # counted before they meet, so that a token of most URLs is one row a task
        counts = tokens.groupBy("token").agg(F.count("*").alias("n")).join(asked, "token")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))
    return wanted.join(counts, "token", "left").groupBy("name", "pattern").agg(rarest.alias("r")).select("r.token", "name", "pattern")


def _token_join(tokens: DataFrame, by_token: DataFrame) -> DataFrame:
    """Rows of `tokens` with those of `by_token`, which may hold a token more than once."""
    if by_token.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        return tokens.join(F.broadcast(by_token), "token")
    packed = by_token.groupBy("token").agg(F.collect_list(F.struct("*")).alias("held"))
    spread = next((c for c in tokens.columns if c != "token"), "token")
    joined = spread_join(tokens, packed, "token", spread, broadcast_rows=0)
    rest = [c for c in by_token.columns if c != "token"]
    return joined.select(*tokens.columns, F.explode("held").alias("h")).select(*tokens.columns, *[f"h.{c}" for c in rest])


def matching_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """low (a lower-cased url) and pattern_rule, the first name of the rules that match it, of the URLs that any rule matches."""
    index = stored(rule_index(pages, rules, url_col), "rules")
    tokens = pages.select(lowered(F.col(url_col)).alias("low"), F.explode(url_tokens(F.col(url_col))).alias("token"))
    fetched = _token_join(tokens, index)
    return fetched.where(F.call_function("rlike", "low", "pattern")).groupBy("low").agg(F.min("name").alias("pattern_rule"))


def host_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = HOST_RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    ranked = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[1], r[2]))
    chosen = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in reversed(ranked):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        chosen = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def judge(pages: DataFrame, rules: DataFrame | None = None, host_rules: tuple[tuple[str, str, str], ...] = HOST_RULES, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule, pattern_rule and verdict. rules: name, tokens, pattern; the default ones if not given."""
    made = ("host", "path", "rule", "pattern_rule", "verdict")
    own = [c for c in pages.columns if c not in made]
    found = stored(matching_urls(pages, rule_table(pages.sparkSession) if rules is None else rules, url_col), "matching").withColumnsRenamed({"low": "_low", "pattern_rule": "_pattern_rule"})
    host, path = host_and_path(F.col(url_col))
    # null URLs get distinct keys: they match nothing and must not meet in one task
    key = F.coalesce(lowered(F.col(url_col)), F.concat(F.lit("\n"), F.xxhash64(*own).cast("string")))
    split = pages.select(*own, host.alias("host"), path.alias("path"), key.alias("_low"))
    joined = spread_join(split.withColumn("_at", F.xxhash64(*own)), found, "_low", "_at", "left", BROADCAST_URLS)
    fit = joined.withColumn("_fit", host_rule(F.col("host"), F.col("path"), host_rules))
    verdict = F.coalesce("_fit.verdict", F.when(F.col("_pattern_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return fit.select(*own, "host", "path", F.col("_fit.rule").alias("rule"), F.col("_pattern_rule").alias("pattern_rule"), verdict.alias("verdict"))
