"""URL filters in DataFrame expressions: rules indexed by their rarest literal token.

A rule's index token is the one among its whole literal tokens that the fewest URLs hold.  The index is a
constant array of buckets by the token's hash, so a URL's token finds its bucket by its place, however
many rules there are; only the rules of its tokens run their regular expressions.  Domain rules fit their
host and all subdomains where the path starts with the rule's; the longest wins.  Where none fits, host
words, path segments and file extensions decide: a URL that one of them fits is blocked, else allowed.

Cases: a null URL or one without ``://`` has an empty host and path and is allowed; repeated rows are
judged each, null ids like others; an empty table gives none; other columns are left out of the judgement
and of the result; a very long URL has as many look-ups as distinct tokens.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import column

DOMAIN, WORD, SEGMENT, EXTENSION = "domain", "word", "segment", "extension"


@dataclass(frozen=True)
class Rule:
    text: str
    action: str
    kind: str = DOMAIN

    @property
    def pattern(self) -> str:
        """For the host and path laid end to end."""
        literal = re.sub(r"([^A-Za-z0-9/ ])", r"\\\1", self.text)
        if self.kind == WORD:
            return f"^(?:[^/]*[.-])?{literal}(?:[.-][^/]*)?(?:/|$)"
        if self.kind == SEGMENT:
            return f"^[^/]*/(?:.*/)?{literal}(?:/|$)"
        if self.kind == EXTENSION:
            return f"^[^/]*/.*\\.{literal}$"
        return f"^(?:[^/]*\\.)?{literal}"

    @property
    def tokens(self) -> list[str]:
        """Tokens that every fitting URL holds whole; a domain rule's path may go on in the URL."""
        found = re.split(r"[./-]", self.text)
        return [t for t in (found[:-1] if self.kind == DOMAIN and "/" in self.text else found) if t]


DOMAIN_RULES = [
    Rule("com/en/", "block"),
    Rule("example.com/en/7", "allow"),
    Rule("net/de/", "block"),
    Rule("example.net/de/8", "block"),
    Rule("org/es/", "block"),
]
#: Words that mark a host as spam when they stand between dots or dashes.
SPAM_WORDS = [
    "bet", "bets", "betting", "bingo", "blackjack", "bookmaker", "casino", "casinos", "cialis", "escort", "escorts", "gambling", "hentai", "jackpot", "jackpots", "levitra", "loan", "loans", "lottery", "milf",
    "payday", "pharmacy", "pill", "pills", "poker", "porn", "porno", "replica", "replicas", "roulette", "slot", "slots", "sportsbook", "tramadol", "viagra", "wager", "warez", "xanax", "xxx",
]
#: Path segments of pages that hold no article: accounts, shops, feeds, searches.
SEGMENTS = [
    "account", "add-to-cart", "admin", "basket", "cart", "cgi-bin", "checkout", "forgot-password", "login", "logout", "my-account", "oembed", "password-reset", "register", "rss.xml", "search", "sign-in", "sign-up", "signin",
    "signup", "sitemap.xml", "unsubscribe", "wishlist", "wp-admin", "wp-login.php", "xmlrpc.php",
]
#: Extensions of files that are no pages.
EXTENSIONS = ["7z", "apk", "avi", "bin", "css", "dmg", "exe", "gif", "gz", "ico", "iso", "jpeg", "jpg", "js", "mkv", "mov", "mp3", "mp4", "msi", "png", "rar", "svg", "tar", "tgz", "wav", "webm", "webp", "wmv", "woff", "woff2", "zip"]
WORD_RULES = [Rule(w, "block", kind) for words, kind in ((SPAM_WORDS, WORD), (SEGMENTS, SEGMENT), (EXTENSIONS, EXTENSION)) for w in words]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _index(rules: list[Rule], counts: dict[str, int]) -> tuple[Column, int]:
    """A constant array of buckets of rules by their index token's hash, and the number of buckets."""
    size = 1 << max(1, (2 * len(rules) - 1).bit_length())
    buckets: list[list[tuple[str, Rule]]] = [[] for _ in range(size)]
    for r in rules:
        if not r.tokens:
            raise ValueError(f"rule {r.text!r} has no whole literal token")
        token = min(r.tokens, key=lambda t: (counts.get(t, 0), t))
        buckets[xxhash.xxh64_intdigest(token.encode(), seed=42) % size].append((token, r))  # Spark's xxhash64
    entry = lambda t, r: F.struct(*(F.lit(v).alias(n) for n, v in (("token", t), ("text", r.text), ("action", r.action), ("kind", r.kind), ("pattern", r.pattern))))
    empty = F.array().cast("array<struct<token:string,text:string,action:string,kind:string,pattern:string>>")
    return F.array(*(F.array(*(entry(t, r) for t, r in some)) if some else empty for some in buckets)), size


def judge(pages: DataFrame, rules: list[Rule] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict``; a scan of the URLs for the token counts and one for the verdicts, no shuffle of rows."""
    rules = DOMAIN_RULES + WORD_RULES if rules is None else rules
    host, path = host_and_path(column(pages, url_col).cast("string"))
    urls = pages.select(column(pages, id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("tokens", F.array_distinct(F.split(F.concat("host", "path"), "[./-]")))
    wanted = sorted({t for r in rules for t in r.tokens})
    counts = {}
    if wanted:  # a row for each rule token at most
        found = urls.select(F.explode(F.array_intersect("tokens", F.array(*map(F.lit, wanted)))).alias("t"))
        counts = {r["t"]: r["count"] for r in found.groupBy("t").count().collect()}
    table, size = _index(rules, counts)
    bucket = lambda t: F.get(table, F.pmod(F.xxhash64(t), F.lit(size)).cast("int"))
    fetched = F.flatten(F.transform("tokens", lambda t: F.filter(bucket(t), lambda r: r["token"] == t)))
    whole = F.concat("host", "path")
    urls = urls.withColumn("fits", F.filter(fetched, lambda r: F.rlike(whole, r["pattern"])))
    longest = F.array_max(F.transform(F.filter("fits", lambda r: r["kind"] == DOMAIN), lambda r: F.struct(F.length(r["text"]).alias("n"), r["text"].alias("text"), r["action"].alias("action"))))
    urls = urls.withColumn("best", longest).withColumn("word_hit", F.exists("fits", lambda r: r["kind"] != DOMAIN))
    verdict = F.coalesce(F.col("best.action"), F.when(F.col("word_hit"), "block").otherwise("allow"))
    return urls.select("page_id", "host", "path", F.col("best.text").alias("rule"), verdict.alias("verdict"))
