"""URL filters: rules by host and path, and a blocked Bloom filter before an exact join with listed URLs.

The filter has blocks of eight 64-bit words; a URL's first hash picks its block, and eight slices of the second
pick a bit in each word. The blocks are an ordinary table made by ``bit_or``. URLs that miss a bit are not
listed; the few others meet the list in a hash join, which removes the false positives.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm.common import read
from rollbook.operators.joins import left_join

# Verdict, host and path of each rule.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Names in a host whose pages make the list of blocked URLs of the registered query.
SPAM_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")

WORDS = 8
#: Bits of the filter for each listed URL; with eight bits set, about one URL in 2,000 passes by chance.
BITS_PER_URL = 16
#: Blocks (64 bytes each) that may be broadcast; a larger filter is joined like any table.
BROADCAST_BLOCKS = 1 << 16

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without closing slashes, query without tracking fields; null without a host."""
    host, path, query = host_of(url), path_of(url), F.coalesce(F.regexp_extract(url, PARTS, 3), F.lit(""))
    kept = F.array_join(F.filter(F.split(query, "&"), lambda q: ~q.rlike("^(utm_[a-z]+|ref)=") & (q != "")), "&")
    whole = F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(host != "", whole)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], result) -> Column:
    """``result`` of the longest rule that fits, null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    fits = lambda r: ((host == r[1]) | host.endswith(f".{r[1]}")) & path.startswith(r[2])
    return F.coalesce(*[F.when(fits(r), F.lit(result(r))) for r in ordered], F.lit(None).cast("string"))


def bits(key: Column) -> list[Column]:
    """The bit of a key in each word of its block."""
    second = F.xxhash64(key, F.lit(1))
    return [F.shiftright(second, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]


def one_at(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)


def bloom(listed: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """The filter as a table: ``_block`` and its words."""
    block = F.pmod(F.xxhash64(key), F.lit(n_blocks)).alias("_block")
    words = [one_at(b).alias(f"_w{i}") for i, b in enumerate(bits(F.col(key)))]
    return listed.select(block, *words).groupBy("_block").agg(*[F.bit_or(f"_w{i}").alias(f"_w{i}") for i in range(WORDS)])


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    url: str = "url",
    carry: Sequence[str] = ("page_id",),
    rules: Sequence[tuple[str, str, str]] = RULES,
    listed_url: str = "url",
) -> DataFrame:
    """Host, path, rule and verdict of each URL; without a rule, listed URLs are blocked and others allowed.

    One row per row of ``pages``: the ``carry`` columns (but those named like a result), ``host``, ``path``, ``rule``,
    ``verdict`` and ``listed``. A null URL and one without ``://`` have an empty host and path, fit no rule, are
    never listed, and so are allowed. Repeated rows are each judged alike, an empty list blocks nothing, and other
    columns are ignored. The list is counted first: its size sets that of the filter.
    """
    made = ("host", "path", "rule", "verdict", "listed")
    kept = [c for c in carry if c not in made]
    names = listed.select(canonical(F.col(listed_url)).alias("_key")).filter("_key is not null").distinct()
    n_blocks = max(1, 1 << max(0, (names.count() * BITS_PER_URL // (64 * WORDS)).bit_length()))
    blocks = bloom(names, "_key", n_blocks)
    address = F.col("_url")
    judged = (
        pages.select(*kept, F.col(url).alias("_url"))
        .withColumns({"host": host_of(address), "path": path_of(address), "_key": canonical(address)})
        .withColumns({
            "rule": rule_of(F.col("host"), F.col("path"), rules, lambda r: r[1] + r[2]),
            "_said": rule_of(F.col("host"), F.col("path"), rules, lambda r: r[0]),
            "_block": F.pmod(F.xxhash64("_key"), F.lit(n_blocks)),
        })
    )
    if n_blocks <= BROADCAST_BLOCKS:
        met = judged.join(F.broadcast(blocks), "_block", "left")
    else:
        met = left_join(judged, blocks, ["_block"])
    passes = [F.col(f"_w{i}").bitwiseAND(one_at(b)) != 0 for i, b in enumerate(bits(F.col("_key")))]
    maybe = F.coalesce(F.col("_key").isNotNull() & reduce(lambda a, b: a & b, passes), F.lit(False))
    met = met.withColumn("_maybe", maybe).select(*kept, "host", "path", "rule", "_said", "_key", "_maybe")
    possible = left_join(met.filter("_maybe"), names.withColumn("_hit", F.lit(True)), ["_key"])
    others = met.filter("not _maybe").withColumn("_hit", F.lit(None).cast("boolean"))
    both = possible.select(*others.columns).unionAll(others)
    listed_now = F.coalesce(F.col("_hit"), F.lit(False))
    verdict = F.coalesce("_said", F.when(listed_now, F.lit("block")).otherwise(F.lit("allow")))
    return both.select(*kept, "host", "path", "rule", verdict.alias("verdict"), listed_now.alias("listed"))


def spam_pages(pages: DataFrame) -> DataFrame:
    """Pages whose host has a name of a spam site: their URLs are the list of the registered query."""
    return pages.filter(host_of(F.col("url")).rlike(rf"(^|\.)({'|'.join(SPAM_NAMES)})\."))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return filter_urls(pages, spam_pages(pages))


def _rule_sql(result: str) -> str:
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    says = {"rule": lambda r: r[1] + r[2], "verdict": lambda r: r[0]}[result]
    cases = " ".join(f"WHEN (host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}') THEN '{says(r)}'" for r in ordered)
    return f"CASE {cases} END"


ORACLE = rf"""
WITH parts AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*[^?#]*\?([^#]*)', 1, 's'), '') AS query
  FROM pages),
canon AS (
  SELECT *, array_to_string(list_filter(string_split(query, '&'),
              lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]+|ref)=')), '&') AS fields FROM parts),
keyed AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '')
              || CASE WHEN fields <> '' THEN '?' || fields ELSE '' END END AS key FROM canon),
ruled AS (SELECT *, {_rule_sql("rule")} AS rule, {_rule_sql("verdict")} AS said FROM keyed),
listing AS (SELECT DISTINCT key FROM keyed WHERE regexp_matches(host, '(^|\.)({'|'.join(SPAM_NAMES)})\.') AND key IS NOT NULL)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       l.key IS NOT NULL AS listed
FROM ruled r LEFT JOIN listing l ON r.key = l.key
"""
