"""URL filter, in DataFrame functions only: rules by host and path, then a list of URLs.

URLs that no rule decides are looked up in a list of canonical URLs. The list
makes a blocked Bloom filter: a URL's hash names one block of 256 bits, and a
second hash sets two bits in each of the block's four words. The filter's blocks
are rows of bounded number, so they go to every task; a page whose bits are all
set is a possible hit. Possible hits meet the list itself in a hash join on the
canonical URL, which removes the false positives.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, table

WORDS = 4
#: Bits of the filter for each listed URL, and blocks of 256 bits at most (a row of 40 bytes each). Longer lists fill the filter
#: more densely: more pages reach the exact join, and the result stays the same.
BITS_A_URL, MAX_BLOCKS = 16, 1 << 20
#: A canonical URL of more possible hits than this share of them, and than HOT_LEAST, is decided without a shuffle: 1,000 of them at most.
HOT_SHARE, HOT_LEAST = 0.001, 500

# fixed values: the rules of the contract, and what the list is made of
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
SPAM_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid)(=|\z)"
#: A page is junk if marks like %%% make up over a twentieth of its characters.
JUNK_MARK, JUNK_TIMES = r"[#$%*]{3}", 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


class Parts(NamedTuple):
    host: Column
    path: Column
    query: Column


def parts_of(url: Column) -> Parts:
    """Host (A-Z in lower case), path and query; all empty for null and where :// is missing."""
    known = F.contains(url, F.lit("://"))
    rest = F.when(known, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return Parts(
        F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
        F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1),
    )


def canonical(url: Column) -> Column:
    """One text for all ways to write a URL; null for null and where :// is missing.

    Scheme, fragment, www. and m., the default ports, tracking parameters, the
    slash and the .html at the end go; the other parameters are sorted.
    """
    p = parts_of(url)
    host = F.regexp_replace(F.regexp_replace(p.host, r"^(www|m)\.", ""), r":(80|443)\z", "")
    path = F.regexp_replace(F.regexp_replace(p.path, r"/+\z", ""), r"\.html\z", "")
    kept = F.array_sort(F.filter(F.split(p.query, "&"), lambda q: (q != "") & ~q.rlike(TRACKING)))
    return F.when(F.contains(url, F.lit("://")), F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def fitting(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (of two, the one of the longer host); null without one."""
    text = verdict = None
    for r in sorted(map(Rule._make, rules), key=lambda r: (-len(r.host + r.path), -len(r.host), r.host, r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, r.host + r.path) if text is None else text.when(fits, r.host + r.path)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, verdict)


def _bits(key: Column) -> list[Column]:
    """Two bits for each word of the block, from the second hash."""
    h = F.xxhash64(key, F.lit("bits"))
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * n).bitwiseAND(F.lit(63)).cast("int"))
    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(WORDS)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block")


def bloom_filter(keys: DataFrame, column: str, n: int, *, bits: int = BITS_A_URL, max_blocks: int = MAX_BLOCKS) -> tuple[DataFrame, int]:
    """Rows (block, w0 .. w3) of the blocks that have a bit set, and the number of blocks, for n keys."""
    blocks = min(max(1, -(-n * bits // (64 * WORDS))), max_blocks)
    set_ = keys.select(_block(F.col(column), blocks), *[m.alias(f"w{i}") for i, m in enumerate(_bits(F.col(column)))])
    return set_.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), blocks


def possible_hits(rows: DataFrame, column: str, blocks_of: DataFrame, blocks: int) -> DataFrame:
    """rows with maybe: whether the filter has all bits of the column. Its blocks, MAX_BLOCKS at most, go to every task."""
    names = [f"w{i}" for i in range(WORDS)]
    mask = [f"m{i}" for i in range(WORDS)]
    asked = rows.select("*", _block(F.col(column), blocks), *[m.alias(c) for m, c in zip(_bits(F.col(column)), mask, strict=True)])
    met = asked.join(F.broadcast(blocks_of), "block", "left")
    full = F.lit(True)
    for w, m in zip(names, mask, strict=True):
        full = full & (F.col(w).bitwiseAND(F.col(m)) == F.col(m))
    return met.withColumn("maybe", F.coalesce(full & F.col(column).isNotNull(), F.lit(False))).drop("block", *names, *mask)


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, *, id_col: str = "page_id", url_col: str = "url", listed_col: str = "url", bits: int = BITS_A_URL, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """page_id, host, path, rule, verdict, canonical and maybe (the filter's word, before the exact join) of every page.

    rules are (allow or block, host, path), a short list: they become one
    expression. Pages that no rule decides are blocked if the canonical form of
    their URL is that of a URL in listed, and allowed otherwise. A URL that is
    null or without :// has an empty host and path, no canonical form, and is
    allowed. Null ids are kept, repeated rows each get a row, other columns are
    not read. An empty list blocks nothing; an empty table gives no rows.
    """
    known = materialise(listed.select(canonical(F.col(f"`{listed_col}`")).alias("canonical")).where(F.col("canonical").isNotNull()).distinct())
    url = F.col(f"`{url_col}`")
    p = parts_of(url)
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), p.host.alias("host"), p.path.alias("path"), canonical(url).alias("canonical"))
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "canonical")
    rows = rows.withColumn("asked", F.when(F.col("rule").isNull(), F.col("canonical")))
    rows = materialise(possible_hits(rows, "asked", *bloom_filter(known, "canonical", known.count(), bits=bits, max_blocks=max_blocks)).drop("asked"))
    hits, rest = rows.where("maybe"), rows.where("not maybe")
    # each canonical URL once, with its pages counted, meets the list
    counted = hits.groupBy("canonical").agg(F.count("*").alias("n"))
    judged = materialise(counted.join(known.select("canonical", F.lit(True).alias("on_list")).hint("shuffle_hash"), "canonical", "left"))
    often = max(HOT_LEAST, HOT_SHARE * (judged.agg(F.sum("n")).first()[0] or 0))
    listed_now = F.coalesce("on_list", F.lit(False)).alias("on_list")
    hot = judged.where(F.col("n") > often).select("canonical", listed_now)
    cold = judged.where(F.col("n") <= often).select("canonical", listed_now)
    by_hot = hits.join(F.broadcast(hot), "canonical", "left")
    decided = by_hot.where(F.col("on_list").isNotNull()).unionByName(by_hot.where(F.col("on_list").isNull()).drop("on_list").join(cold.hint("shuffle_hash"), "canonical"))
    decided = decided.withColumn("verdict", F.when(F.col("on_list"), "block").otherwise("allow")).drop("on_list")
    out = rest.withColumn("verdict", F.coalesce("verdict", F.lit("allow"))).unionByName(decided)
    return out.select("page_id", "host", "path", "rule", "verdict", "canonical", "maybe")


def reported(pages: DataFrame) -> DataFrame:
    """The list that a corpus gives by itself: URLs of pages on hosts of spam names, and of pages full of junk marks.

    Other pages under the same canonical URL are then blocked with them.
    """
    spam = F.lit(False)
    for name in SPAM_NAMES:
        spam = spam | F.contains(F.concat(F.lit("."), parts_of(F.col("url")).host), F.lit(f".{name}."))
    html = F.coalesce("html", F.lit(""))
    junk = (F.length(html) - F.length(F.regexp_replace(html, JUNK_MARK, ""))) * JUNK_TIMES > F.length(html)
    return pages.where(spam | junk).select("url")


def op12_blocked_bloom_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, reported(pages)).select("page_id", "host", "path", "rule", "verdict", "canonical")


SQL = r"""
WITH cut AS (
  SELECT page_id, url, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, url, html,
    translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(coalesce(rest, ''), '^[^?#]*\?([^#]*)', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[^=]*|ref|gclid|fbclid)(=|\z)'))) AS kept
  FROM cut
), named AS (
  SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)\z', '')
    || regexp_replace(regexp_replace(path, '/+\z', ''), '\.html\z', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical
  FROM parts
), listed AS (
  SELECT DISTINCT canonical FROM named
  WHERE canonical IS NOT NULL AND (regexp_matches('.' || host, '\.(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)\.')
    OR (length(coalesce(html, '')) - length(regexp_replace(coalesce(html, ''), '[#$%*]{3}', '', 'g'))) * 20 > length(coalesce(html, '')))
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), ruled AS (
  SELECT n.page_id, n.host, n.path, n.canonical,
    (SELECT max_by({'rule': rule_host || rule_path, 'verdict': verdict}, length(rule_host || rule_path)) FROM rules
      WHERE (n.host = rule_host OR ends_with(n.host, '.' || rule_host)) AND starts_with(n.path, rule_path)) AS r
  FROM named n
)
SELECT page_id, host, path, r.rule AS rule,
  coalesce(r.verdict, CASE WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict, canonical
FROM ruled
"""
