"""URL filters in DataFrame functions only: host and path rules, then a list of canonical URLs.

The rules are compiled to one CASE expression, the longest first. The list is
kept as a blocked Bloom filter: a block of eight 32-bit words for each 32 URLs,
of which a URL sets one bit a word. URLs that pass it are looked up in the list
itself by a hash join, so that a false positive has no effect. The filter is
broadcast only up to BROADCAST_BLOCKS blocks, and joined by block beyond.

Cases: a url that is null or has no `://` has an empty host and path, fits no
rule and is never listed. Repeated rows each get the verdict. An empty list or
table is allowed.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
WORDS = 8
URLS_PER_BLOCK = 32
#: 40 bytes each: 5 MB at most.
BROADCAST_BLOCKS = 1 << 17


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www. or m., and path without a last slash or .html; null without a host."""
    short = F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html|/)$", ""))
    return F.when(host != "", short)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(name of the longest rule that fits, its verdict), null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for does, on, under in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(under)
        name, verdict = F.when(fits, F.lit(on + under)).otherwise(name), F.when(fits, F.lit(does)).otherwise(verdict)
    return name, verdict


def _masks() -> list[str]:
    """SQL of the bit that `url` sets in each word."""
    return [f"shiftleft(1, cast(shiftright(xxhash64(url, {seed}) & 4294967295, 27) as int))" for seed in range(1, WORDS + 1)]


def bloom_filter(listed: DataFrame) -> tuple[DataFrame, int]:
    """((block, w0 ... w7), number of blocks) of rows (url)."""
    blocks = max(1, -(-listed.count() // URLS_PER_BLOCK))
    masks = listed.select(F.pmod(F.xxhash64("url"), F.lit(blocks)).alias("block"), *[F.expr(m).alias(f"w{i}") for i, m in enumerate(_masks())])
    return masks.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), blocks


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict; listed: rows (url) of canonical URLs to block where no rule fits."""
    host, path = host_of(F.col(f"`{url}`")), path_of(F.col(f"`{url}`"))
    rows = pages.select(F.struct("*").alias("page"), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", name.alias("rule"), verdict.alias("ruled"), F.when(name.isNull(), canonical(F.col("host"), F.col("path"))).alias("url"))
    listed = listed.where("url is not null").select("url").distinct()
    blooms, blocks = bloom_filter(listed)
    blooms = F.broadcast(blooms) if blocks <= BROADCAST_BLOCKS else blooms
    # rows that need no look-up get blocks that don't exist, so that they aren't one key of the join
    none = -1 - F.pmod(F.monotonically_increasing_id(), F.lit(blocks))
    rows = rows.withColumn("block", F.when(F.col("url").isNull(), none).otherwise(F.pmod(F.xxhash64("url"), F.lit(blocks)))).join(blooms, "block", "left")
    passes = F.coalesce(F.expr(" and ".join(f"(w{i} & {m}) != 0" for i, m in enumerate(_masks()))), F.lit(False)) & F.col("url").isNotNull()
    rows = rows.select("page", "host", "path", "rule", "ruled", "url", passes.alias("possible"))
    hits = rows.where("possible").join(listed.withColumn("listed", F.lit(True)), "url", "left")
    others = rows.where("not possible").withColumn("listed", F.lit(False))
    both = hits.unionByName(others)
    kept = [F.col(f"page.`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    final = F.coalesce("ruled", F.when(F.coalesce("listed", F.lit(False)), "block").otherwise("allow"))
    return both.select(*kept, "host", "path", "rule", final.alias("verdict"))

