"""URL filter: rules by host and path, then a list of canonical URLs.

The list is looked up in two steps. A blocked Bloom filter (one 512-bit block a URL,
one bit in each of its eight 64-bit words) passes every listed URL and few others; an
exact hash join of what passed removes the false positives. The filter is a table of
blocks, built by a group-by. Its size follows from the number of listed URLs, so it is
broadcast only where that size is under a bound, and joined by block number otherwise.

Nulls, texts without "://" and empty hosts are never listed and fit no rule: allowed.
Repeated rows are judged alike. Other columns of the pages are kept, but for those
whose names the result takes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.llm.common import Scratch, lower_ascii

WORDS = 8
BLOCK_BYTES = 8 * WORDS
#: Bits of the filter for each listed URL; about 1 in 1,000 others passes.
BITS_PER_URL = 16
#: Largest filter, in bytes, that goes to every executor.
BROADCAST_BYTES = 8 << 20


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What follows the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without www. or m., path without .html and closing slashes; null without a host."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.html$", ""), r"/+$", "")
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), bare))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct of its text and verdict; null if none does."""
    fitting = F.lit(None).cast("struct<text:string,verdict:string>")
    for rule in sorted(rules, key=lambda rule: len(rule.text)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        fitting = F.when(
            fits, F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))
        ).otherwise(fitting)
    return fitting


def _masks(key: Column) -> list[Column]:
    """For each word of a block, the one bit that a key sets."""
    bits = F.xxhash64(key, F.lit("bits"))
    return [
        F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * k).bitwiseAND(63).cast("int"))
        for k in range(WORDS)
    ]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def blocks_for(listed: int) -> int:
    return max(1, -(-listed * BITS_PER_URL // (8 * BLOCK_BYTES)))


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7) of the keys in column `key`; a block without keys has no row."""
    masks = listed.select(
        _block(F.col("key"), blocks).alias("block"),
        *(mask.alias(f"m{k}") for k, mask in enumerate(_masks(F.col("key")))),
    )
    return masks.groupBy("block").agg(*(F.bit_or(f"m{k}").alias(f"w{k}") for k in range(WORDS)))


def at_every_task(n_listed: int) -> bool:
    """Whether the filter is small enough for each task to have all of it and pass URLs as it reads them."""
    return blocks_for(n_listed) * (BLOCK_BYTES + 8) <= BROADCAST_BYTES


def possible(keys: DataFrame, listed: DataFrame, n_listed: int) -> DataFrame:
    """The rows of `keys` whose `key` the filter passes: all listed ones and few others."""
    blocks = blocks_for(n_listed)
    bloom = bloom_filter(listed, blocks)
    if at_every_task(n_listed):
        bloom = F.broadcast(bloom)
    passes = F.lit(True)
    for k, mask in enumerate(_masks(F.col("key"))):
        passes = passes & (F.col(f"w{k}").bitwiseAND(mask) == mask)
    return keys.withColumn("block", _block(F.col("key"), blocks)).join(bloom, "block").where(passes).select(keys.columns)


def judge(pages: DataFrame, listed: DataFrame, rules: list[Rule]) -> DataFrame:
    """Pages with host, path, canonical URL, rule, listed and verdict.

    `listed` holds canonical URLs in column `key`; nulls and repeats in it are ignored.
    A small filter drops most URLs in the scan, before any shuffle; a large one, itself in
    many tasks, is asked once for each URL. Rows of one URL are looked up once in the list,
    so a very common URL weighs one row there.
    """
    keep = [c for c in pages.columns if c not in {"host", "path", "canonical_url", "rule", "listed", "verdict"}]
    parts = pages.select(*(F.col(f"`{c}`") for c in keep), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = parts.withColumn("canonical_url", canonical(F.col("host"), F.col("path")))

    scratch = Scratch(pages.sparkSession, "url-filter")
    listed = scratch.table(listed.select("key").where(F.col("key").isNotNull()).distinct(), "listed")
    n_listed = listed.count()
    keys = parts.select(F.col("canonical_url").alias("key")).where("key is not null")
    if not at_every_task(n_listed):
        keys = keys.distinct()
    hits = possible(keys, listed, n_listed).distinct().join(listed, "key", "left_semi")

    found = parts.join(
        hits.select(F.col("key").alias("canonical_url"), F.lit(True).alias("listed")), "canonical_url", "left"
    )
    rule = rule_of(F.col("host"), F.col("path"), rules)
    return (
        found.withColumn("listed", F.coalesce("listed", F.lit(False)))
        .select(
            *(F.col(f"`{c}`") for c in keep), "host", "path", "canonical_url",
            rule["text"].alias("rule"),
            "listed",
            F.coalesce(rule["verdict"], F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        )
    )
