"""URL filter: a blocked Bloom filter of listed URLs in front of an exact hash join.

DataFrame and SQL functions only. A rule lists a host and a path start. Each
distinct page (host, path) has one candidate key for every host suffix and
every listed path length; the filter drops nearly all keys that are not
listed, the hash join decides the rest exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits set for a key, all inside one 64-bit block.
PROBES = 6
#: Listed keys per block: 64 bits / 5 keys, about 12 bits for a key.
KEYS_PER_BLOCK = 5
#: A filter of up to so many blocks (16 bytes each) is broadcast, a larger one is joined by shuffle.
BROADCAST_BLOCKS = 1 << 21


def split_url(url) -> tuple:
    """(host, path) columns of a url: host lower-cased (A-Z), both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _block(key, blocks: int):
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key):
    """PROBES bits of one 64-bit word, from independent 6-bit fields of a second hash."""
    h = F.xxhash64(key, F.lit(0x5BD1E995))
    out = F.lit(0).cast("long")
    for i in range(PROBES):
        bit = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return out


def build_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, word) rows of the filter: words of equal blocks are or-ed map-side first."""
    return keys.select(_block("key", blocks).alias("block"), _mask("key").alias("word")).groupBy("block").agg(F.bit_or("word").alias("word"))


def possible(candidates: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """Candidates (column ``key``) whose bits are all set; never loses a listed key."""
    if blocks <= BROADCAST_BLOCKS:
        bloom = F.broadcast(bloom)
    return (
        candidates.withColumns({"block": _block("key", blocks), "_mask": _mask("key")})
        .join(bloom, "block")
        .where(F.col("word").bitwiseAND(F.col("_mask")) == F.col("_mask"))
        .drop("block", "_mask", "word")
    )


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Every row of ``pages`` with host, path, rule and verdict columns.

    ``rules``: host, path (its start), verdict. A rule fits its host and all
    subdomains when the page's path starts with the rule's; the longest rule
    (host and path together, ties: longer host, then text) wins. Without a
    rule: null and ``default``. Null or malformed urls have empty host and
    path. Rules with null fields are ignored, repeated ones count once (a
    contradiction: block). Columns of pages named host, path, rule or verdict
    are replaced; all others stay.
    """
    rules = (
        rules.where("host is not null and path is not null and verdict is not null")
        .select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), "verdict")
        .groupBy("r_host", "r_path").agg(F.max("verdict").alias("r_verdict"))
        .withColumn("key", F.concat("r_host", F.lit("\n"), "r_path"))
    )
    n, lengths = rules.agg(F.count("*"), F.collect_set(F.length("r_path"))).first()  # a path length is bounded by urls
    blocks = max(1, -(-n // KEYS_PER_BLOCK))
    host, path = split_url(F.col(url))
    named = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    distinct = named.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    sizes = F.filter(F.array(*[F.lit(x) for x in sorted(lengths)]) if lengths else F.expr("cast(array() as array<int>)"), lambda x: x <= F.length("path"))
    candidates = (
        distinct.withColumn("suffix", F.explode(suffixes))
        .withColumn("size", F.explode(sizes))
        .select("host", "path", F.concat("suffix", F.lit("\n"), F.expr("substr(path, 1, size)")).alias("key"))
    )
    best = (
        possible(candidates, build_filter(rules, blocks), blocks)
        .join(rules, "key")
        .groupBy("host", "path")
        .agg(F.max(F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), F.concat("r_host", "r_path").alias("rule"), "r_verdict")).alias("best"))
    )
    return (
        named.join(best, ["host", "path"], "left")
        .withColumns({"rule": F.col("best.rule"), "verdict": F.coalesce("best.r_verdict", F.lit(default))})
        .drop("best")
    )
