"""Blocked Bloom filter as a table.

Rows are ``(block BIGINT, bits BIGINT)``, only blocks with a bit set. All k
bits of an address lie in one 64-bit block, so a probe is one lookup: the
blocks are broadcast up to a checked size and the events never move. Block and
bits come from the address's MD5, which every engine computes alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from chainsift.schemas import BLOOM_CAPACITY, BLOOM_ERROR

# Largest block table sent to every task (rows of 16 bytes); beyond it the probe is a shuffle join.
BROADCAST_MAX_BLOCKS = 4_000_000
# Bits of one block; an address sets at most ten (two hex digits of the digest each).
BLOCK_BITS = 64


def bloom_params(n: int = BLOOM_CAPACITY, p: float = BLOOM_ERROR) -> tuple[int, int]:
    """(m bits, k hashes) of the textbook optimum for n items at false-positive rate p."""
    m = math.ceil(-n * math.log(p) / (math.log(2) ** 2))
    k = max(1, round(m / n * math.log(2)))
    return m, k


def _block(col: Column, m: int) -> Column:
    """Block of an address: the digest's first 12 hex digits modulo the number of blocks."""
    first = F.conv(F.substring(F.md5(col.cast("binary")), 1, 12), 16, 10).cast("bigint")
    return first % F.lit(max(1, -(-m // BLOCK_BITS)))


def _mask(col: Column, k: int) -> Column:
    """k bits (repeats allowed) from the following digits, two for each bit."""
    digest, out = F.md5(col.cast("binary")), F.lit(0).cast("bigint")
    for i in range(min(k, (32 - 12) // 2)):
        bit = (F.conv(F.substring(digest, 13 + 2 * i, 2), 16, 10).cast("int") % BLOCK_BITS).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return out


def bloom_build(wl: DataFrame, m: int, k: int, col: str = "address") -> DataFrame:
    """A1: blocks of all members; partial ``bit_or`` per task before the shuffle."""
    return wl.select(_block(F.col(col), m).alias("block"), _mask(F.col(col), k).alias("bits")).groupBy("block").agg(F.bit_or("bits").alias("bits"))


def bloom_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Incremental add: OR of two block tables."""
    return a.unionByName(b).groupBy("block").agg(F.bit_or("bits").alias("bits"))


class BloomStore:
    """A stored filter that grows: versions ``<path>/v=<n>`` of the block table, and a small file that says which one counts.

    ``add`` writes the next version from the last one and the new members
    only, then makes it the one that counts by a rename; a job that dies
    before leaves the last version. Once the share of set bits passes that of
    a filter at its design size, the false-positive rate would pass the design
    rate: the filter is built anew for twice the items, from the member list
    that the caller gives for that (bits cannot be dealt out anew).
    """

    def __init__(self, spark, path: str, items: int = BLOOM_CAPACITY, p: float = BLOOM_ERROR):
        self.spark, self.path, self.p = spark, path.rstrip("/"), p
        self.first = {"version": 0, "items": items}

    def state(self) -> dict:
        import json

        from chainsift.session import filesystem

        fs, base = filesystem(self.path)
        try:
            with fs.open_input_stream(f"{base}/current.json") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return self.first

    def params(self) -> tuple[int, int]:
        return bloom_params(self.state()["items"], self.p)

    def bits(self) -> DataFrame:
        """The block table of the version that counts."""
        version = self.state()["version"]
        if not version:
            return self.spark.createDataFrame([], "block bigint, bits bigint")
        return self.spark.read.schema("block bigint, bits bigint").parquet(f"{self.path}/v={version}")

    def fill(self) -> float:
        """Share of the set bits, counted over the table."""
        m, _ = self.params()
        blocks = max(1, -(-m // BLOCK_BITS))
        return float(self.bits().agg(F.sum(F.bit_count("bits"))).first()[0] or 0) / (blocks * BLOCK_BITS)

    def _publish(self, table: DataFrame, items: int) -> None:
        from chainsift.operators.store import _put
        from chainsift.session import filesystem

        version = self.state()["version"] + 1
        table.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        fs, base = filesystem(self.path)
        _put(fs, f"{base}/current.json", {"version": version, "items": items})

    def add(self, members: DataFrame, everyone: DataFrame | None = None, col: str = "address") -> None:
        """OR the bits of ``members`` in; ``everyone`` (all members, these too) is read only when the filter has to grow."""
        m, k = self.params()
        self._publish(bloom_merge(self.bits(), bloom_build(members, m, k, col)), self.state()["items"])
        design = 1 - math.exp(-k * self.state()["items"] / m)
        items = self.state()["items"]
        while everyone is not None and self.fill() > design:
            items *= 2
            m, k = bloom_params(items, self.p)
            self._publish(bloom_build(everyone, m, k, col), items)
            design = 1 - math.exp(-k * items / m)


def bloom_prefilter(events: DataFrame, bits: DataFrame, m: int, k: int, col: str = "user", size: int | None = None) -> DataFrame:
    """Events whose user may be a member (no false negatives); the log is read once and events stay where they are.

    ``size``: number of blocks, if known; else it is bounded by m / 64, or
    counted where that bound is too large to tell.
    """
    if size is None:
        size = -(-m // BLOCK_BITS)
        if size > BROADCAST_MAX_BLOCKS:
            size = bits.count()
    if size <= BROADCAST_MAX_BLOCKS:
        bits = F.broadcast(bits)
    hashed = events.withColumns({"_block": _block(F.col(col), m), "_mask": _mask(F.col(col), k)})
    b = bits.select(F.col("block").alias("_b"), F.col("bits").alias("_bits"))
    hit = (F.col("_block") == F.col("_b")) & (F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"))
    return hashed.join(b, hit, "left_semi").drop("_block", "_mask")


def bloom_members(values: DataFrame, bits: DataFrame, m: int, k: int, col: str = "user") -> DataFrame:
    """Distinct values whose k bits are all set."""
    return bloom_prefilter(values.select(col).distinct(), bits, m, k, col)
