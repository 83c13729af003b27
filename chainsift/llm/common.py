"""Helpers shared by the operators: stored intermediates, word hashing in NumPy, connected components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainsift.session import sub_dir

#: Odd base of the polynomial hash modulo 2**64; every power has an inverse.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POW: dict[str, np.ndarray] = {}


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared work folder and read it back: cuts lineage, survives lost executors."""
    path = new_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder name in the shared work folder."""
    return sub_dir(spark, "llm", f"{tag}-{uuid.uuid4().hex[:12]}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n (modulo 2**64), kept until ``release``."""
    have = _POW.get("p")
    if have is None or len(have) < n:
        size = max(n + 65_535 >> 16, 1) << 16
        inv = np.uint64(pow(int(BASE), -1, 1 << 64))
        for key, b in (("p", BASE), ("i", inv)):
            out = np.full(size, b, np.uint64)
            out[0] = 1
            _POW[key] = np.multiply.accumulate(out)
    return _POW["p"][:n], _POW["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift and multiply), a bijection on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODE = mix(np.arange(1, 257, dtype=np.uint64))


def prefix_hash(data: np.ndarray, code: np.ndarray = _CODE) -> np.ndarray:
    """Polynomial prefix sums of a byte array: P[i] covers data[:i]; see ``span_hash``."""
    return prefix_sums(code[data])


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """As ``prefix_hash``, of an array of 64-bit values."""
    p, _ = _powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[: len(values)], out=out[1:])
    return out


def stable_order(key: np.ndarray) -> np.ndarray:
    """Stable argsort of keys from 0 on: key and place fit one 64-bit number, whose plain sort is much faster."""
    n = len(key)
    bits = max(1, int(n - 1).bit_length())
    if n == 0 or int(key.max()).bit_length() + bits > 63:
        return np.argsort(key, kind="stable")
    return np.sort((key.astype(np.int64) << bits) | np.arange(n)) & ((1 << bits) - 1)


def distinct(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``np.unique`` of 64-bit numbers from 0 on with first places and inverse, by one plain sort of numbers and places.

    Hashes leave no room for the places: these take the lower bits, and where
    different hashes agree in the upper ones, the slower way is taken.
    """
    n, value = len(value), value.astype(np.uint64, copy=False)
    bits = max(1, int(n - 1).bit_length())
    place = np.uint64((1 << bits) - 1)
    key = value << np.uint64(bits) if n and int(value.max()).bit_length() + bits <= 64 else value & ~place
    both = np.sort(key | np.arange(n, dtype=np.uint64))
    order = (both & place).view(np.int64)
    ranked = value[order]
    new = np.ones(n, bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if np.count_nonzero(new[1:]) != np.count_nonzero((both[1:] ^ both[:-1]) > place):
        return np.unique(value, return_index=True, return_inverse=True)
    first = np.flatnonzero(new)
    inverse = np.empty(n, np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ranked[first], order[first], inverse


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for arrays of positions, equal for equal bytes at any place."""
    _, inv = _powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start] + mix((end - start).astype(np.uint64)))


def window_hash(prefix: np.ndarray, size: int) -> np.ndarray:
    """``span_hash`` of every ``size`` consecutive entries."""
    n = max(0, len(prefix) - size)
    _, inv = _powers(len(prefix))
    return mix((prefix[size:] - prefix[:n]) * inv[:n] + mix(np.array([size], np.uint64)))


def flat_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without copying; null is the empty text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]: off[-1]] if len(off) else raw, off - off[0]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Word separators: space and the controls from tab to carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text) of the words of many texts; see ``words``."""
    solid = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True  # a text border splits a word
    start = solid.copy()
    if len(raw):
        start[1:] &= ~solid[:-1] | edge[1:-1]
    starts = np.flatnonzero(start)
    end = solid.copy()
    if len(raw):
        end[:-1] &= ~solid[1:] | edge[1:-1]
    ends = np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def words(raw: np.ndarray, off: np.ndarray):
    """Words of many texts at once: (hash, start, end, first word of each text).

    A-Z is lower-cased; a word is a run without the six separators. ``first``
    has one more entry than there are texts, so text t owns words
    ``first[t]:first[t + 1]``.
    """
    starts, ends, first = word_spans(raw, off)
    return span_hash(prefix_hash(_LOWER[raw]), starts, ends), starts, ends, first


def shingle_hashes(word: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words (array shorter by k - 1; empty if there are fewer)."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + word[j: j + n])
    return out


def release() -> None:
    """Gives memory that Python has freed back to the system: a worker process serves one stage after the other and keeps it otherwise."""
    import ctypes

    import pyarrow as pa

    _POW.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def batches(record_batch, limit: int = 1 << 20):
    """Cut an Arrow batch into slices of about ``limit`` text bytes (column ``text``), at least one row each; frees memory after the last."""
    import pyarrow.compute as pc

    n = record_batch.num_rows
    if n == 0:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(record_batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        done = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, done + limit, side="right")))
        yield record_batch.slice(at, to - at)
        at = to
    release()


#: A list of ids up to this length is broadcast (about 32 MB), a longer one is joined by shuffle.
BROADCAST_IDS = 1 << 20


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not in ``ids``; rows with null doc_id stay."""
    ids = stored(ids.select("doc_id").where("doc_id is not null").distinct(), "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(*docs.columns)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of long pairs: (id, component = smallest id reachable).

    Large-star and small-star steps alternate until nothing changes (about
    log2 of the diameter rounds). Each round aggregates minima map-side, is
    written to the shared folder, and only its row count and checksum reach
    the driver. Self pairs and nulls are ignored; an empty input gives an
    empty result.
    """
    e = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u > v").distinct()
    e, last = stored(e, "edges"), None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == last:
            break
        last = state
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
