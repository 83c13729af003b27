"""Token ids in wavelet-matrix shards.

A shard file holds the ids of consecutive documents as bit planes. Each plane
is cut into blocks, compressed one by one, with the number of ones before
every block as rank directory, so that access, rank, select, counting and
occurrence lookup open only the blocks they touch.

Layout, little-endian: magic ``WVMX1``, uint32 header size, JSON header
(n, bits, zeros per plane, block positions by plane, ones before each block,
place of the document table), the compressed blocks, and the compressed
document table (doc_id or null, number of ids).
"""

from __future__ import annotations

import functools
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainsift.llm.common import batches, new_dir, stored
from chainsift.llm.pretokens import WordCache, encode_texts
from chainsift.session import filesystem

MAGIC = b"WVMX1"
#: Bits in one compressed block of a plane.
BLOCK_BITS = 1 << 19
#: A shard is closed once it holds so many ids; a longer document has a shard of its own.
SHARD_IDS = 4 << 20
#: Pre-tokens that the tokenizer takes as one input.
BATCH_WORDS = 500
#: Bits of a plane that are dealt at once, in the processor's cache.
DEAL_BITS = 1 << 16
#: Id written after each document.
END_ID = 0


def _dealt(on: np.ndarray, zeros: int) -> Iterator[tuple[np.ndarray, slice, slice]]:
    """Places of the zeros and of the ones of a plane, piece by piece: (places, their piece, where they go on the next plane)."""
    at = [0, zeros]
    for k in range(0, len(on), DEAL_BITS):
        piece = slice(k, k + DEAL_BITS)
        for bit, part in enumerate((~on[piece], on[piece])):
            own = np.flatnonzero(part)  # places: several times as fast as an index of booleans
            yield own, piece, slice(at[bit], at[bit] + len(own))
            at[bit] += len(own)


def build(ids: np.ndarray, docs: list[tuple[int | None, int]], level: int = 3) -> bytes:
    """File bytes of a shard: ``ids`` of all its documents in order, ``docs`` = (doc_id, number of ids)."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=level)
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    cur, blobs, at = ids.astype(np.uint16 if bits <= 16 else np.uint32), [], 0
    zeros, places, ones = [], [], []
    for b in range(bits - 1, -1, -1):
        on = (cur & cur.dtype.type(1 << b)) != 0
        place, before, seen = [], [], 0
        for k in range(0, len(on), BLOCK_BITS):
            part = on[k: k + BLOCK_BITS]
            blob = pack.compress(np.packbits(part).tobytes())
            place.append([at, len(blob)])
            before.append(seen)
            blobs.append(blob)
            at += len(blob)
            seen += int(np.count_nonzero(part))
        zeros.append(len(on) - seen)
        places.append(place)
        ones.append(before)
        after = np.empty_like(cur)
        for own, piece, to in _dealt(on, zeros[-1]):
            after[to] = cur[piece].take(own)
        cur = after
    listed = pack.compress(json.dumps(docs).encode())
    head = json.dumps({"n": len(ids), "bits": bits, "zeros": zeros, "blocks": places, "ones": ones, "docs": [at, len(listed)]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *blobs, listed])


class WaveletFile:
    """Reader of one shard; ``read(start, size)`` returns bytes of the file."""

    def __init__(self, read):
        import zstandard

        self.read, self.unpack = read, zstandard.ZstdDecompressor()
        start = len(MAGIC) + 4
        front = read(0, start)
        if front[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet shard")
        size = struct.unpack("<I", front[len(MAGIC):])[0]
        self.head = json.loads(read(start, size))
        self.base, self.n, self.bits = start + size, self.head["n"], self.head["bits"]
        self.block = functools.lru_cache(64)(self._block)

    @classmethod
    def of(cls, data: bytes) -> WaveletFile:
        return cls(lambda start, size: data[start: start + size])

    def docs(self) -> list[tuple[int | None, int]]:
        at, size = self.head["docs"]
        return json.loads(self.unpack.decompress(self.read(self.base + at, size)))

    def _bits(self, plane: int, k: int) -> np.ndarray:
        at, size = self.head["blocks"][plane][k]
        packed = np.frombuffer(self.unpack.decompress(self.read(self.base + at, size)), np.uint8)
        return np.unpackbits(packed, count=min(BLOCK_BITS, self.n - k * BLOCK_BITS)).astype(bool)

    def _block(self, plane: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Bits of a block and the ones before each of its positions."""
        bits = self._bits(plane, k)
        return bits, np.concatenate([[0], np.cumsum(bits)])

    def plane(self, plane: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, bool), *(self._bits(plane, k) for k in range(len(self.head["blocks"][plane])))])

    def rank1(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        k = min(i // BLOCK_BITS, len(self.head["blocks"][plane]) - 1)
        return self.head["ones"][plane][k] + int(self.block(plane, k)[1][i - k * BLOCK_BITS]) if self.n else 0

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for p in range(self.bits):
            bit = bool(self.block(p, i // BLOCK_BITS)[0][i % BLOCK_BITS])
            r = self.rank1(p, i)
            i = self.head["zeros"][p] + r if bit else i - r
            out = out << 1 | bit
        return out

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        """Where the occurrences of a token inside [start, end) lie after the last plane."""
        if token < 0 or token >> self.bits:
            return 0, 0
        for p in range(self.bits):
            a, b = self.rank1(p, start), self.rank1(p, end)
            if token >> (self.bits - 1 - p) & 1:
                start, end = self.head["zeros"][p] + a, self.head["zeros"][p] + b
            else:
                start, end = start - a, end - b
        return start, end

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token among the first i ids."""
        a, b = self._range(token, 0, min(i, self.n))
        return b - a

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        a, b = self._range(token, start, self.n if end is None else min(end, self.n))
        return b - a

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) one or zero of a plane: the block by its directory, then inside it."""
        ones = self.head["ones"][plane]
        before = ones if bit else [j * BLOCK_BITS - c for j, c in enumerate(ones)]
        j = int(np.searchsorted(before, k, side="right")) - 1
        bits = self.block(plane, j)[0]
        return j * BLOCK_BITS + int(np.flatnonzero(bits if bit else ~bits)[k - before[j]])

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of a token."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for p in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - p) & 1
            i = self._select_bit(p, bit, i - self.head["zeros"][p] if bit else i)
        return i

    def occurrences(self, token: int) -> np.ndarray:
        """All positions of a token, ascending; one plane in memory at a time."""
        a, b = self._range(token, 0, self.n)
        at = np.arange(a, b)
        for p in range(self.bits - 1, -1, -1):
            if not len(at):
                break
            on = self.plane(p)
            at = np.flatnonzero(on)[at - self.head["zeros"][p]] if token >> (self.bits - 1 - p) & 1 else np.flatnonzero(~on)[at]
        return at

    def ids(self) -> np.ndarray:
        """The whole sequence, rebuilt from the last plane up."""
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for p in range(self.bits - 1, -1, -1):
            on, z = self.plane(p), self.head["zeros"][p]
            out[z:] |= out.dtype.type(1 << (self.bits - 1 - p))
            up = np.empty_like(out)
            for own, piece, here in _dealt(on, z):
                up[piece][own] = out[here]
            out = up
        return out


_LOADED: dict = {}


def _tokenizer(path: str):
    """(cache, whole-text encoder, special token) of this worker process, loaded once."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        lib = Tokenizer.from_file(path)
        plain = Tokenizer(lib.model)  # for pre-tokens: they are not searched for the split pattern again
        plain.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)

        n_bytes = np.zeros(lib.get_vocab_size(), np.int64)
        for token, i in lib.get_vocab(with_added_tokens=False).items():
            n_bytes[i] = len(token)  # a letter of a token stands for one byte

        def many(words: list[str]) -> tuple:
            """Pre-tokens as ready-made pieces of a few inputs: an object per input, not per pre-token.

            Ids stand for the bytes of their pre-token and no others, so the bytes tell where each ends.
            """
            got = plain.encode_batch_fast([words[k: k + BATCH_WORDS] for k in range(0, len(words), BATCH_WORDS)], is_pretokenized=True, add_special_tokens=False)
            flat = np.concatenate([np.array(e.ids, np.uint32) for e in got])
            done = np.cumsum(n_bytes[flat])
            ends = np.cumsum([len(w.encode()) for w in words])
            upto = np.searchsorted(done, ends)
            if not (len(flat) == upto[-1] + 1 and np.array_equal(done[upto], ends)):
                raise ValueError("the vocabulary is not a byte-level one")
            return flat.tolist(), np.diff(upto, prepend=-1)

        special = next((t.content for t in lib.get_added_tokens_decoder().values()), "\0none\0")
        _LOADED[path] = WordCache(many), lambda t: lib.encode(t, add_special_tokens=False).ids, special
    return _LOADED[path]


def open_shard(path: str) -> WaveletFile:
    fs, name = filesystem(path)
    f = fs.open_input_file(name)

    def read(start: int, size: int) -> bytes:
        f.seek(start)
        return f.read(size)

    return WaveletFile(read)


SHARD = "part int, seq int, path string, n_docs long, n_ids long"


def write_shards(docs: DataFrame, vocabulary: str, folder: str | None = None) -> DataFrame:
    """Encodes every text (null: empty), adds END_ID, and writes the shards in ascending doc_id order.

    Returns the index, a row per shard (SHARD columns; order is part, seq).
    Null doc_ids come first, repeated ones are documents of their own (ties
    by text); an empty table has no shards. A retried task writes new files
    and only the files named in the index count.
    """
    spark = docs.sparkSession
    folder = folder or new_dir(spark, "wavelet")

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        cache, whole, special = _tokenizer(vocabulary)
        part, seq, held, listed, total = TaskContext.get().partitionId(), 0, [], [], 0

        def close():
            nonlocal seq, held, listed, total
            fs, root = filesystem(folder)
            fs.create_dir(root, recursive=True)
            name = f"{part:06d}-{seq:06d}-{uuid.uuid4().hex[:8]}.wvm"
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(build(np.concatenate(held), listed))
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([len(listed)]), pa.array([total])], names=["part", "seq", "path", "n_docs", "n_ids"])
            seq, held, listed, total = seq + 1, [], [], 0
            return row

        for whole_batch in it:
            for b in batches(whole_batch, 2 << 20):
                for doc_id, ids in zip(b.column("doc_id").to_pylist(), encode_texts([t or "" for t in b.column("text").to_pylist()], cache, whole, special)):
                    held.append(np.append(ids, np.uint32(END_ID)).astype(np.uint32))
                    listed.append((doc_id, len(ids) + 1))
                    total += len(ids) + 1
                    if total >= SHARD_IDS:
                        yield close()
        if listed:
            yield close()

    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return stored(ordered.mapInArrow(run, SHARD), "shards")


def with_start(index: DataFrame) -> DataFrame:
    """Adds ``start``, the ids in all shards before: totals by part first, then inside each part."""
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    base = parts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_base"))
    own = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return index.join(base, "part").withColumn("start", F.col("_base") + own).drop("_base")


DOCUMENT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_documents(index: DataFrame) -> DataFrame:
    """Reads every shard back, one task row per shard: place, size and checksum of each document's ids."""

    def run(it: Iterator) -> Iterator:
        import pandas as pd

        for pdf in it:
            for path, start in zip(pdf.path, pdf.start):
                shard = open_shard(path)
                ids, rows, at = shard.ids().astype("<u4"), [], 0
                for doc_id, n in shard.docs():
                    rows.append((doc_id, start + at, n, zlib.crc32(ids[at: at + n])))
                    at += n
                yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})

    n = index.count()
    return with_start(index).repartition(max(1, n), "path").mapInPandas(run, DOCUMENT) if n else index.sparkSession.createDataFrame([], DOCUMENT)
