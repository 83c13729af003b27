"""Benchmark decontamination with SimHash fingerprints of item-sized windows.

Every window as long as a benchmark item (in words) has a 64-bit SimHash of
its weighted five-word shingles. A multi-index of the items' fingerprints
finds all within RADIUS bits; candidates are decided by the exact weighted
shingle similarity. Windows in which shingles of the benchmark weigh less
than the threshold cannot reach it and get no fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from chainsift.llm.common import batches, flat_bytes, mix, shingle_hashes, without_ids, words

#: Words in a shingle; an item or window with fewer words is one shingle.
SHINGLE = 5
#: Similarity at which a window counts as leaked, as a fraction of whole numbers.
SIMILAR = (4, 5)
#: Fingerprints so many bits apart are candidates. Texts 0.8 alike differ in about 10 of 64 bits, more than 20 in 1 of 5,000 cases.
RADIUS = 20
#: Blocks of the multi-index. With 20 bits over 8 blocks, one block has at most 2 of them.
BLOCKS = 8
#: Benchmark text that is sent to all tasks at once; a larger benchmark is taken in several passes.
PASS_BYTES = 8 << 20

_SHIFTS = np.arange(64, dtype=np.uint64)
_POPCOUNT8 = np.array([bin(v).count("1") for v in range(256)], np.uint8)


def shingles(word: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, weight) of a text's shingles; the weight is the letters (bytes) of its words."""
    k = min(SHINGLE, len(word))
    done = np.concatenate([[0], np.cumsum(size)])
    return shingle_hashes(word, k), done[k:] - done[: len(done) - k]


def votes(code: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """What each shingle adds to the 64 bit counters."""
    bits = (mix(code)[:, None] >> _SHIFTS) & np.uint64(1)
    return np.where(bits == 1, weight[:, None], -weight[:, None])


def fingerprint(total: np.ndarray) -> np.ndarray:
    """SimHash of bit counters (one row each)."""
    return ((total >= 0).astype(np.uint64) << _SHIFTS).sum(axis=1, dtype=np.uint64)


def distance(a: np.ndarray, b) -> np.ndarray:
    return _POPCOUNT8[(a ^ b).view(np.uint8).reshape(-1, 8)].sum(axis=1)


class Benchmark:
    """Shingles, fingerprints and multi-index of a block of items, by size class."""

    def __init__(self, items: list[tuple[int, str]]):
        import pyarrow as pa

        raw, off = flat_bytes(pa.array([t for _, t in items], pa.string()))
        word, start, end, first = words(raw, off)
        self.item, self.words, self.bag, code, owner, prints = [], [], [], [], [], []
        for k, (item, _) in enumerate(items):
            a, b = first[k], first[k + 1]
            if a == b:
                continue
            h, w = shingles(word[a:b], end[a:b] - start[a:b])
            u, at, count = np.unique(h, return_index=True, return_counts=True)
            code.append(u)
            owner.append(np.full(len(u), len(self.item)))
            prints.append(fingerprint(votes(h, w).sum(axis=0)[None])[0])
            self.item.append(item)
            self.words.append(int(b - a))
            self.bag.append((u, count, w[at]))
        code, owner = np.concatenate([np.zeros(0, np.uint64), *code]), np.concatenate([np.zeros(0, np.int64), *owner])
        order = np.argsort(code, kind="stable")
        self.code, self.owner = code[order], owner[order]
        self.prints = np.array(prints, np.uint64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.code >> np.uint64(44)).astype(np.int64)] = True
        self.sizes = sorted(set(self.words))
        #: size -> (items, for each block and value the items within the block's radius)
        self.index = {}
        near = [np.flatnonzero(_POPCOUNT8[np.arange(256) ^ v] <= RADIUS // BLOCKS) for v in range(256)]
        for n in self.sizes:
            members = np.flatnonzero(np.array(self.words) == n)
            tables = [[[] for _ in range(256)] for _ in range(BLOCKS)]
            for m in members:
                for b in range(BLOCKS):
                    for v in near[int(self.prints[m]) >> 8 * b & 255]:
                        tables[b][v].append(int(m))
            self.index[n] = tables

    def hits(self, code: np.ndarray) -> np.ndarray:
        """Which shingles occur in the benchmark."""
        out = self.seen[(code >> np.uint64(44)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            k = np.searchsorted(self.code, code[at])
            out[at] = self.code[np.minimum(k, len(self.code) - 1)] == code[at]
        return out

    def owners(self, code: np.ndarray) -> np.ndarray:
        """Items that have any of the shingles."""
        u = np.unique(code)
        a, b = np.searchsorted(self.code, u), np.searchsorted(self.code, u, side="right")
        return np.unique(np.concatenate([np.zeros(0, np.int64), *(self.owner[x:y] for x, y in zip(a, b))]))

    def near(self, n: int, prints: int) -> list[int]:
        """Items of size n within RADIUS of a fingerprint, through the multi-index."""
        found: set[int] = set()
        for b, table in enumerate(self.index[n]):
            found.update(table[prints >> 8 * b & 255])
        m = np.array(sorted(found), np.int64)
        return m[distance(self.prints[m], np.uint64(prints)) <= RADIUS].tolist() if len(m) else []

    def overlap(self, m: int, u: np.ndarray, count: np.ndarray, total: int) -> tuple[int, int]:
        """(shared weight, united weight) of item m and a window's bag (distinct shingles, counts, total weight)."""
        iu, ic, iw = self.bag[m]
        at = np.searchsorted(u, iu)
        at[at == len(u)] = 0
        same = u[at] == iu
        shared = int((np.minimum(count[at], ic) * iw)[same].sum())
        return shared, total + int((ic * iw).sum()) - shared

    def matches(self, word: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(item number, start word, window words, shared, united, distance) of every leaked window of a text."""
        for n in self.sizes:
            w = min(n, len(word))
            k = min(SHINGLE, w)
            code = shingle_hashes(word, k)
            hit = self.hits(code)
            if not hit.any() or not any(self.words[m] == n for m in self.owners(code[hit])):
                continue
            done = np.concatenate([[0], np.cumsum(size)])
            weight = done[k:] - done[: len(done) - k]
            m = w - k + 1
            all_w = np.concatenate([[0], np.cumsum(weight)])
            hit_w = np.concatenate([[0], np.cumsum(weight * hit)])
            inside, of = hit_w[m:] - hit_w[:-m], all_w[m:] - all_w[:-m]
            starts = np.flatnonzero(SIMILAR[1] * inside >= SIMILAR[0] * of)
            for g in range(0, len(starts), 512):
                group = starts[g: g + 512]
                for s in group.tolist():
                    c, wt = code[s: s + m], weight[s: s + m]
                    p = fingerprint(votes(c, wt).sum(axis=0)[None])
                    near = self.near(n, int(p[0]))
                    if near:
                        u, count = np.unique(c, return_counts=True)
                        for i in near:
                            shared, united = self.overlap(i, u, count, int(of[s]))
                            if SIMILAR[1] * shared >= SIMILAR[0] * united:
                                yield i, s, w, shared, united, int(distance(self.prints[i: i + 1], p)[0])


def passes(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items with text, in blocks of about PASS_BYTES."""
    held, size = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null and item_id is not null").orderBy("item_id", "text").toLocalIterator():
        held.append((r.item_id, r.text))
        size += len(r.text)
        if size >= PASS_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


LEAK = "doc_id long, item_id long, start_word long, n_words long, similarity double, distance long, n_windows long"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One LEAK row for each row of ``docs`` and item that leaked into it: its most similar window, earliest first.

    Words as in ``common.words``. A document shorter than an item is one
    window. ``n_windows`` counts the windows at or above the threshold.
    Null and empty texts leak nothing; null or wordless items are ignored;
    repeated items count once, repeated documents each for themselves.
    """
    spark = docs.sparkSession
    out = spark.createDataFrame([], LEAK)
    for items in passes(benchmark.dropDuplicates(["item_id", "text"])):
        sent = spark.sparkContext.broadcast(items)

        def run(it: Iterator, sent=sent) -> Iterator:
            import pandas as pd

            bench = Benchmark(sent.value)
            for whole in it:
                for b in batches(whole):
                    raw, off = flat_bytes(b.column("text"))
                    word, start, end, first = words(raw, off)
                    size = end - start
                    some = np.zeros(len(first) - 1, bool)
                    for k in {min(SHINGLE, n) for n in bench.sizes}:
                        hit = np.flatnonzero(bench.hits(shingle_hashes(word, k)))
                        doc = np.searchsorted(first, hit, side="right") - 1
                        some[doc[hit + k <= first[doc + 1]]] = True
                    ids, rows = b.column("doc_id").to_pylist(), []
                    for d in np.flatnonzero(some):
                        best: dict[int, list] = {}
                        for i, s, w, shared, united, far in bench.matches(word[first[d]: first[d + 1]], size[first[d]: first[d + 1]]):
                            row = [ids[d], bench.item[i], s, w, shared / united, far, 1]
                            if i in best:
                                row[6] += best[i][6]
                                if best[i][4] >= row[4]:
                                    row = [*best[i][:6], row[6]]
                            best[i] = row
                        rows += best.values()
                    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in LEAK.split(", ")]).astype({"doc_id": "Int64", "item_id": "Int64"})
                    yield pa_batch(frame)

        out = out.union(docs.select("doc_id", "text").mapInArrow(run, LEAK))
    return out


def pa_batch(frame):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "double": pa.float64()}
    fields = [pa.field(n, kinds[k]) for n, k in (c.split() for c in LEAK.split(", "))]
    return pa.RecordBatch.from_pandas(frame, schema=pa.schema(fields), preserve_index=False)


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that a benchmark item leaked into (rows with null doc_id stay: they cannot be named)."""
    return without_ids(docs, leaks(docs, benchmark).select("doc_id"))
