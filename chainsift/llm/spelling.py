"""Spelling variants of words by reduced-alphabet generation.

Letters are hashed to SYMBOLS symbols (code point modulo SYMBOLS). Words with
one letter inserted, deleted or replaced have reduced words that are equal or
differ by one symbol edit, so the full one-edit neighbourhood of every reduced
word, joined with the reduced vocabulary by 64-bit hashes, meets all near
words; each pair met is verified on the original strings.

A reduced word that very many words share would pair them all: the words of
such a class are found through a finer alphabet instead (FINE symbols), whose
neighbourhoods only the words that meet the class generate. Nothing is dropped.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainsift.llm.common import BROADCAST_IDS, _powers, mix, stored

SYMBOLS, FINE = 8, 64
#: Words of one reduced word from which on the finer alphabet tells them apart.
CLASS = 64
#: Bits of the filter that keeps neighbours outside the reduced vocabulary from being sent (8 MB, whatever the vocabulary holds; it only saves shuffle).
FILTER_BITS = 1 << 26
#: Different words that a task counts before it hands them on, and runs of letters it looks at in one go.
COUNTED, RUNS = 200_000, 100_000
#: Words shorter or rarer than this are not part of the vocabulary; a form occurs FORM times as often as its variant, at least.
SHORTEST, LEAST, FORM = 6, 5, 5


def vocabulary(docs: DataFrame, damage: int | None = None, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n) of all texts: runs of Latin letters, A-Z lower-cased, counted over all documents.

    ``damage`` plants misspellings: where it divides the crc32 of
    ``<doc_id>:<run>``, the run loses the letter at that crc modulo its
    length. Null texts have no words; a null doc_id counts as an empty one in
    that crc. Repeated rows count again; other columns are ignored.
    """
    letters = re.compile(f"[a-zÀ-ÿ]{{{shortest},}}")  # greedy: whole runs of at least that length

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        total: Counter = Counter()

        def out():
            rows = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return rows

        for b in it:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                low = (text.as_py() or "").encode().lower().decode()  # bytes: only A-Z change
                found = letters.finditer(low)
                head = zlib.crc32(b"%s:" % str("" if doc is None else doc).encode())
                while runs := Counter(m.group() for m in islice(found, RUNS)):
                    for w, n in runs.items():
                        if damage:
                            h = zlib.crc32(w.encode(), head)
                            if h % damage == 0:
                                w = w[: h % len(w)] + w[h % len(w) + 1:]
                                if len(w) < shortest:
                                    continue
                        total[w] += n
                    if len(total) >= COUNTED:
                        yield out()
        if total:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Reduced:
    """The reduced words of a batch, flat: prefix sums of a polynomial hash over the symbols of every word."""

    def __init__(self, words: list[str], symbols: int):
        self.size = np.array([len(w) for w in words], np.int64)
        self.symbols = symbols
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.symbol = (code % symbols).astype(np.uint64)
        self.owner = np.repeat(np.arange(len(words)), self.size)
        self.first = np.cumsum(self.size) - self.size
        self.place = np.arange(len(code)) - self.first[self.owner]
        self.power, inverse = _powers(int(self.size.max(initial=0)) + 2)
        self.back = inverse[1]
        whole = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.symbol + np.uint64(1)) * self.power[self.place], dtype=np.uint64)])
        self.before = whole[:-1] - whole[self.first][self.owner]  # of the symbols before each place
        self.whole = whole[self.first + self.size] - whole[self.first]

    @staticmethod
    def key(value: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix(value + mix(size.astype(np.uint64)))

    def own(self) -> np.ndarray:
        return self.key(self.whole, self.size)

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """(number of the word, key): each word's reduced word and all that are one symbol edit away, each once."""
        one, s = np.uint64(1), np.arange(self.symbols, dtype=np.uint64)
        at, whole, size = self.power[self.place], self.whole[self.owner], self.size[self.owner]
        after = whole - self.before - (self.symbol + one) * at
        owner = [np.arange(len(self.size)), self.owner]
        keys = [self.own(), self.key(self.before + after * self.back, size - 1)]  # itself, deletions
        swapped = whole[:, None] + (s[None, :] - self.symbol[:, None]) * at[:, None]
        keys.append(self.key(swapped, size[:, None]).ravel())
        owner.append(np.repeat(self.owner, self.symbols))
        # Insertions before every place, and after the last one.
        base = np.concatenate([self.before + (whole - self.before) * self.power[1], self.whole])
        gap = np.concatenate([at, self.power[self.size]])
        who = np.concatenate([self.owner, np.arange(len(self.size))])
        keys.append(self.key(base[:, None] + (s[None, :] + one) * gap[:, None], self.size[who][:, None] + 1).ravel())
        owner.append(np.repeat(who, self.symbols))
        owner, keys = np.concatenate(owner), np.concatenate(keys)
        order = np.lexsort((keys, owner))
        owner, keys = owner[order], keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])
        return owner[new], keys[new]


def _pieces(words: list[str], symbols: int, limit: int = 1 << 20) -> Iterator[list[str]]:
    """``words`` in lists whose neighbourhoods hold about ``limit`` keys, at least one word each."""
    part, size = [], 0
    for w in words:
        part.append(w)
        size += 2 * symbols * (len(w) + 1)
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def _keyed(words: DataFrame, symbols: int) -> DataFrame:
    """(key, x, x_n): the reduced vocabulary."""

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        for b in it:
            key = Reduced(b.column("word").to_pylist(), symbols).own()
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column("word"), b.column("n")], names=["key", "x", "x_n"])

    return words.select("word", "n").mapInArrow(run, "key long, x string, x_n long")


def _filter(index: DataFrame) -> np.ndarray:
    """The keys of ``index`` as a bit table of FILTER_BITS bits; only its 64-bit words reach the driver, at most 2**20 of them."""
    bit = F.shiftrightunsigned("key", 38)  # the upper 26 bits of the key
    rows = index.select((F.shiftright(bit, 6)).alias("at"), F.expr("shiftleft(1L, cast(shiftrightunsigned(key, 38) & 63 as int))").alias("bit"))
    rows = rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return table.view(np.uint64)


def _probes(words: DataFrame, symbols: int, index: DataFrame) -> DataFrame:
    """(key, word): the neighbourhoods of ``words``, without keys that the filter of ``index`` rules out."""
    sent = words.sparkSession.sparkContext.broadcast(_filter(index))

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        bits = sent.value
        for b in it:
            for part in _pieces(b.column("word").to_pylist(), symbols):
                owner, key = Reduced(part, symbols).neighbours()
                bit = key >> np.uint64(38)
                there = (bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                own = pa.array(part, pa.string()).take(pa.array(owner[there]))
                yield pa.RecordBatch.from_arrays([pa.array(key[there].view(np.int64)), own], names=["key", "word"])

    return words.select("word").mapInArrow(run, "key long, word string")


def near_words(words: DataFrame) -> DataFrame:
    """(word, x, x_n): every ordered pair of words of ``words`` (word, n; distinct) that are one inserted, deleted or replaced letter apart."""
    spark = words.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = stored(words.repartition(parts, "word"), "words")
    index = stored(_keyed(words, SYMBOLS), "reduced")
    hot = stored(index.groupBy("key").count().where(F.col("count") > CLASS).select("key"), "hot")
    n_hot = hot.count()
    listed = F.broadcast(hot) if n_hot <= BROADCAST_IDS else hot
    near = F.levenshtein("word", "x", 1) == 1
    probes = _probes(words, SYMBOLS, index)
    if not n_hot:
        return probes.join(index, "key").where(near).select("word", "x", "x_n")
    probes = stored(probes, "probes")
    plain = probes.join(index.join(listed, "key", "left_anti"), "key").where(near).select("word", "x", "x_n")
    asking = probes.join(listed, "key", "left_semi").select("word").distinct()
    crowd = index.join(listed, "key", "left_semi").select(F.col("x").alias("word"), F.col("x_n").alias("n"))
    fine = stored(_keyed(crowd, FINE), "fine")
    return plain.union(_probes(asking, FINE, fine).join(fine, "key").where(near).select("word", "x", "x_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each word's chain of forms, by pointer doubling.

    Every form occurs several times as often as its word, so there is no
    cycle and a chain of length d takes log2(d) rounds.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("up"))
        on = now.join(step, "root", "left")
        now = stored(on.select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "roots")
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``words`` (word, n; distinct words).

    A word's form is its near word of largest n (ties: the smallest in
    code-point order) if that is FORM times as frequent at least, else null;
    root is the end of its chain of forms, the word itself without one;
    n_near counts near words (0 without any). An empty vocabulary gives an
    empty result.
    """
    words = stored(words.select("word", "n"), "vocabulary")
    best = F.min(F.struct((-F.col("x_n")).alias("m"), F.col("x").alias("x")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = words.join(near, "word", "left")
    taken = -F.col("best.m") >= F.lit(FORM) * F.col("n")
    found = stored(found.select("word", F.when(taken, F.col("best.x")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, -F.col("best.m")).alias("form_n")), "forms")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
