"""Language identification with bit-sliced Bloom filters of character n-grams.

All languages share one hash table; slot words hold one bit per language, so
one lookup (the AND of PROBES words) gives every language that contains an
n-gram. A text's language is the one with most n-grams after its expected
false positives are taken off.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainsift.llm.common import batches, mix, stored

#: Code points in an n-gram.
N = 4
#: An n-gram belongs to a language if its share there is at least this part of its largest share in any language.
SHARE = 0.2
#: Slots looked up for an n-gram.
PROBES = 3
#: Slots for each n-gram in the filters, and slots of one slice (8 bytes each for up to 63 languages): larger filters
#: are cut by n-gram hash into slices that the texts meet one after the other.
SLOTS_PER_GRAM, SLICE_SLOTS = 12, 1 << 22
#: Languages in one slot word.
WORD = 63
UNDETERMINED = "und"

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter; built once per process."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first n-gram of each text with one entry more, whether a text has a letter).

    Lower case; a run of other characters than letters is one space; each
    text stands between spaces, a short one is filled up with them.
    """
    low = [t.lower() for t in texts]
    cp = np.frombuffer("".join(f" {t}{' ' * N}" for t in low).encode("utf-32-le", "surrogatepass"), "<u4")
    off = np.concatenate([[0], np.cumsum([len(t) + 1 + N for t in low], dtype=np.int64)]).astype(np.int64)
    letter = letters()[cp]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after a word
    keep[off[:-1]] = True
    for j in range(1, N):  # the fill of a short text
        keep[np.maximum(off[1:] - j, 0)] = True
    done = np.concatenate([[0], np.cumsum(keep)])
    x = np.where(letter, cp, 32)[keep].astype(np.uint64)
    at = done[off]
    has = np.add.reduceat(np.append(letter, False), off[:-1]) > 0 if len(low) else np.zeros(0, bool)
    # texts end with one space after the last word and up to N - 1 of fill; n-grams may not start so late that they leave the text
    n = len(x) - N + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(low) + 1, np.int64), has
    h = np.zeros(n, np.uint64)
    for j in range(N):
        h = h * np.uint64(0x1F3D5B79) + x[j: j + n]
    start = np.ones(n, bool)
    for j in range(1, N):
        late = at[1:] - j
        start[late[late < n]] = False
    blank = x[:n] == 32
    for j in range(1, N):
        blank &= x[j: j + n] == 32
    start &= ~blank
    first = np.concatenate([[0], np.cumsum(start)])[np.minimum(at, n)]
    return mix(h[start]), first, has


def training(docs: DataFrame) -> DataFrame:
    """Rows to learn from: text and language given, and not held out."""
    return docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).where("doc_id is not null")


def held_out(doc_id):
    """A quarter of the documents by the checksum of their id; a null id is not held out (and not learnt from)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def count_grams(docs: DataFrame) -> DataFrame:
    """(gram, lang, n): how often each n-gram occurs in the texts of each language, summed in every task first."""

    def run(it: Iterator) -> Iterator:
        import pandas as pd

        held: dict[str, list] = {}

        def add(lang, u, n):
            parts = held.setdefault(lang, [])
            parts.append((u, n))
            if len(parts) >= 16:
                held[lang] = [merged(parts)]

        def merged(parts):
            u, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return u, np.bincount(inverse, weights=np.concatenate([p[1] for p in parts]), minlength=len(u)).astype(np.int64)

        for whole in it:
            for b in batches(whole):
                by: dict[str, list[str]] = {}
                for t, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                    by.setdefault(lang, []).append(t)
                for lang, texts in by.items():
                    add(lang, *np.unique(grams(texts)[0], return_counts=True))
                if sum(len(p[0]) for parts in held.values() for p in parts) > 4_000_000:  # keeps a worker small
                    yield from frames(pd, held, merged)
                    held.clear()
        yield from frames(pd, held, merged)

    def frames(pd, held, merged):
        import pyarrow as pa

        for lang, parts in held.items():
            u, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array([lang] * len(u), pa.string()), pa.array(n)], names=["gram", "lang", "n"])

    return docs.select("text", "lang").mapInArrow(run, "gram long, lang string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))


@dataclass
class Slice:
    """Slot words (slots x words) of the n-grams of one hash slice, and their false-positive rate by language."""

    slots: np.ndarray
    wrong: np.ndarray

    def masks(self, gram: np.ndarray) -> np.ndarray:
        """Language bits of each n-gram."""
        out = None
        for s in probes(gram, len(self.slots)):
            out = self.slots[s] if out is None else out & self.slots[s]
        return out


@dataclass
class Filters:
    """Languages (by name), the most frequent one, stored slot words (slice, slot, word, bits), number of slices and slots in each."""

    langs: list[str]
    default: int
    rows: DataFrame | None
    slices: int
    size: int

    def slice(self, s: int) -> Slice:
        """One slice, at most SLICE_SLOTS slots of it, through the driver."""
        table = np.zeros((self.size, max(1, -(-len(self.langs) // WORD))), np.uint64)
        if self.rows is not None:
            rows = self.rows.where(F.col("slice") == s).toPandas()
            table[rows.slot.to_numpy(), rows.word.to_numpy()] = rows.bits.to_numpy().view(np.uint64)
        fill = [((table[:, k // WORD] >> np.uint64(k % WORD)) & np.uint64(1)).mean() for k in range(len(self.langs))]
        return Slice(table, np.array(fill) ** PROBES)

    def masks(self, gram: np.ndarray) -> np.ndarray:
        """Language bits of each n-gram, over all slices."""
        out, own = np.zeros((len(gram), max(1, -(-len(self.langs) // WORD))), np.uint64), slice_of(gram, self.slices)
        for s in range(self.slices):
            out[own == s] = self.slice(s).masks(gram[own == s])
        return out


def slice_of(gram: np.ndarray, slices: int) -> np.ndarray:
    """Slice of each n-gram: its highest bits (``slices`` is a power of two), which do not choose the slots."""
    return (gram >> np.uint64(65 - slices.bit_length())).astype(np.int64) if slices > 1 else np.zeros(len(gram), np.int64)


def evidence(texts: list[str | None], part: Slice, s: int, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """(corrected number of n-grams of slice ``s`` by text and language, whether a text has a letter)."""
    gram, first, has = grams([t or "" for t in texts])
    if slices > 1:
        mine = slice_of(gram, slices) == s
        gram, first = gram[mine], np.concatenate([[0], np.cumsum(mine)])[first]
    total = np.diff(first).astype(float)
    count = np.zeros((len(texts), len(part.wrong)))
    mask = part.masks(gram)
    for k in range(count.shape[1]):
        bit = (mask[:, k // WORD] >> np.uint64(k % WORD)) & np.uint64(1)
        count[:, k] = np.diff(np.concatenate([[0], np.cumsum(bit.astype(np.int64))])[first])
    return (count - total[:, None] * part.wrong) / (1 - np.minimum(part.wrong, 0.999)), has


def choose(langs: list[str], default: int, right: np.ndarray, has: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text from its corrected counts; see ``predict``."""
    out, score = [UNDETERMINED] * len(right), np.zeros(len(right))
    if not langs or not len(right):
        return out, score
    right = np.clip(right, 0, None)
    best = right.argmax(axis=1)
    top = right[np.arange(len(right)), best]
    best[top == 0] = default
    score = np.divide(top, right.sum(axis=1), out=score, where=top > 0)
    for i in np.flatnonzero(has):
        out[i] = langs[best[i]]
    score[~has] = 0
    return out, np.clip(score, 0, 1)


def probes(gram: np.ndarray, slots: int) -> list[np.ndarray]:
    a, b = gram & np.uint64(0xFFFFFFFF), gram >> np.uint64(32) | np.uint64(1)
    return [((a + np.uint64(j) * b) & np.uint64(slots - 1)).astype(np.int64) for j in range(PROBES)]


def learn(docs: DataFrame) -> Filters:
    """Filters from all training rows (columns text, lang); the driver gets the languages, and later one slice at a time."""
    counts = stored(count_grams(docs), "grams")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return Filters([], 0, None, 1, 1)
    known = counts.sparkSession.createDataFrame([(x, k, float(totals[x])) for k, x in enumerate(langs)], "lang string, k int, total double")
    share = counts.join(F.broadcast(known), "lang").select("gram", "k", (F.col("n") / F.col("total")).alias("share"))
    of = share.join(share.groupBy("gram").agg(F.max("share").alias("most")), "gram").where(F.col("share") >= SHARE * F.col("most")).select("gram", "k")
    n = of.agg(F.approx_count_distinct("gram")).first()[0]
    slots = 1 << max(6, int(n * SLOTS_PER_GRAM - 1).bit_length())
    slices = max(1, slots // SLICE_SLOTS)
    size = slots // slices
    low, high = F.col("gram").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("gram", 32).bitwiseOR(F.lit(1))
    at = F.array(*[(low + F.lit(j) * high).bitwiseAND(F.lit(size - 1)) for j in range(PROBES)])
    bits = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k") % WORD)
    own = F.shiftrightunsigned("gram", 65 - slices.bit_length()) if slices > 1 else F.lit(0).cast("long")
    rows = (
        of.select(own.alias("slice"), F.explode(at).alias("slot"), (F.col("k") / WORD).cast("int").alias("word"), bits.alias("bits"))
        .groupBy("slice", "slot", "word").agg(F.bit_or("bits").alias("bits"))
    )
    return Filters(langs, max(range(len(langs)), key=lambda k: totals[langs[k]]), stored(rows, "filters"), slices, size)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """``docs`` plus lang_pred and score (0 to 1: the language's part of all languages' corrected n-grams).

    Null texts and texts without a letter are ``und`` with score 0; ties go to
    the language first by name; a text none of whose n-grams is known gets the
    language with most training text, score 0. Without anything learnt all
    are ``und``. Existing columns of these names are replaced.
    """
    from pyspark.sql import types as T

    from pyspark.sql import types as T

    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names, langs, default = docs.columns, filters.langs, filters.default
    if filters.slices == 1:
        sent = docs.sparkSession.sparkContext.broadcast(filters.slice(0))

        def run(it: Iterator) -> Iterator:
            import pyarrow as pa

            for whole in it:
                for b in batches(whole):
                    found, score = choose(langs, default, *evidence(b.column("text").to_pylist(), sent.value, 0, 1))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

        return docs.mapInArrow(run, schema)

    row = "_row"
    while any(n.lower().startswith(row) for n in names):
        row += "_"
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "texts")
    found = _all_slices(numbered.select(F.col(row).alias("row"), "text"), filters)
    found = found.select(F.col("row").alias(row), F.col("has").alias(f"{row}has"), F.col("right").alias(f"{row}right"))

    def pick(it: Iterator) -> Iterator:
        import pyarrow as pa

        for b in it:
            has = b.column(f"{row}has").to_numpy(zero_copy_only=False).astype(bool)
            right = np.array(b.column(f"{row}right").to_pylist(), float).reshape(len(has), len(langs))
            out, score = choose(langs, default, right, has)
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(out, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return numbered.join(found, row).select(*names, f"{row}has", f"{row}right").mapInArrow(pick, schema)


def _all_slices(texts: DataFrame, filters: Filters) -> DataFrame:
    """(row, has, right) of the texts (row, text): a pass over them for each slice, so that a task holds one slice at a time."""
    spark, slices, passes = texts.sparkSession, filters.slices, []
    for s in range(slices):
        sent = spark.sparkContext.broadcast(filters.slice(s))

        def run(it: Iterator, s=s, sent=sent) -> Iterator:
            import pyarrow as pa

            for whole in it:
                for b in batches(whole):
                    right, has = evidence(b.column("text").to_pylist(), sent.value, s, slices)
                    yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(has), pa.array(list(right), pa.list_(pa.float64()))], names=["row", "has", "right"])

        passes.append(stored(texts.mapInArrow(run, "row long, has boolean, right array<double>"), "evidence"))
        sent.unpersist()
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    sums = F.array(*[F.sum(F.col("right")[k]) for k in range(len(filters.langs))])
    return every.groupBy("row").agg(F.max("has").alias("has"), sums.alias("right"))
