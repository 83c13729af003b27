"""Repeated-substring removal by merging Burrows-Wheeler transforms of shards.

A text is read in one or two ways: as its bytes, and as its words. A window
(LENGTH bytes, or a passage of so many words) that starts anywhere else too is
repeated; ``mark`` and ``cut`` take out what repeated windows cover. Both ways
go through one pass over the texts and the same steps:

1. Every window has an anchor, the place of the smallest hash of a few of its
   elements. Equal windows have equal anchors at equal places, so
   neighbouring windows with one anchor form a segment, and only segments
   with equal anchors can share a window. Equal segments are counted first,
   anchors that occur once are settled.
2. The distinct segments of an anchor that has several go to one task. A
   segment is read as interleaved strings of symbols of so many elements that a
   window is a whole number of them (the depth). Each shard of segments gets its own
   suffix order and transform; the transforms are merged by refining their
   interleave that many times, which also yields the common prefixes: classes of
   two or more suffixes after those rounds are the repeated intervals. Merged
   suffixes are never sorted again.

An anchor that very many different segments share (the border of a passage
copied into a large part of all texts) would not fit into a task; its windows
are counted by 128-bit hashes instead, with the same result.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainsift.llm.common import _CODE, _LOWER, _SPACE, batches, distinct, flat_bytes, mix, prefix_hash, prefix_sums, release, span_hash, stable_order, stored, window_hash, word_spans


@dataclass(frozen=True)
class Reading:
    """Elements of a window, of a symbol and of an anchor's gram; elements are bytes or words."""

    window: int
    symbol: int
    gram: int
    words: bool = False


LENGTH = 400
BYTES = Reading(LENGTH, 100, 48)


def of_words(passage: int) -> Reading:
    """Passages of ``passage`` words, in symbols of at most a third of them where they can be divided so."""
    symbol = next(k for k in range(max(1, passage // 3), 0, -1) if passage % k == 0)
    return Reading(passage, symbol, min(6, passage), True)


#: Elements of segments that are merged at once, and in how many shards; a single anchor's group may be larger.
MERGE_BYTES, SHARDS = 1 << 19, 4
#: An anchor with more distinct segments than this (about 10 million elements) is not merged in one task: its windows are counted by their hashes.
HOT_SEGMENTS = 1 << 14
#: Windows of a text that are looked at in one go; a longer text is taken in such pieces.
PIECE = 1 << 20
#: Rows up to this number are broadcast to find their texts, more are joined by shuffle (the same way from middling sizes up).
BROADCAST_ROWS = 1 << 14


def window_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive entries: running minima forwards and backwards in blocks of w."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    full = np.concatenate([x, np.full(-len(x) % w, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).reshape(-1)
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[w - 1: w - 1 + n])


_EDGE = np.zeros(256, bool)
_EDGE[list(string.punctuation.encode())] = True


def word_places(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text) of words as in ``common.words``, without ASCII punctuation at their edges."""
    start, end, first = word_spans(raw, off)
    plain = ~_EDGE[raw]
    begin, stop = start.copy(), end.copy()
    # Only words with punctuation at that edge look for their inner places.
    if len(start) and len(at := np.flatnonzero(~plain[start] | ~plain[end - 1])):
        inner = np.append(np.flatnonzero(plain), len(raw))
        begin[at] = np.minimum(inner[np.searchsorted(inner, start[at])], end[at])
        before = np.searchsorted(inner, end[at]) - 1
        stop[at] = np.where(before >= 0, inner[before] + 1, 0)
    return begin, np.maximum(stop, begin), first


def word_values(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each text); A-Z is lower-cased. One very long text is read in pieces that end at a blank."""
    if len(off) != 2 or len(raw) <= 2 * PIECE:
        start, end, first = word_places(raw, off)
        return mix(span_hash(prefix_hash(_LOWER[raw]), start, end)), first
    parts, at = [], 0
    while at < len(raw):
        to = min(at + PIECE, len(raw))
        while to < len(raw) and not _SPACE[raw[to]]:
            blank = np.flatnonzero(_SPACE[raw[to: to + PIECE]])
            to = to + int(blank[0]) if len(blank) else min(to + PIECE, len(raw))
        part = raw[at:to]
        start, end, _ = word_places(part, np.array([0, len(part)]))
        parts.append(mix(span_hash(prefix_hash(_LOWER[part]), start, end)))
        at = to
    out = np.concatenate(parts)
    return out, np.array([0, len(out)])


def segments(value: np.ndarray, off: np.ndarray, reading: Reading = BYTES):
    """(text number, start, length, anchor hash, segment hash) of all segments of concatenated texts (64-bit values of their elements)."""
    window, gram_size = reading.window, reading.gram
    n = len(value) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    prefix = prefix_sums(value)
    gram = window_hash(prefix, gram_size)
    bits = max(1, int(len(gram) - 1).bit_length())
    place = np.uint64((1 << bits) - 1)
    least = window_minimum((gram & ~place) | np.arange(len(gram), dtype=np.uint64), window - gram_size + 1) & place  # ties: the first place
    # Segments end where the anchor changes, where a text starts, and after its last whole window.
    new = np.ones(n, bool)
    new[1:] = least[1:] != least[:-1]
    edge = np.concatenate([off, off[1:] - window + 1])
    new[edge[(edge >= 0) & (edge < n)]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    text = np.searchsorted(off, start, side="right") - 1
    keep = start + window <= off[text + 1]
    text, start, end = text[keep], start[keep], end[keep]
    length = end - start + window - 1
    return text, start, length, gram[least[start].astype(np.int64)], span_hash(prefix, start, start + length)


def suffix_order(symbol: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Order of a shard's suffixes by their first ``depth`` symbols (prefix doubling).

    ``symbol[i]`` is 0 at the end of a string; ``left[i]`` counts the symbols
    from i to that end. Strings lie one after the other.
    """
    rank, k = symbol, 1
    while True:
        both = rank.astype(np.int64)
        if k < depth:
            both *= int(rank.max()) + 1
            both[:-k] += np.where(left[:-k] >= k, rank[k:], 0)  # strings lie in order: k symbols on is k places on
        if 2 * k >= depth:
            return stable_order(both)
        rank, k = distinct(both)[2], 2 * k


def merge(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' suffixes after ``depth`` refinements, and the class of each merged suffix.

    A round reads the transforms in the order of the present interleave and
    deals the suffixes that stand before them by that symbol; classes split
    where symbol or class changes. The ends of strings (symbol 0) are all
    different. Returns (index into the concatenated transforms, class).
    """
    whole = np.concatenate(transforms)
    begin = np.cumsum([0, *(len(t) for t in transforms)])
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    group = np.zeros(len(whole), np.int32)
    index = np.arange(len(whole), dtype=np.int32)
    for _ in range(depth):
        symbol = whole[index]
        deal = stable_order(symbol)
        shard, group, symbol = shard[deal], group[deal], symbol[deal]
        new = symbol == 0
        new[:1] = True
        new[1:] |= (symbol[1:] != symbol[:-1]) | (group[1:] != group[:-1])
        np.cumsum(new, out=group)
        for k in range(len(transforms)):
            index[np.flatnonzero(shard == k)] = np.arange(begin[k], begin[k + 1], dtype=np.int32)
    return index, group


def values_of(data: bytes, reading: Reading) -> np.ndarray:
    """The 64-bit element values of a segment as it is sent: bytes, or words of eight bytes."""
    return np.frombuffer(data, "<u8") if reading.words else _CODE[np.frombuffer(data, np.uint8)]


def repeated_windows(parts: list[bytes], reading: Reading = BYTES) -> list[np.ndarray]:
    """For each of the (distinct) segments, which of its windows start anywhere else in them."""
    window, stride = reading.window, reading.symbol
    values = [values_of(p, reading) for p in parts]
    size = np.array([len(v) for v in values], np.int64)
    gap = np.zeros(1, np.uint64)  # the place after a segment ends a string that fills it
    value = np.concatenate([x for v in values for x in (v, gap)])
    off = np.concatenate([[0], np.cumsum(size + 1)])
    prefix = prefix_sums(value)
    place = np.arange(len(value), dtype=np.int32) - np.repeat(off[:-1].astype(np.int32), size + 1)
    left = np.repeat(size.astype(np.int32), size + 1) - place  # elements up to the segment's end
    at = np.flatnonzero(left >= stride)  # a symbol fits; elsewhere a string ends
    code = np.zeros(len(value), np.int32)
    code[at] = distinct(window_hash(prefix, stride)[at])[2] + 1
    # Strings one after the other: by segment, then by phase; the last place of each is its end.
    string = np.repeat(np.arange(len(parts)) * stride, size + 1) + (place - place // stride * stride)
    order = stable_order(string)
    code, left, first = code[order], (left // stride)[order], (place < stride)[order]
    shards = min(SHARDS, len(parts))
    bound = np.searchsorted(off[:-1], np.linspace(0, len(value), shards + 1)[1:-1])
    cut = [0, *off[bound].tolist(), len(value)]
    transforms, suffixes = [], []
    for a, b in zip(cut[:-1], cut[1:]):
        if a == b:
            continue
        own = suffix_order(code[a:b], left[a:b], window // stride)
        before = np.zeros(b - a, np.int32)
        before[1:] = code[a: b - 1]
        before[first[a:b]] = 0  # the first place of a string
        transforms.append(before[own])
        suffixes.append(order[own + a])
    index, group = merge(transforms, window // stride)
    many, same = np.zeros(len(group), bool), group[1:] == group[:-1]
    many[1:] = same
    many[:-1] |= same
    flag = np.zeros(len(value), bool)
    flag[np.concatenate(suffixes)[index[np.flatnonzero(many)]]] = True
    return [flag[a: b - window] for a, b in zip(off[:-1], off[1:])]


def runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of every run of true entries."""
    edge = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with t1 and t2, two hashes that name the text (null: empty)."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(7), text)})


OCCURRENCE = "t1 long, t2 long, unit int, start int, size int, anchor long, segment long"


def occurrences(texts: DataFrame, readings: tuple[Reading, ...] = (BYTES,)) -> DataFrame:
    """All segments of all texts (t1, t2, text); ``unit`` is the reading's number, start and size count its elements."""

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in it:
            for b in batches(whole, PIECE):
                raw, off = flat_bytes(b.column("text"))
                t1, t2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("t1", "t2"))
                for unit, reading in enumerate(readings):
                    window = reading.window
                    if reading.words:
                        pieces = [(*word_values(raw, off), 0)]
                    elif len(off) > 2 or len(raw) <= 2 * PIECE:
                        pieces = [(_CODE[raw], off, 0)]
                    else:
                        pieces = ((_CODE[raw[k: k + PIECE + window - 1]], np.array([0, min(PIECE + window - 1, len(raw) - k)]), k) for k in range(0, len(raw), PIECE))
                    for data, o, shift in pieces:
                        text, start, size, anchor, own = segments(data, o, reading)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(t1[text]), pa.array(t2[text]), pa.array(np.full(len(text), unit, np.int32)), pa.array((start - o[text] + shift).astype(np.int32)), pa.array(size.astype(np.int32)),
                            pa.array(mix(anchor ^ np.uint64(unit)).view(np.int64)), pa.array(mix(own ^ np.uint64(unit)).view(np.int64)),
                        ], names=["t1", "t2", "unit", "start", "size", "anchor", "segment"])

    return texts.mapInArrow(run, OCCURRENCE)


def _elements_of(texts: DataFrame, readings: tuple[Reading, ...]) -> DataFrame:
    """(unit, anchor, segment, bytes) of the wanted places of each text (text, want)."""

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        def out(rows):
            cols = list(zip(*rows)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["unit", "anchor", "segment", "bytes"])

        for whole in it:
            for b in batches(whole):
                raw, off = flat_bytes(b.column("text"))
                data = [(word_values(raw, off) if r.words else (raw, off)) for r in readings]
                rows = []
                for t, want in enumerate(b.column("want").to_pylist()):
                    for w in want:
                        value, o = data[w["unit"]]
                        a = int(o[t]) + w["start"]
                        rows.append((w["unit"], w["anchor"], w["segment"], value[a: a + w["size"]].tobytes()))
                        if len(rows) >= 4096:
                            yield out(rows)
                            rows = []
                yield out(rows)

    return texts.select("text", "want").mapInArrow(run, "unit int, anchor long, segment long, bytes binary")


def _merged(parts: DataFrame, readings: tuple[Reading, ...] = (BYTES,)) -> DataFrame:
    """(anchor, segment, first, last): runs of repeated windows of the contested segments."""

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        now, held, keys, size, seen = None, [], [], 0, set()

        def solve():
            found = repeated_windows(held, readings[now[0]])
            rows = [(*k, a, z) for k, flag in zip(keys, found) for a, z in zip(*(x.tolist() for x in runs(flag)))]
            cols = list(zip(*rows)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["anchor", "segment", "first", "last"])

        for b in it:
            for unit, anchor, own, data in zip(*(b.column(c).to_pylist() for c in ("unit", "anchor", "segment", "bytes"))):
                if (unit, anchor) != now:
                    if held and (size >= MERGE_BYTES or unit != now[0]):
                        yield solve()
                        held, keys, size = [], [], 0
                    now, seen = (unit, anchor), set()
                if own not in seen:
                    seen.add(own)
                    held.append(data)
                    keys.append((anchor, own))
                    size += len(data) // (8 if readings[unit].words else 1)
        if held:
            yield solve()
        release()

    return parts.repartition("unit", "anchor").sortWithinPartitions("unit", "anchor").mapInArrow(run, "anchor long, segment long, first long, last long")


def _counted(parts: DataFrame, readings: tuple[Reading, ...] = (BYTES,)) -> DataFrame:
    """As ``_merged``, for anchors with too many segments: windows with equal 128-bit hashes are counted, map-side first."""

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        for b in it:
            for unit, anchor, own, data in zip(*(b.column(c).to_pylist() for c in ("unit", "anchor", "segment", "bytes"))):
                value, window = values_of(data, readings[unit]), readings[unit].window
                at = np.arange(len(value) - window + 1)
                names = [span_hash(prefix_sums(v), at, at + window).view(np.int64) for v in (value, mix(value))]
                yield pa.RecordBatch.from_arrays([pa.array(names[0]), pa.array(names[1]), pa.array([anchor] * len(at), pa.int64()), pa.array([own] * len(at), pa.int64()), pa.array(at)], names=["w1", "w2", "anchor", "segment", "first"])

    windows = stored(parts.dropDuplicates(["anchor", "segment"]).mapInArrow(run, "w1 long, w2 long, anchor long, segment long, first long"), "windows")
    many = windows.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2")
    return windows.join(many, ["w1", "w2"], "left_semi").select("anchor", "segment", "first", F.col("first").alias("last"))


def repeats(docs: DataFrame, readings: tuple[Reading, ...] = (BYTES,)) -> DataFrame:
    """(t1, t2, ranges): reading, first and last start of repeated windows, one row per distinct text that has any."""
    texts = _keyed(docs.select("doc_id", "text"))
    seen = stored(occurrences(texts.select("t1", "t2", "text"), readings), "segments")
    place = F.struct("t1", "t2", "unit", "start", "size")
    kinds = stored(seen.groupBy("anchor", "segment").agg(F.count("*").alias("n"), F.min(place).alias("at")), "kinds")
    contested = kinds.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1")
    wanted = kinds.join(contested, "anchor").select("at.*", "anchor", "segment", "n", "k")
    wanted = stored(wanted, "wanted")
    by_text = wanted.groupBy("t1", "t2").agg(F.collect_list(F.struct("unit", "anchor", "segment", "start", "size")).alias("want"))
    # One row of each text; the ids only choose it.
    named = texts.select("t1", "t2", "doc_id").join(wanted.select("t1", "t2").distinct(), ["t1", "t2"], "left_semi").groupBy("t1", "t2").agg(F.min("doc_id").alias("doc_id"))
    by_text = stored(by_text.join(named, ["t1", "t2"]), "by_text")
    picked = F.broadcast(by_text) if wanted.count() <= BROADCAST_ROWS else by_text
    same = (F.col("x.t1") == F.col("y.t1")) & (F.col("x.t2") == F.col("y.t2")) & F.col("x.doc_id").eqNullSafe(F.col("y.doc_id"))
    parts = _elements_of(texts.alias("x").join(picked.alias("y"), same).select("x.text", "y.want"), readings)
    hot = wanted.where(F.col("k") > HOT_SEGMENTS).select("anchor").distinct()
    n_hot = hot.count()
    if n_hot:
        parts = stored(parts, "bytes")
        listed = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
        merged = _merged(parts.join(listed, "anchor", "left_anti"), readings).union(_counted(parts.join(listed, "anchor", "left_semi"), readings))
    else:
        merged = _merged(parts, readings)
    merged = stored(merged, "merged")
    single = wanted.where("n = 1").join(merged, ["anchor", "segment"]).select("t1", "t2", "unit", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last"))
    copies = seen.join(kinds.where("n > 1").select("anchor", "segment"), ["anchor", "segment"], "left_semi")
    window = F.element_at(F.array(*(F.lit(r.window) for r in readings)), F.col("unit") + 1)
    copies = copies.select("t1", "t2", "unit", F.col("start").cast("long").alias("first"), (F.col("start") + F.col("size") - window).cast("long").alias("last"))
    return single.union(copies.distinct()).groupBy("t1", "t2").agg(F.collect_list(F.struct("unit", "first", "last")).alias("ranges"))


def merged_spans(spans, size: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by ``spans`` (start, end)."""
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, min(z, size)) for a, z in out]


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(raw)]
    return b"".join(raw[edges[k]: edges[k + 1]] for k in range(0, len(edges), 2))


def _readings(passage: int | None) -> tuple[Reading, ...]:
    return (BYTES, of_words(passage)) if passage else (BYTES,)


def _with_ranges(docs: DataFrame, readings: tuple[Reading, ...]) -> DataFrame:
    """``docs`` with the repeated windows of each text; the texts stay in place while these are few enough to send."""
    found = stored(repeats(docs, readings), "ranges")
    n = found.agg(F.sum(F.size("ranges"))).first()[0] or 0
    joined = _keyed(docs).join(F.broadcast(found) if n <= BROADCAST_ROWS else found, ["t1", "t2"], "left")
    return joined.select(*docs.columns, F.col("ranges").alias("_ranges"))


def _spans_of(b, passage: int | None) -> Iterator[tuple[str | None, bytes, list[tuple[int, int]], list[tuple[int, int]]]]:
    """(text, its bytes, byte spans, passage spans) of the rows of an Arrow batch with _ranges."""
    ranges = b.column("_ranges").to_pylist()
    if passage and any(r["unit"] for own in ranges for r in own or ()):
        raw, off = flat_bytes(b.column("text"))
        start, end, first = word_places(raw, off)
    for t, (text, own) in enumerate(zip(b.column("text").to_pylist(), ranges)):
        data, own = (text or "").encode(), own or ()
        plain = [(r["first"], r["last"] + LENGTH) for r in own if not r["unit"]]
        said = [(int(start[first[t] + r["first"]] - off[t]), int(end[first[t] + r["last"] + passage - 1] - off[t])) for r in own if r["unit"]]
        yield text, data, merged_spans(plain, len(data)), merged_spans(said, len(data))


def mark(docs: DataFrame, passage: int | None = None) -> DataFrame:
    """``docs`` plus spans (removed byte ranges, start and end, maximal and ascending) and kept (the other bytes).

    Texts are UTF-8 bytes, null is the empty text; strings are judged on the
    input. Two rows with equal texts repeat each other; texts shorter than
    LENGTH bytes are untouched. With ``passage``, a column passages lists the
    byte ranges of so many words that occur in a row anywhere else (see
    ``cut``); spans and kept do not heed it. Existing columns of the names
    are replaced.
    """
    from pyspark.sql import types as T

    docs = docs.drop("spans", "kept", "t1", "t2", *(["passages"] if passage else []))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    more = [T.StructField("passages", span)] if passage else []
    schema = T.StructType([*docs.schema.fields, T.StructField("spans", span), T.StructField("kept", T.BinaryType()), *more])
    names = docs.columns

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        listed = lambda spans: [{"start": a, "end": z} for a, z in spans]
        for whole in it:
            for b in batches(whole):
                spans, kept, said = [], [], []
                for _, raw, own, passages in _spans_of(b, passage):
                    spans.append(listed(own))
                    kept.append(without(raw, own))
                    said.append(listed(passages))
                columns = [*(b.column(c) for c in names), pa.array(spans, kind), pa.array(kept, pa.binary()), *([pa.array(said, kind)] if passage else [])]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return _with_ranges(docs, _readings(passage)).mapInArrow(run, schema)


def cut(docs: DataFrame, passage: int | None = None) -> DataFrame:
    """``docs`` with the repeated bytes cut out of text; a character that loses a byte goes whole. Null texts stay null.

    With ``passage``, so many words that occur in a row anywhere else go, too,
    however few bytes they have, from the first word to the last. Words are
    those of ``common.words``, without ASCII punctuation at their edges.
    """
    names = docs.columns

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in it:
            for b in batches(whole):
                texts = []
                for text, raw, own, passages in _spans_of(b, passage):
                    if own or passages:
                        text = without(raw, merged_spans(own + passages, len(raw))).decode(errors="ignore")
                    texts.append(text)
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in names], names=names)

    return _with_ranges(docs, _readings(passage)).mapInArrow(run, docs.schema)
