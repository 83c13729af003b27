"""Byte-level pre-tokens of many texts at once, and a cache from pre-token to ids.

The split pattern of the byte-level vocabularies is applied with NumPy to
texts whose characters all lie below U+0250 (classes there are settled); a
text with any other character, or with the special token's string, goes to
the caller's whole-text path instead. Both give the same ids.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Callable

import numpy as np

from chainsift.llm.common import distinct, mix, prefix_hash, span_hash

OTHER, LETTER, NUMBER, SPACE, UNSAFE = 0, 1, 2, 3, 4
SAFE_BELOW = 0x250


def _classes() -> np.ndarray:
    out = np.full(SAFE_BELOW + 1, UNSAFE, np.uint8)
    for c in range(SAFE_BELOW):
        kind = unicodedata.category(chr(c))
        out[c] = LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else OTHER
    out[9:14] = out[32] = SPACE
    out[0x1C:0x20] = out[0x85] = out[0xA0] = UNSAFE  # white space to some libraries, not to others
    return out


_CLASS = _classes()
_CHAR_CODE = mix(np.arange(1, SAFE_BELOW + 2, dtype=np.uint64))
#: Entries that a cache holds before it starts anew; bounds a worker's memory.
CACHE_WORDS = 1 << 21


def split(cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Start positions of the pre-tokens of concatenated safe texts (code points ``cp``, text offsets ``off``)."""
    n = len(cp)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = _CLASS[cp]
    first = np.zeros(n + 1, bool)
    first[off] = True
    last = first[1:]
    first = first[:-1]
    prev = np.concatenate([[OTHER], kind[:-1]]).astype(np.uint8)
    after = np.concatenate([kind[1:], [SPACE]]).astype(np.uint8)
    prev_blank = np.concatenate([[False], cp[:-1] == 32])
    space = kind == SPACE
    start = np.where(space, (prev != SPACE) | ((after != SPACE) & ~last), (kind != prev) & ~prev_blank) | first
    quotes = np.flatnonzero((cp == 39) & (first | (prev == LETTER) | (prev == NUMBER) | ((prev == SPACE) & ~prev_blank)))
    if len(quotes):
        end = off[np.searchsorted(off, quotes, side="right")]  # end of the quote's text
        ch = lambda k: np.where(quotes + k < end, cp[np.minimum(quotes + k, n - 1)], 0)
        one, two = ch(1), ch(2)
        is_ = lambda a, s: a == ord(s)
        short = is_(one, "s") | is_(one, "t") | is_(one, "m") | is_(one, "d")
        long = (is_(one, "r") & is_(two, "e")) | (is_(one, "v") & is_(two, "e")) | (is_(one, "l") & is_(two, "l"))
        for hit, size in ((quotes[short], 2), (quotes[long], 3)):
            start[hit + 1] = False
            rest = hit + size
            inside = rest < end[short if size == 2 else long]
            start[rest[inside]] = True
    return np.flatnonzero(start)


class WordCache:
    """ids of pre-tokens by hash, filled through ``encode`` (list of pre-tokens -> their ids in one list, number of ids of each).

    ``keys`` are the hashes in ascending order, ``slot`` the place of each in
    ``off``, the offsets of its ids in ``flat``.
    """

    def __init__(self, encode: Callable[[list[str]], tuple]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.off, self.flat = array("q", [0]), array("I")

    def _add(self, at: np.ndarray, keys: np.ndarray) -> None:
        """Takes in new keys, each before the entry ``at``."""
        to, n = at + np.arange(len(at)), len(self.keys) + len(at)
        old = np.ones(n, bool)
        old[to] = False
        old = np.flatnonzero(old)
        base = len(self.keys)
        for name, own in (("keys", keys), ("slot", np.arange(base, n, dtype=np.int32))):
            whole = np.empty(n, own.dtype)
            whole[old], whole[to] = getattr(self, name), own
            setattr(self, name, whole)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, id offsets by text) of safe texts."""
        joined = "".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
        starts = split(cp, off)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        ends = np.append(starts[1:], len(cp))
        word, index, inverse = distinct(span_hash(prefix_hash(cp, _CHAR_CODE), starts, ends))
        if len(self.keys) + len(word) > CACHE_WORDS:
            self.clear()
        at = np.searchsorted(self.keys, word)
        fresh, inside = np.ones(len(word), bool), np.flatnonzero(at < len(self.keys))
        fresh[inside] = self.keys[at[inside]] != word[inside]
        new = np.flatnonzero(fresh)
        if len(new):
            first = index[new]
            got, sizes = self.encode([joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())])
            self._add(at[new], word[new])
            k = len(self.flat)
            self.flat.extend(got)
            self.off.extend((k + np.cumsum(sizes, dtype=np.int64)).tolist())
            at = at + np.cumsum(fresh) - fresh
        slot = self.slot[at]
        all_off, flat = np.frombuffer(self.off, np.int64), np.frombuffer(self.flat, np.uint32)  # no copies; let go before the arrays grow
        begin, size = all_off[slot][inverse], (all_off[slot + 1] - all_off[slot])[inverse]
        done = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.repeat(begin - done[:-1], size) + np.arange(done[-1])]
        return ids, done[np.searchsorted(starts, off)]


def encode_texts(texts: list[str], cache: WordCache, whole: Callable[[str], list[int]], special: str) -> list[np.ndarray]:
    """ids of every text; ``whole`` encodes the texts that the vectorised split leaves out."""
    safe = []
    for t in texts:
        ok = special not in t
        if ok and not t.isascii():
            cp = np.frombuffer(t.encode("utf-32-le"), "<u4")
            ok = not (_CLASS[np.minimum(cp, SAFE_BELOW)] == UNSAFE).any()
        elif ok:
            ok = not any(chr(c) in t for c in range(0x1C, 0x20))
        safe.append(ok)
    ids, off = cache.ids([t for t, ok in zip(texts, safe) if ok])
    out, k = [], 0
    for t, ok in zip(texts, safe):
        if ok:
            out.append(ids[off[k]: off[k + 1]])
            k += 1
        else:
            out.append(np.array(whole(t), np.uint32))
    return out
