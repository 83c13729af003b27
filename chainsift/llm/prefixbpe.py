"""BPE encoding by dynamic programming over prefixes, and decoding.

Every prefix of a pre-token has exactly one last token: among the vocabulary
entries that end there (found by a suffix-matching automaton over all
entries) the one whose pair with the last token of the shorter prefix is
compatible, that is, the merges of the two strings joined give these two
tokens again. Following the back-pointers from the end gives the ids that the
merge rules give.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from chainsift.llm.common import batches
from chainsift.llm.pretokens import WordCache, encode_texts

#: Pairs whose compatibility is remembered before the memory starts anew.
PAIR_MEMORY = 200_000


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(rest)}


class PrefixBPE:
    """Encoder and decoder of one byte-level vocabulary file (``tokenizers`` JSON)."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank: dict[int, int] = {}  # rank of a pair of ids (left << 20 | right)
        self.made: dict[int, tuple[int, int, int]] = {}  # rank, left and right part of the merge that makes a token
        for k, (x, y) in enumerate(pairs):
            i, j = self.vocab[x], self.vocab[y]
            self.rank.setdefault(i << 20 | j, k)
            self.made.setdefault(self.vocab[x + y], (k, i, j))
        self.text = {i: s for s, i in self.vocab.items()}
        letters = byte_letters()
        self.table = {b: s for b, s in letters.items()}
        back = {s: b for b, s in letters.items()}
        special = [a for a in spec["added_tokens"] if a["special"]]
        self.special, self.special_id = (special[0]["content"], special[0]["id"]) if special else ("\0none\0", -1)
        size = max([*self.vocab.values(), self.special_id]) + 1
        tokens = [b""] * size
        for s, i in self.vocab.items():
            tokens[i] = bytes(back[c] for c in s)
        if self.special_id >= 0:
            tokens[self.special_id] = self.special.encode()
        self.byte_len = np.array([len(t) for t in tokens], np.int64)
        self.byte_off = np.concatenate([[0], np.cumsum(self.byte_len)])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.match = ahocorasick.Automaton()
        for s, i in self.vocab.items():
            self.match.add_word(s, (len(s), i))
        self.match.make_automaton()
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        self.pair: dict[int, bool] = {}
        self.own: dict[int, bool] = {}
        self.cache = WordCache(self.encode_words)

    def mapped(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.table)

    def alone(self, t: int) -> bool:
        """Whether a token's own string is merged into that token: its two parts would meet and stay as they are until then."""
        got = self.own.get(t)
        if got is None:
            made = self.made.get(t)
            got = made is None or self.alone(made[1]) and self.alone(made[2]) and self.undone(made[1], made[2], made[0])
            self.own[t] = got
        return got

    def undone(self, a: int, b: int, before: int) -> bool:
        """Whether no merge of rank under ``before`` crosses the border of tokens a and b while both are being made.

        The merges inside the two tokens are taken back, the latest first.
        In the state before each of them the two pieces at the border must
        not have had an earlier merge; at equal rank the left one comes first.
        """
        rank, made = self.rank, self.made
        if rank.get(a << 20 | b, before) < before:
            return False
        none = (-1, 0, 0)
        x, y = made.get(a, none), made.get(b, none)
        while x[0] >= 0 or y[0] >= 0:
            if x[0] > y[0]:
                limit, a = x[0], x[2]
                x = made.get(a, none)
                if rank.get(a << 20 | b, limit) < limit:
                    return False
            else:
                limit, b = y[0], y[1]
                y = made.get(b, none)
                if rank.get(a << 20 | b, limit + 1) <= limit:
                    return False
        return True

    def compatible(self, a: int, b: int) -> bool:
        """Whether the strings of a and b joined are encoded as a, b (remembered for pairs met before)."""
        if len(self.pair) >= PAIR_MEMORY:
            self.pair.clear()
        got = self.pair[a << 20 | b] = self.undone(a, b, 1 << 60)
        return got

    def encode_words(self, words: list[str]) -> tuple[list[int], list[int]]:
        """ids of all pre-tokens in one list, and how many each has."""
        flat, sizes = [], []
        for w in words:
            ids = self.encode_mapped(self.mapped(w))
            flat += ids
            sizes.append(len(ids))
        return flat, sizes

    def encode_mapped(self, s: str) -> list[int]:
        """ids of one pre-token in byte letters."""
        n = len(s)
        last, size, pair = [-1] * (n + 1), [0] * (n + 1), self.pair
        for end, (k, t) in self.match.iter(s):
            end += 1
            if last[end] < 0:
                at = end - k
                if at:
                    p = last[at]
                    if p < 0:
                        continue
                    ok = pair.get(p << 20 | t)
                    if ok is None:
                        ok = self.alone(t) and self.compatible(p, t)
                else:
                    ok = self.alone(t)
                if ok:
                    last[end], size[end] = t, k
        out, at = [], n
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def encode_whole(self, text: str) -> list[int]:
        """Any text: the special token's string is its id, the rest is split by the library's own pre-tokenizer."""
        out: list[int] = []
        for k, part in enumerate(text.split(self.special)):
            if k:
                out.append(self.special_id)
            for piece, _ in self.pre.pre_tokenize_str(part) if part else ():
                out += self.encode_mapped(piece)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return encode_texts(texts, self.cache, self.encode_whole, self.special)

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """UTF-8 bytes of the ids."""
        size = self.byte_len[ids]
        done = np.cumsum(size)
        if not len(ids):
            return np.zeros(0, np.uint8)
        return self.bytes[np.repeat(self.byte_off[ids] - done + size, size) + np.arange(done[-1])]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).tobytes().decode("utf-8", "replace")


_LOADED: dict[str, PrefixBPE] = {}


def codec(path: str) -> PrefixBPE:
    """The vocabulary of this worker process, loaded once."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _LOADED[path] = PrefixBPE(path)
    return _LOADED[path]


def encode_decode(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``ids`` (array<int>) and ``decoded`` (the ids decoded again).

    Null and empty texts have no ids and decode to the empty text. Existing
    columns named ids or decoded are replaced; rows are independent, so
    repeated rows and ties need no rule.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    kept = docs.drop("ids", "decoded")
    schema = T.StructType([*kept.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    names = kept.columns

    def run(it: Iterator) -> Iterator:
        bpe = codec(vocabulary)
        for whole in it:
            named = whole.rename_columns([n if n != text else "text" for n in names])
            for part in batches(named):
                ids = bpe.encode([t or "" for t in part.column("text").to_pylist()])
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32), np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32))
                decoded = pa.array([bpe.decode(i) for i in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, lists, decoded], names=[*names, "ids", "decoded"])

    return kept.mapInArrow(run, schema)
