import random
import zlib

import numpy as np
import pytest

from chainsift.llm import prefixbpe, pretokens, wavelet
from chainsift.llm.common import distinct

TEXTS = ["", None, "a", " ", "  ", "\n\n a", "it's  'tis 're'll we'll''s x's's", "I'M'd 'd", "  \t\n x", "a<|endoftext|>b <|endoftext|>", "日本語 テスト 🎉 x",
         "\u00a0 a\u00a0b", "\x1c a", "é'sé ²½ 12a3", "'", "''s", " 's", "\n's", "x 'll", "end  ", "\r\n\r\nx", "ǅ ɏ", "a'", "word " * 3000]


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_prefix_bpe_equals_the_library(vocabulary):
    rng = random.Random(1)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(" \n\t'stremvld.,!éA1²<|zq") for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    own, lib = prefixbpe.PrefixBPE(vocabulary), library(vocabulary)
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    got = own.encode(texts)
    assert [g.tolist() for g in got] == want
    assert [own.decode(g) for g in got] == [lib.decode(w, skip_special_tokens=False) for w in want]


def test_exactly_one_last_token(vocabulary):
    own = prefixbpe.PrefixBPE(vocabulary)
    for word in (" thereabouts", "antidisestablishment", " !!!!!!", "aaaaaaaaaaaa"):
        s = own.mapped(word)
        last = {0: -1}
        for n in range(1, len(s) + 1):
            fit = [t for k in range(n) for t in [own.vocab.get(s[k:n])] if t is not None and (own.alone(t) if k == 0 else own.alone(t) and own.undone(last[k], t, 1 << 60))]
            assert len(fit) == 1
            last[n] = fit[0]


def test_encode_decode_rows(spark, docs_df, vocabulary):
    df = docs_df(list(enumerate(TEXTS))).withColumnRenamed("n", "ids")  # clashing name
    lib = library(vocabulary)
    for r in prefixbpe.encode_decode(df, vocabulary).collect():
        assert r.ids == lib.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids and r.decoded == (TEXTS[r.doc_id] or "")
    assert prefixbpe.encode_decode(df.limit(0), vocabulary).count() == 0


@pytest.mark.parametrize("block", [1 << 19, 64])
@pytest.mark.parametrize("n", [0, 1, 5, 1500])
def test_wavelet_matrix(monkeypatch, block, n):
    monkeypatch.setattr(wavelet, "BLOCK_BITS", block)
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 50256).astype(np.uint32)
    w = wavelet.WaveletFile.of(wavelet.build(ids, [(None, n)]))
    assert (w.ids() == ids).all() and w.docs() == [[None, n]]
    assert [w.access(i) for i in range(0, n, 31)] == ids[::31].tolist()
    for t in [*set(ids.tolist()), 7, 99_999]:
        at = np.flatnonzero(ids == t)
        assert w.count(t) == len(at) and w.occurrences(t).tolist() == at.tolist()
        assert w.rank(t, n // 2) == int((ids[: n // 2] == t).sum()) and w.count(t, n // 3, n) == int((ids[n // 3:] == t).sum())
        for k in range(0, len(at), max(1, len(at) // 3)):
            assert w.select(t, k) == at[k]


def test_shards(spark, docs_df, vocabulary, monkeypatch, scratch):
    rows = [(None, "null id"), (7, "b"), (7, "a"), *((100 - k, t) for k, t in enumerate(TEXTS))]
    index = wavelet.write_shards(docs_df(rows), vocabulary, f"file://{scratch}/shards")
    lib, at = library(vocabulary), 0
    got = sorted(wavelet.read_documents(index).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 7, 7, *sorted(100 - k for k in range(len(TEXTS)))]
    for r, (_, text) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))):
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids))
        at += len(ids)
    assert wavelet.open_shard(index.first().path).count(0) >= 1
    assert wavelet.read_documents(wavelet.write_shards(docs_df([]), vocabulary)).count() == 0


def test_new_pretokens_cost_no_object_each(vocabulary, monkeypatch):
    """Many pre-tokens at once, cut into few inputs of the tokenizer, give the library's ids; so does a cache that starts anew."""
    from chainsift.llm import pretokens

    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdeé'1!\n") for _ in range(rng.randrange(1, 9))) for _ in range(300)) for _ in range(30)]
    monkeypatch.setattr(wavelet, "_LOADED", {})
    cache, whole, special = wavelet._tokenizer(vocabulary)
    calls, encode = [], cache.encode
    cache.encode = lambda words: calls.append(len(words)) or encode(words)
    want = [e.ids for e in library(vocabulary).encode_batch(texts, add_special_tokens=False)]
    for bound in (pretokens.CACHE_WORDS, 10):
        monkeypatch.setattr(pretokens, "CACHE_WORDS", bound)
        got = [i.tolist() for k in (0, 20) for i in pretokens.encode_texts(texts[k: k + 20], cache, whole, special)]
        assert got == want
    assert max(calls) > 2 * wavelet.BATCH_WORDS
    ids, sizes = encode(["a", " thereabouts", "é!"])
    assert len(ids) == sum(sizes) and list(sizes) == [len(library(vocabulary).encode(w, add_special_tokens=False).ids) for w in ("a", " thereabouts", "é!")]


def test_cache_asks_once_for_each_pre_token():
    """Half a million pre-tokens are remembered; met again, they are not encoded again."""
    asked = []

    def encode(words):
        asked.extend(words)
        return [len(w) for w in words for _ in range(2)], [2] * len(words)

    name = lambda k: "".join(chr(97 + k // 26**j % 26) for j in range(5))
    cache, texts = pretokens.WordCache(encode), [" ".join(map(name, range(a, a + 50_000))) for a in range(0, 500_000, 50_000)]
    first = [cache.ids([t])[0] for t in texts]
    n = len(asked)
    assert n == len(set(asked)) >= 500_000
    for t, ids in zip(texts[::-1], first[::-1]):
        assert np.array_equal(cache.ids([t, t])[0], np.concatenate([ids, ids]))
    assert len(asked) == n and np.array_equal(first[0][:4], [5, 5, 6, 6])


def test_distinct_hashes_that_agree_in_their_upper_bits():
    rng = np.random.default_rng(3)
    for value in (rng.integers(0, 1 << 64, 5000, np.uint64), rng.integers(0, 40, 5000).astype(np.uint64), (rng.integers(0, 50, 5000).astype(np.uint64) << np.uint64(40)) + np.uint64(7), np.zeros(0, np.uint64)):
        for got, want in zip(distinct(value), np.unique(value, return_index=True, return_inverse=True)):
            assert np.array_equal(got, want)
