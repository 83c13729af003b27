import collections
import hashlib

import numpy as np

from chainsift.llm import suffixdedup as S


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    n = collections.Counter(t[i: i + 400] for t in raw for i in range(len(t) - 399))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if n[t[i: i + 400]] > 1:
                gone[i: i + 400] = True
        out.append(gone)
    return out


def test_merged_transforms_find_all_repeats():
    rng = np.random.default_rng(5)
    for trial in range(20):
        base = rng.integers(97, 100, 3000).astype(np.uint8).tobytes()
        parts = []
        for _ in range(rng.integers(1, 9)):
            a = rng.integers(0, 2000)
            p = bytearray(base[a: a + rng.integers(400, 900)])
            if rng.random() < 0.5:
                p[rng.integers(0, len(p))] = 33
            if rng.random() < 0.2:
                p = bytearray(b"ab" * 300)
            parts.append(bytes(p))
        parts = list(dict.fromkeys(parts))
        n = collections.Counter(p[i: i + 400] for p in parts for i in range(len(p) - 399))
        assert [x.tolist() for x in S.repeated_windows(parts)] == [[n[p[i: i + 400]] > 1 for i in range(len(p) - 399)] for p in parts]


def corpus(prose):
    rng = prose.rng
    shared, other = prose(120), prose(90)
    rows = [shared, shared, other[:399], other[:400], "x" + other[:400] + "y", prose(300), "ab" * 500, "é" * 700, "é" * 200 + shared[:500] + "ñ" * 30, None, "", "short"]
    for _ in range(12):
        a = rng.randrange(0, 200)
        rows.append(prose(rng.randrange(5, 80)) + shared[a: a + rng.randrange(380, 460)] + prose(rng.randrange(5, 80)))
    return rows


def test_equals_brute_force(spark, docs_df, prose, monkeypatch):
    rows = corpus(prose)
    want = brute(rows)
    for merge, rows_sent, piece, hot in ((1 << 19, 1 << 18, 4 << 20, 1 << 14), (1, 0, 700, 3)):
        monkeypatch.setattr(S, "HOT_SEGMENTS", hot)
        monkeypatch.setattr(S, "MERGE_BYTES", merge)
        monkeypatch.setattr(S, "BROADCAST_ROWS", rows_sent)
        monkeypatch.setattr(S, "PIECE", piece)
        for r in S.mark(docs_df(list(enumerate(rows))).withColumnRenamed("n", "spans")).collect():
            raw, gone = np.frombuffer((rows[r.doc_id] or "").encode(), np.uint8), want[r.doc_id]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
            assert [(s.start, s.end) for s in r.spans] == list(zip(edge[::2].tolist(), edge[1::2].tolist())), r.doc_id
            assert hashlib.sha256(r.kept).digest() == hashlib.sha256(raw[~gone].tobytes()).digest()


def test_cut_leaves_whole_characters(spark, docs_df, prose):
    rows = corpus(prose)
    want = brute(rows)
    out = S.cut(docs_df(list(enumerate(rows))))
    assert out.columns == ["doc_id", "text", "lang", "source", "n"]
    for r in out.collect():
        if rows[r.doc_id] is None:
            assert r.text is None
        else:
            assert r.text == np.frombuffer(rows[r.doc_id].encode(), np.uint8)[~want[r.doc_id]].tobytes().decode(errors="ignore")


def test_repeated_rows_and_empty_table(spark, docs_df, prose):
    t = prose(200)
    got = S.mark(docs_df([(1, t), (1, t), (None, t), (2, prose(200))])).collect()
    assert sorted(len(r.kept) == 0 for r in got) == [False, True, True, True]
    assert S.mark(docs_df([])).count() == 0


def test_hash_of_every_window_and_edges_of_segments():
    """``window_hash`` names windows as ``span_hash`` does; segments stay inside their texts, those too short for a window included."""
    from chainsift.llm import common

    rng = np.random.default_rng(5)
    size = [0, 3, 30, 0, 7, 8, 100, 1, 0]
    off = np.concatenate([[0], np.cumsum(size)])
    value = common._CODE[rng.integers(97, 99, off[-1])]
    prefix = common.prefix_sums(value)
    for w in (1, 8, len(value), len(value) + 1):
        at = np.arange(max(0, len(value) - w + 1))
        assert np.array_equal(common.window_hash(prefix, w), common.span_hash(prefix, at, at + w))
    text, start, length, _, _ = S.segments(value, off, S.Reading(8, 2, 3))
    assert (start >= off[text]).all() and (start + length <= off[text + 1]).all()
    windows = sorted(k for a, n in zip(start.tolist(), length.tolist()) for k in range(a, a + n - 7))
    assert windows == [k for a, n in zip(off.tolist(), size) for k in range(a, a + n - 7)]
