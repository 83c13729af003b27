import collections
import re
import string

import numpy as np

import corpus_pipeline as C


def brute(texts, bytes_=400, passage=51):
    """Texts without the bytes that a repeated 400-byte string or a repeated passage of words covers."""
    raw = [(t or "").encode() for t in texts]
    n = collections.Counter(t[i: i + bytes_] for t in raw for i in range(len(t) - bytes_ + 1))
    edge = string.punctuation.encode()
    places = []
    for t in raw:
        own = []
        for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", t):
            left = len(m[0]) - len(m[0].lstrip(edge))
            own.append((m.start() + left, m.start() + left + len(m[0].strip(edge)), m[0].strip(edge).lower()))
        places.append(own)
    k = collections.Counter(tuple(w[2] for w in p[i: i + passage]) for p in places for i in range(len(p) - passage + 1))
    out = []
    for t, p in zip(raw, places):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - bytes_ + 1):
            if n[t[i: i + bytes_]] > 1:
                gone[i: i + bytes_] = True
        for i in range(len(p) - passage + 1):
            if k[tuple(w[2] for w in p[i: i + passage])] > 1:
                gone[p[i][0]: p[i + passage - 1][1]] = True
        out.append(np.frombuffer(t, np.uint8)[~gone].tobytes().decode(errors="ignore"))
    return out


def test_stage_cuts_every_passage_of_over_50_words(spark, prose):
    rng = prose.rng
    passages = [prose(n) for n in (50, 51, 55, 62, 120)]
    assert all(len(p) < 400 for p in passages[:4])
    texts = [f"{prose(rng.randrange(0, 90))} {p} {prose(rng.randrange(0, 90))}".strip() for p in passages for _ in range(4)]
    texts += [f'{prose(30)} "{passages[1]}." {prose(30)}', passages[2].replace(" ", "\n"), "..", "", "é ü " * 60, prose(80), "x" * 900, f"{'x' * 900}y"]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in C.suffix_array_dedup(spark, docs, "").collect()}
    want = brute(texts)
    assert got == {k: (t, len(t)) for k, t in enumerate(want)}
    assert all(passages[0] in t for t in want[:4]) and not any(p in t for t in want for p in passages[1:])


def test_marked_passages_and_long_texts(spark, prose, monkeypatch):
    """Passage spans equal brute force while the byte spans stay as they are; a long text is read in pieces."""
    from chainsift.llm import suffixdedup as S

    rng = prose.rng
    passages = [prose(n) for n in (50, 51, 70)]
    texts = [f"{prose(rng.randrange(0, 60))} {p} {prose(rng.randrange(0, 60))}" for p in passages for _ in range(3)] + [prose(900) + " " + passages[2] + " " + prose(900), None, "", "solo " * 200]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    plain = {r.doc_id: (r.spans, r.kept) for r in S.mark(docs).collect()}
    want = brute(texts, bytes_=10**9)  # passages only
    for piece in (S.PIECE, 900):
        monkeypatch.setattr(S, "PIECE", piece)
        for r in S.mark(docs, 51).collect():
            raw = (texts[r.doc_id] or "").encode()
            assert (r.spans, r.kept) == plain[r.doc_id]
            assert S.without(raw, [(s.start, s.end) for s in r.passages]).decode() == want[r.doc_id], r.doc_id
