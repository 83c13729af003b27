import collections
import re

import numpy as np

from chainsift.llm import decontaminate as D


def bag(words):
    k = min(5, len(words))
    return collections.Counter(tuple(words[i: i + k]) for i in range(len(words) - k + 1))


def weight(shingle):
    return sum(len(w.encode()) for w in shingle)


def brute(docs, items):
    """Exact weighted similarity of every item-sized window: {(doc, item): (best similarity, earliest start, windows)}."""
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    out = {}
    for d, t in docs:
        words = cut(t)
        for i, text in items:
            item = cut(text)
            if not item or not words:
                continue
            n = min(len(item), len(words))
            for s in range(len(words) - n + 1):
                a, b = bag(words[s: s + n]), bag(item)
                both = sum(min(a[x], b[x]) * weight(x) for x in a)
                union = sum(c * weight(x) for x, c in a.items()) + sum(c * weight(x) for x, c in b.items()) - both
                if 5 * both >= 4 * union:
                    sim, at, k = out.get((d, i), (0, s, 0))
                    out[d, i] = (max(sim, both / union), at if sim >= both / union else s, k + 1)
    return out


def test_equals_brute_force(spark, docs_df, prose, monkeypatch):
    rng = prose.rng
    items = [(k, prose(n)) for k, n in enumerate([1, 3, 5, 8, 20, 20, 45, 60])]
    docs = []
    for k in range(60):
        w = rng.choice(items)[1].split()
        for _ in range(rng.choice([0, 0, 1, 3])):
            w[rng.randrange(len(w))] = "changed"
        docs.append((k, " ".join([prose(rng.randrange(0, 50)), rng.choice([str.upper, str.lower])(" ".join(w)), prose(rng.randrange(0, 50))])))
    docs += [(70, None), (71, ""), (72, items[7][1] + " " + items[7][1]), (73, items[6][1][:-3]), (74, prose(20_000))]
    want = brute(docs, items)
    bench = spark.createDataFrame(items + [(98, None), (99, ""), (99, "  "), items[4]], "item_id long, text string")
    for limit in (8 << 20, 50):  # the second takes the benchmark in several passes
        monkeypatch.setattr(D, "PASS_BYTES", limit)
        got = {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_windows) for r in D.leaks(docs_df(docs), bench).collect()}
        assert got == want


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    bench = D.Benchmark([(k, " ".join(f"w{rng.integers(1 << 30)}" for _ in range(12))) for k in range(200)])
    for _ in range(300):
        p = int(bench.prints[rng.integers(0, 200)])
        for b in rng.choice(64, rng.integers(0, 26), replace=False):
            p ^= 1 << int(b)
        want = np.flatnonzero(D.distance(bench.prints, np.uint64(p)) <= D.RADIUS).tolist()
        assert bench.near(12, p) == want


def test_drop_leaked_repeated_rows_and_empty_tables(spark, docs_df, prose):
    item = prose(30)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = docs_df([(1, item), (1, item), (2, prose(100)), (None, item), (3, prose(10) + " " + item.upper())])
    assert D.leaks(docs, bench).count() == 4
    left = D.drop_leaked(docs, bench)
    assert sorted((r.doc_id for r in left.collect()), key=str) == [2, None] and left.columns == docs.columns
    assert D.leaks(docs_df([]), bench).count() == 0
    assert D.leaks(docs, bench.limit(0)).count() == 0
