import collections
import re

import pytest
from pyspark.sql import functions as F

from chainsift.llm import ngramjoin as J


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k: k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(prose):
    rng, rows = prose.rng, []
    common = prose(60)
    for g in range(12):
        base = prose(rng.choice([3, 8, 30, 120])).split()
        for _ in range(rng.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = "changed"
            rows.append(" ".join(w))
    rows += [common + " " + prose(5) for _ in range(10)] + [common + " " + prose(200) for _ in range(4)]
    rows += ["", None, "   ", "one", "one", "ONE", "a b c d", "a  b\tc\nd", "a b c e", "x " * 3000]
    return list(enumerate(rows))


@pytest.mark.parametrize("cluster,block,size,query", [(4000, 256, 16 << 20, 8 << 20), (3, 2, 16 << 20, 8 << 20), (4000, 256, 60000, 30000)])
def test_equals_brute_force(spark, docs_df, prose, monkeypatch, cluster, block, size, query):
    monkeypatch.setattr(J, "CLUSTER", cluster)
    monkeypatch.setattr(J, "QUERY_BLOCK", block)
    monkeypatch.setattr(J, "CLUSTER_BYTES", size)
    monkeypatch.setattr(J, "QUERY_BYTES", query)
    rows = corpus(prose)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(docs_df(rows)).collect()}
    assert got == brute(rows)


def test_frequent_shingles_only_order_the_search(spark, docs_df, prose, monkeypatch):
    monkeypatch.setattr(J, "OFTEN", 1)
    rows = corpus(prose)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(docs_df(rows)).collect()}
    assert got == brute(rows)


def test_search_finds_all_links(prose):
    import numpy as np

    rng = np.random.default_rng(1)
    sets = []
    for _ in range(8):
        base = rng.integers(0, 1 << 40, rng.integers(5, 60)).astype(np.uint64)
        for _ in range(rng.integers(1, 9)):
            s = base.copy()
            s[rng.integers(0, len(s), 2)] = rng.integers(0, 1 << 40, 2)
            sets.append(np.unique(s))
    lists = J.Lists(sets)
    for k, s in enumerate(sets):
        want = {m for m, t in enumerate(sets) if J.linked(len(s), len(t), len(np.intersect1d(s, t)))}
        assert set(lists.search(s, lambda m: False)) == want


def test_repeated_rows_null_ids_and_empty_table(spark, docs_df):
    text = "one two three four five six seven"
    got = sorted(J.join(docs_df([(5, text), (5, text), (3, text), (None, text), (9, "")])).collect(), key=str)
    assert collections.Counter((r.doc_id, r.component_id) for r in got) == {(5, 3): 2, (3, 3): 1, (None, 3): 1, (9, 9): 1}
    assert J.join(docs_df([])).count() == 0


def test_one_of_each_keeps_one(spark, docs_df):
    text = "one two three four five six seven"
    out = J.one_of_each(docs_df([(5, text), (3, text), (3, text), (9, ""), (8, "other words here"), (None, "x")]))
    assert sorted((r.doc_id for r in out.collect()), key=str) == [3, 8, 9, None]
    assert out.columns == ["doc_id", "text", "lang", "source", "n"]


def test_most_frequent_is_bounded(spark, monkeypatch):
    counts = spark.createDataFrame([(k, 3 + k % 40) for k in range(1000)], "a long, n long")
    monkeypatch.setattr(J, "MAX_FREQUENT", 300)
    got = J.most_frequent(counts)
    assert 0 < len(got) <= 300 and sorted(got.tolist()) == got.tolist()
    assert {k for k in range(1000) if 3 + k % 40 >= 32} == set(got.tolist())
    assert len(J.most_frequent(counts.limit(0))) == 0


def test_many_long_near_copies_are_cut_by_bytes(spark, docs_df, prose, monkeypatch):
    """1,200 near copies of a long text: no piece holds them all, one component comes out."""
    monkeypatch.setattr(J, "CLUSTER_BYTES", 3 << 20)
    rng, base = prose.rng, prose(900).split()
    rows = []
    for k in range(1200):
        w = list(base)
        w[rng.randrange(len(w))] = f"w{k}"
        rows.append((k, " ".join(w)))
    rows += [(5000, prose(900)), (5001, None)]
    sizes, solve = [], J._solve_groups

    def spy(groups, key):
        sizes.extend(r.m for r in groups.groupBy(key).agg(F.sum(F.length("shingles")).alias("m")).collect())
        return solve(groups, key)

    monkeypatch.setattr(J, "_solve_groups", spy)
    got = {r.doc_id: r.component_id for r in J.join(docs_df(rows)).collect()}
    assert got == {**dict.fromkeys(range(1200), 0), 5000: 5000, 5001: 5001}
    assert 3 < len(sizes) and max(sizes) < 4 << 20 < sum(sizes)


def chance_meetings(prose):
    """Texts that share a short passage with each of many others, too little to link, and a few copies that do link."""
    rng, texts, met = prose.rng, [[] for _ in range(60)], set()
    while len(met) < 360:
        a, b = rng.sample(range(60), 2)
        if (min(a, b), max(a, b)) not in met:
            met.add((min(a, b), max(a, b)))
            passage = prose(8)
            texts[a].append(passage)
            texts[b].append(passage)
    rows = [" ".join(t) for t in texts]
    return list(enumerate(rows + [rows[0] + " more", rows[7] + " of", "an " + rows[7]]))


def test_chance_meetings_do_not_make_a_large_cluster(spark, docs_df, prose, monkeypatch):
    rows = chance_meetings(prose)
    monkeypatch.setattr(J, "CLUSTER", 10)
    monkeypatch.setattr(J, "_join_blocks", lambda *a: pytest.fail("searched in rounds"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(docs_df(rows)).collect()}
    assert got == brute(rows) and len({c for _, c in got.values()}) == 60


def test_split_clusters_keep_all_links(spark, docs_df, prose, monkeypatch):
    """Lists of more than two classes count as long ones here."""
    monkeypatch.setattr(J, "CLUSTER", 10)
    monkeypatch.setattr(J, "PAIR_LISTS", (2,))
    common = prose(60)
    rows = chance_meetings(prose) + [(1000 + k, common + " " + prose(k)) for k in (1, 2, 3, 4, 90, 95)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(docs_df(rows)).collect()}
    assert got == brute(rows)
