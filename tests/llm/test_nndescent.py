import numpy as np

from chainsift.llm import nndescent as N


def brute(rows):
    top = {r[0]: r[0] for r in rows}
    links = dict.fromkeys(top, 0)

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    fine = [r for r in rows if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    for k, (a, x, la) in enumerate(fine):
        for b, y, lb in fine[k + 1:]:
            if la == lb and len(x) == len(y):
                x1, y1 = np.float32(x).astype(float), np.float32(y).astype(float)
                if x1 @ y1 / np.linalg.norm(x1) / np.linalg.norm(y1) >= 0.93:
                    links[a] += 1
                    links[b] += 1
                    p, q = find(a), find(b)
                    top[max(p, q)] = min(p, q)
    return {i: (links[i], find(i), find(i) == i) for i in top}


def test_recall_and_precision(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL", 16)
    monkeypatch.setattr(N, "TILE", 20)
    rng, rows = np.random.default_rng(3), []
    for size in [1] * 120 + [2] * 30 + [5] * 6 + [70, 25]:
        base, label = rng.standard_normal(32), int(rng.integers(0, 2))
        rows += [(base + 0.12 * rng.standard_normal(32) * (size > 1), label) for _ in range(size)]
    rows = [(k, [float(v) for v in x], label) for k, (x, label) in enumerate(rows)]
    rows += [(len(rows) + j, rows[j][1], rows[j][2]) for j in (0, 0, 300)]  # equal vectors
    rows += [(5000 + j, x, label) for j, (x, label) in enumerate([(None, 0), ([], 0), ([0.0] * 32, 0), ([float("nan")] * 32, 1), ([None] * 32, 0), (rows[0][1], None), ([1.0, 2.0], 0), ([float("inf")] + [0.0] * 31, 0)])]
    df, recall = N.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS c"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in want)  # nothing below the threshold
    assert sum(g[0] for g in got.values()) >= 0.98 * sum(w[0] for w in want.values())
    assert recall >= 0.9
    for i in range(5000, 5008):
        assert got[i] == (0, i, True)


def test_empty_table(spark):
    df, _ = N.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert df.count() == 0
