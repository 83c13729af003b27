import numpy as np
import pytest

from chainsift.llm import nndescent as N
from test_nndescent import brute


def groups(rng, sizes, far, dim=32):
    """Tight groups (cosine about 0.99 inside) around centres ``far`` apart by cosine from the first."""
    axes = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    rows = []
    for k, n in enumerate(sizes):
        centre = axes[0] if k == 0 else far * axes[0] + np.sqrt(1 - far**2) * axes[k]
        rows += [centre + 0.1 / np.sqrt(dim) * rng.standard_normal(dim) for _ in range(n)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(k, [float(v) for v in x], 1) for k, x in enumerate(rows)], "vec_id long, embedding array<float>, label int")


def test_tight_groups_that_link(spark, monkeypatch):
    monkeypatch.setattr(N, "TILE", 64)
    monkeypatch.setattr(N, "PART_BYTES", 4000, raising=False)
    monkeypatch.setattr(N, "SENT_BYTES", 20000, raising=False)
    rng = np.random.default_rng(1)
    rows = groups(rng, [200, 200, 150], 0.95) + list(rng.standard_normal((60, 32)))
    df, recall = N.near_duplicates(table(spark, rows))
    want = brute([(k, [float(v) for v in x], 1) for k, x in enumerate(rows)])
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()} == want
    assert recall == 1.0
    assert want[200][1] == 0 and want[0][0] > 400


def test_tiles_far_apart_are_not_compared(monkeypatch):
    calls = []
    plain = N.linked
    monkeypatch.setattr(N, "TILE", 64)
    monkeypatch.setattr(N, "linked", lambda *x: calls.append(1) or plain(*x))
    rows = np.array(groups(np.random.default_rng(2), [64, 64, 64], 0.1))
    tiles = N.Tiles(np.repeat([1, 2, 3], 64), rows / np.linalg.norm(rows, axis=1, keepdims=True), np.ones(192, np.int64))
    links, joined = tiles.meet(tiles)
    assert links.tolist() == [64] * 192 and not joined and len(calls) == 3


def test_audit_raises_for_one_lost_link(spark):
    rows = list(np.random.default_rng(4).standard_normal((80, 32)))
    rows += [rows[0] + 0.01, *groups(np.random.default_rng(5), [100], 1)]  # one isolated pair beside a dense group
    vecs = [np.asarray(x, "<f4").tobytes() for x in rows]
    classes = spark.createDataFrame([(k, "1/32", 1, v) for k, v in enumerate(vecs)], "c long, g string, m long, vec binary")
    links = (N.cosines(N._matrix(vecs, "<f4"), N._matrix(vecs, "<f4")) >= N.LINK).sum(axis=1) - 1
    assert links[0] == links[80] == 1

    def found(n):
        return spark.createDataFrame([(k, int(x)) for k, x in enumerate(n)], "c long, n_links long")

    assert N.audit(found(links), classes, "<f4") == (links.sum(), links.sum())
    links[0] = 0
    with pytest.raises(RuntimeError, match="1 of 181"):
        N.audit(found(links), classes, "<f4")
