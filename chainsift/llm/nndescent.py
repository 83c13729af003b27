"""Embedding near-duplicates over a neighbour graph refined by NN-descent.

Vectors compare only inside their label. Equal vectors are one class. Lists of
nearest classes start from cells of random hyperplanes and are refined by
comparing neighbours of neighbours; a list whose last entry is still a link is
enlarged. The lists are bounded, so they only say which classes lie together:
their links join classes to first components, whose classes fill tiles. Then
every tile meets every other of its label, except where the angle between the
centres, less both radii, leaves no room for a link. That counts all links and
joins the components that the lists left apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainsift.llm.common import components, new_dir, prefix_hash, span_hash, stored

#: Cosine (in double precision) from which two vectors link.
LINK = 0.93
#: First length of a neighbour list and the length up to which saturated lists are doubled while the graph is refined.
NEIGHBOURS, MOST_NEIGHBOURS = 8, 32
#: Random partitions per start, and the aimed size of their cells; larger cells are cut into chunks of twice that.
PARTITIONS, CELL = 3, 128
#: Rounds of refinement.
ROUNDS = 3
#: Queries of the audit (about), compared with all vectors.
AUDIT = 1000
#: Classes in a tile; a component with a quarter of that has tiles of its own.
TILE = 512
#: Bytes of vectors that a task's partition of tiles aims at, and that are sent to all tasks at once to meet their tiles.
PART_BYTES, SENT_BYTES = 8 << 20, 32 << 20


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of all rows in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T


def vectors(table: DataFrame, dtype: str) -> DataFrame:
    """(vec_id, g, c, vec) of the valid rows: group of label and size, class of equal vectors, bytes."""

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        for b in it:
            ids, labels, lists = b.column("vec_id").to_pylist(), b.column("label").to_pylist(), b.column("embedding")
            out = []
            for vec_id, label, e in zip(ids, labels, lists):
                if label is None or not e.is_valid or not len(e) or e.values.null_count:
                    continue
                v = np.asarray(e.values.to_numpy(zero_copy_only=False), dtype) + 0
                n = float((v.astype(np.float64) ** 2).sum())
                if np.isfinite(n) and n > 0:
                    out.append((vec_id, f"{label}/{len(v)}", v.tobytes()))
            names = [o[1].encode() + b"|" + o[2] for o in out]
            raw = np.frombuffer(b"".join(names), np.uint8)
            end = np.cumsum([len(n) for n in names], dtype=np.int64)
            c = span_hash(prefix_hash(raw), end - np.array([len(n) for n in names], np.int64), end) if out else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string()), pa.array(c.view(np.int64)), pa.array([o[2] for o in out], pa.binary())], names=["vec_id", "g", "c", "vec"])

    return table.select("vec_id", "label", "embedding").mapInArrow(run, "vec_id long, g string, c long, vec binary")


def _groups(it: Iterator, keys: list[str]) -> Iterator:
    """Frames of equal keys from batches sorted by them; a frame is cut nowhere."""
    import pandas as pd

    held = None
    for pdf in it:
        if held is not None:
            pdf = pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        change = np.zeros(len(pdf), bool)
        for k in keys:
            col = pdf[k].to_numpy()
            change[1:] |= col[1:] != col[:-1]
        at = [0, *np.flatnonzero(change).tolist()]
        for a, b in zip(at[:-1], at[1:]):
            yield pdf.iloc[a:b]
        held = pdf.iloc[at[-1]:]
    if held is not None and len(held):
        yield held


def _matrix(vecs, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), dtype).reshape(len(vecs), -1)


class _Best:
    """Collects (u, v, sim) and gives the best entries of each u, as frames."""

    def __init__(self, most: int):
        self.most, self.parts, self.size = most, [], 0

    def add(self, u, v, sim):
        self.parts.append((u, v, sim))
        self.size += len(u)
        return self.size >= 2_000_000

    def frame(self):
        import pandas as pd

        if not self.parts:
            return pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64), "sim": np.zeros(0)})
        u, v, sim = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.size = [], 0
        order = np.lexsort((v, -sim, u))
        u, v, sim = u[order], v[order], sim[order]
        fresh = np.ones(len(u), bool)
        fresh[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
        u, v, sim = u[fresh], v[fresh], sim[fresh]
        first = np.concatenate([[True], u[1:] != u[:-1]])
        place = np.arange(len(u)) - np.maximum.accumulate(np.where(first, np.arange(len(u)), 0))
        keep = place < self.most
        return pd.DataFrame({"u": u[keep], "v": v[keep], "sim": sim[keep]})


NEAR = "u long, v long, sim double"


def start(classes: DataFrame, dtype: str, seed: int) -> DataFrame:
    """First neighbours: the nearest classes inside cells of random hyperplanes."""
    sizes = classes.groupBy("g").agg(F.count("*").alias("n"))
    bits = classes.join(sizes, "g").select("g", "c", "vec", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / CELL))).cast("int").alias("bits"))

    def cells(it: Iterator) -> Iterator:
        import pandas as pd

        planes: dict[int, np.ndarray] = {}
        for pdf in it:
            for dim, part in pdf.groupby(pdf.vec.map(len), sort=False):
                x = _matrix(part.vec.to_list(), dtype).astype(np.float64)
                if dim not in planes:
                    planes[dim] = np.random.default_rng(seed).standard_normal((x.shape[1], PARTITIONS * 62))
                side = x @ planes[dim] > 0
                for t in range(PARTITIONS):
                    code = np.zeros(len(part), np.int64)
                    for j in range(62):
                        code |= np.where(j < part.bits.to_numpy(), side[:, t * 62 + j], False).astype(np.int64) << j
                    yield pd.DataFrame({"g": part.g.to_numpy(), "t": t, "cell": code, "c": part.c.to_numpy(), "vec": part.vec.to_numpy()})

    dealt = stored(bits.mapInPandas(cells, "g string, t int, cell long, c long, vec binary"), "cells")
    full = dealt.groupBy("g", "t", "cell").agg(F.count("*").alias("k"))
    dealt = dealt.join(full, ["g", "t", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("c", F.lit(seed)), F.ceil(F.col("k") / (2 * CELL)))).drop("k")

    def near(it: Iterator) -> Iterator:
        best = _Best(NEIGHBOURS)
        for part in _groups(it, ["g", "t", "cell", "chunk"]):
            c, x = part.c.to_numpy(), _matrix(part.vec.to_list(), dtype)
            sim = cosines(x, x)
            np.fill_diagonal(sim, -2)
            k = min(NEIGHBOURS, len(c) - 1)
            if k > 0:
                to = np.argpartition(-sim, k - 1, axis=1)[:, :k]
                if best.add(np.repeat(c, k), c[to].reshape(-1), np.take_along_axis(sim, to, 1).reshape(-1)):
                    yield best.frame()
        yield best.frame()

    key = ["g", "t", "cell", "chunk"]
    return dealt.repartition(*key).sortWithinPartitions(*key).mapInPandas(near, NEAR)


def shorten(entries: DataFrame, enlarge: bool) -> DataFrame:
    """The nearest NEIGHBOURS of each class, or MOST_NEIGHBOURS of those whose list is full of links; keeps ``fresh``."""
    one = entries.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    lists = one.withColumn("place", place).where(F.col("place") <= (MOST_NEIGHBOURS if enlarge else NEIGHBOURS))
    # Beyond the first NEIGHBOURS only links stay: a list grows as long as it is saturated.
    return lists.where((F.col("place") <= NEIGHBOURS) | (F.col("sim") >= LINK)).drop("place")


def refine(lists: DataFrame, classes: DataFrame, dtype: str) -> DataFrame:
    """New neighbours among the neighbours of each class, forwards and backwards, at least one of a pair being fresh."""
    back = lists.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim", "fresh")
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("fresh"), F.desc("sim"), "v"))
    short = [x.withColumn("place", place).where(F.col("place") <= NEIGHBOURS).drop("place") for x in (lists, back)]
    around = short[0].union(short[1]).groupBy("u", "v").agg(F.max("fresh").alias("fresh"))
    # What a class still wants: anything while its list is short, links while it is full of links, else what is nearer than its last.
    low = lists.groupBy("u").agg(F.when(F.count("*") < NEIGHBOURS, -2.0).otherwise(F.least(F.min("sim"), F.lit(LINK))).alias("low"))
    side = around.join(classes.select(F.col("c").alias("v"), "vec"), "v").join(low.withColumnRenamed("u", "v"), "v", "left")

    def run(it: Iterator) -> Iterator:
        best = _Best(MOST_NEIGHBOURS)
        for part in _groups(it, ["u"]):
            c, fresh, low, x = part.v.to_numpy(), part.fresh.to_numpy(), part.low.fillna(-2.0).to_numpy(), _matrix(part.vec.to_list(), dtype)
            sim = cosines(x, x)
            use = (fresh[:, None] | fresh[None, :]) & (sim >= low[:, None])
            np.fill_diagonal(use, False)
            a, b = np.nonzero(use)
            if len(a) and best.add(c[a], c[b], sim[a, b]):
                yield best.frame()
        yield best.frame()

    return side.repartition("u").sortWithinPartitions("u").mapInPandas(run, NEAR)


def audit(linked: DataFrame, classes: DataFrame, dtype: str) -> tuple[int, int]:
    """(links found, links there) of about AUDIT classes compared with all vectors of their group; raises if one class has a wrong count.

    ``linked`` is (c, n_links). Links are neither capped nor summed over
    classes before they are compared. Pairs at LINK to 1e-9 may count or not:
    sums of products in another order differ there.
    """
    n = classes.count()
    part = min(1 << 20, int(AUDIT / max(n, 1) * (1 << 20)) + 1)
    chosen = classes.where(F.pmod(F.xxhash64("c", F.lit(11)), F.lit(1 << 20)) < part).select("c", "g", "vec").limit(4 * AUDIT)
    asked = [(r.c, r.g, bytes(r.vec)) for r in chosen.collect()]
    if not asked:
        return 0, 0
    sent = classes.sparkSession.sparkContext.broadcast(asked)

    def run(it: Iterator) -> Iterator:
        import pandas as pd

        by: dict[str, list] = {}
        for q in sent.value:
            by.setdefault(q[1], []).append(q)
        sums: dict[int, np.ndarray] = {}
        for pdf in it:
            for g, rows in pdf.groupby("g", sort=False):
                if g in by:
                    sim = cosines(_matrix([x[2] for x in by[g]], dtype), _matrix(rows.vec.to_list(), dtype))
                    m = rows.m.to_numpy()
                    counts = np.stack([(sim >= LINK + e) @ m for e in (1e-9, 0, -1e-9)], axis=1)
                    for q, k in zip(by[g], counts):
                        sums[q[0]] = sums.get(q[0], 0) + k
        rows = [(u, *map(int, k)) for u, k in sums.items()]
        yield pd.DataFrame(rows, columns=["c", "least", "there", "most"]).astype("int64")

    there = classes.select("c", "g", "m", "vec").mapInPandas(run, "c long, least long, there long, most long").groupBy("c")
    there = there.agg(*(F.sum(k).alias(k) for k in ("least", "there", "most")))
    found = F.coalesce("n_links", F.lit(-1)) + 1  # a class meets itself, too
    wrong = ~found.between(F.col("least"), F.col("most"))
    got = there.join(linked, "c", "left").agg(F.sum(F.least(found, "there") - 1), F.sum(F.col("there") - 1), F.count_if(wrong)).first()
    if got[2]:
        raise RuntimeError(f"{got[2]} of {len(asked)} audited classes have a wrong number of links")
    return int(got[0]), int(got[1])


def graph(classes: DataFrame, dtype: str) -> DataFrame:
    """(u, v, sim) neighbour lists; what they miss, ``compare`` finds."""
    lists = stored(shorten(start(classes, dtype, seed=1).withColumn("fresh", F.lit(True)), True), "lists")
    for _ in range(ROUNDS):
        found = refine(lists, classes, dtype).withColumn("fresh", F.lit(True))
        lists = stored(shorten(lists.withColumn("fresh", F.lit(False)).union(found), True), "lists")
        if not lists.where("fresh").limit(1).count():
            break
    return lists.select("u", "v", "sim")


def unit(vecs, dtype: str) -> np.ndarray:
    """Rows of length 1 in double precision."""
    x = _matrix(vecs, dtype).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linked(x: np.ndarray, y: np.ndarray, x4: np.ndarray, y4: np.ndarray) -> np.ndarray:
    """Which rows of x and y (length 1, x4 and y4 the same in single precision) link: what single precision leaves open is decided in double."""
    sim = x4 @ y4.T
    room = np.float32((x.shape[1] + 8) * 2.0**-22)
    hit = sim >= LINK + room
    a, b = np.nonzero(~hit & (sim >= LINK - room))
    for k in range(0, len(a), 1 << 16):
        i, j = a[k: k + (1 << 16)], b[k: k + (1 << 16)]
        hit[i, j] = np.einsum("ij,ij->i", x[i], y[j]) >= LINK
    return hit


def ball(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre (length 1) of rows of length 1 and the largest angle to it, with some room for rounding."""
    centre = x.sum(axis=0)
    norm = np.linalg.norm(centre)
    if norm < 1e-6:
        return x[0], np.pi
    centre = centre / norm
    return centre, float(np.arccos(np.clip((x @ centre).min(), -1, 1))) + 1e-6


class Tiles:
    """Tiles of classes of one group, in the order of their components."""

    def __init__(self, component: np.ndarray, x: np.ndarray, m: np.ndarray):
        self.component, self.x, self.m, self.x4 = component, x, m, x.astype(np.float32)
        edge = np.flatnonzero(np.concatenate([[True], component[1:] != component[:-1], [True]]))
        cuts = {0, len(x)}
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if b - a >= TILE // 4:
                cuts |= {a, b}
        cuts = sorted(cuts)
        self.bound = [(k, min(k + TILE, b)) for a, b in zip(cuts[:-1], cuts[1:]) for k in range(a, b, TILE)]
        balls = [ball(x[a:b]) for a, b in self.bound]
        self.centre, self.radius = np.array([b[0] for b in balls]), np.array([b[1] for b in balls])

    def meet(self, other: Tiles) -> tuple[np.ndarray, set[tuple[int, int]]]:
        """Links of each class with the classes of ``other``, and the different components that link."""
        links, joined = np.zeros(len(self.x), np.int64), set()
        angle = np.arccos(np.clip(self.centre @ other.centre.T, -1, 1))
        near = angle <= self.radius[:, None] + other.radius[None, :] + np.arccos(LINK) + 1e-6
        for i, j in zip(*(k.tolist() for k in np.nonzero(near))):
            (a, b), (p, q) = self.bound[i], other.bound[j]
            hit = linked(self.x[a:b], other.x[p:q], self.x4[a:b], other.x4[p:q])
            if hit.any():
                links[a:b] += hit @ other.m[p:q]
                own, its = self.component[a:b], other.component[p:q]
                if own[0] != own[-1] or its[0] != its[-1] or own[0] != its[0]:
                    u, v = np.nonzero(hit & (own[:, None] != its[None, :]))
                    joined |= set(zip(own[u].tolist(), its[v].tolist()))
        return links, joined


def compare(members: DataFrame, dtype: str) -> tuple[DataFrame, DataFrame]:
    """(c, n_links) of every class, and pairs (a, b) of components that link, of all pairs inside each group (g, component, c, m, vec).

    The classes lie on disk by group and component. Some at a time are sent to
    all tasks and meet the tiles there, so no vector is shuffled once per tile.
    """
    spark = members.sparkSession
    size = members.agg(F.sum(F.length("vec"))).first()[0] or 0
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    key = ["g", "component", "c"]
    dealt = members.select(*key, "m", "vec").repartitionByRange(parts, *key).sortWithinPartitions(*key).withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, "tiles")
    sizes = dealt.groupBy("part").agg(F.sum(F.length("vec")).alias("size"), F.min("g").alias("low"), F.max("g").alias("high")).orderBy("part").collect()
    passes: list[list] = []
    for r in sizes:
        if passes and passes[-1][2] + r["size"] <= SENT_BYTES:
            passes[-1][1:3] = [r.part, passes[-1][2] + r["size"]]
            passes[-1][4] = r.high
        else:
            passes.append([r.part, r.part, r["size"], r.low, r.high])
    path = new_dir(spark, "met")
    schema = "c long, links long, a long, b long"
    spark.createDataFrame([], schema).write.parquet(path)
    for first, last, _, low, high in passes:
        some = dealt.where(F.col("part").between(first, last)).orderBy(*key).select("g", "component", "m", "vec").toArrow()
        sent = spark.sparkContext.broadcast([some.column(k).to_pylist() for k in ("g", "component", "m", "vec")])

        def run(it: Iterator, sent=sent) -> Iterator:
            groups = _tiles(*sent.value, dtype)
            for pdf in it:
                pdf = pdf.sort_values(["g", "component"], kind="stable")
                for g, rows in pdf.groupby("g", sort=False):
                    if g in groups:
                        own = Tiles(rows.component.to_numpy(), unit(rows.vec.to_list(), dtype), rows.m.to_numpy())
                        links, joined = own.meet(groups[g])
                        yield _met(rows.c.to_numpy(), links, joined)

        dealt.where(F.col("g").between(low, high)).drop("part").mapInPandas(run, schema).write.mode("append").parquet(path)
        sent.destroy()
    met = spark.read.schema(schema).parquet(path)
    counted = met.where("c is not null").groupBy("c").agg((F.sum("links") - 1).alias("n_links"))  # each class meets itself once
    return counted, met.where("a is not null").select("a", "b")


def _tiles(g: list, component: list, m: list, vec: list, dtype: str) -> dict[str, Tiles]:
    """Tiles of each group of rows in the order of group and component."""
    edge = [k for k in range(len(g)) if k == 0 or g[k] != g[k - 1]] + [len(g)]
    return {g[a]: Tiles(np.array(component[a:b], np.int64), unit(vec[a:b], dtype), np.array(m[a:b], np.int64)) for a, b in zip(edge[:-1], edge[1:])}


def _met(c: np.ndarray, links: np.ndarray, joined: set[tuple[int, int]]):
    import pandas as pd

    pairs = np.array(sorted(joined), np.int64).reshape(-1, 2)
    has, n = np.flatnonzero(links), len(pairs)
    return pd.DataFrame({
        "c": pd.array([*c[has].tolist(), *[None] * n], "Int64"), "links": pd.array([*links[has].tolist(), *[None] * n], "Int64"),
        "a": pd.array([*[None] * len(has), *pairs[:, 0].tolist()], "Int64"), "b": pd.array([*[None] * len(has), *pairs[:, 1].tolist()], "Int64"),
    })


def near_duplicates(table: DataFrame) -> tuple[DataFrame, float]:
    """(vec_id, n_links, component_id, kept) of every row of ``table`` (vec_id, embedding, label), and the audited recall.

    Vectors that are null, empty, zero or hold a null or non-finite component,
    and those without a label, link with nothing; vectors of different sizes
    never link. Equal vectors link and repeated rows count each. A null vec_id
    takes part but names no component. Other columns are ignored; an empty
    table gives an empty result.
    """
    kind = table.schema["embedding"].dataType.elementType.simpleString()
    dtype = "<f4" if kind == "float" else "<f8"
    rows = stored(vectors(table if kind == "float" else table.withColumn("embedding", F.col("embedding").cast("array<double>")), dtype), "vectors")
    classes = stored(rows.groupBy("c", "g").agg(F.first("vec").alias("vec"), F.count("*").alias("m")), "classes")
    lists = graph(classes, dtype)
    first = stored(components(lists.where(F.col("sim") >= LINK), "u", "v"), "joined").select(F.col("id").alias("c"), "component")
    members = stored(classes.join(first, "c", "left").withColumn("component", F.coalesce("component", "c")), "members")
    counted, pairs = compare(members, dtype)
    counted = stored(counted, "counted")
    hit, there = audit(counted, classes, dtype)
    last = stored(components(pairs), "joined").select(F.col("id").alias("component"), F.col("component").alias("whole"))
    named = members.select("c", "component").join(last, "component", "left").select("c", F.coalesce("whole", "component").alias("component"))
    valid = stored(rows.select("vec_id", "c").join(named.join(counted, "c"), "c"), "linked")
    least = valid.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    valid = valid.join(least, "component").select("vec_id", "n_links", "component_id")
    rest = table.select("vec_id", "label", "embedding").where(~_usable(table))
    rest = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return valid.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), hit / there if there else 1.0


def _usable(table: DataFrame):
    """The rows that ``vectors`` returns, as a column."""
    e = F.col("embedding").cast("array<double>")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x)
    fine = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)) & (norm > 0) & (norm < float("inf"))
    return F.coalesce(fine, F.lit(False))
