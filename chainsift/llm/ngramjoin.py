"""N-gram Jaccard join by T-occurrence search.

Two texts link when their sets of five-word shingles overlap by 80 % of their
union. Texts with equal sets are one class. A class stays in the search only
if enough of its first shingles, rare ones first, occur elsewhere; classes
that share such shingles form candidate clusters. Inside a cluster every class
is searched in the inverted lists of the others with DivideSkip: short lists
are merged through a heap, and only texts that reach the required overlap
without the long lists are looked up in those by binary search.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainsift.llm.common import batches, components, flat_bytes, mix, release, shingle_hashes, stored, without_ids, words

SHINGLE = 5
#: Link when SIMILAR[1] * intersection >= SIMILAR[0] * union.
SIMILAR = (4, 5)
#: Shingles that a first look finds so often in LOOK_SHINGLES shingles of a task may be frequent; at most MAX_FREQUENT of the highest counts go last in the order of rarity. This orders the search, it drops nothing.
OFTEN, LOOK_SHINGLES, MAX_FREQUENT = 3, 2 << 20, 1 << 19
#: Part of a set by which its first shingles are extended, so that one shared shingle is not yet enough.
EXTRA = 20
#: Classes, and bytes of their sets, of one candidate cluster that are searched in one task (which takes about twice those bytes);
#: larger clusters are cut and joined over blocks of so many classes or bytes.
CLUSTER, CLUSTER_BYTES = 4000, 96 << 20
QUERY_BLOCK, QUERY_BYTES = 1024, 32 << 20
#: A cluster that is too large is split by its pairs' common first shingles. Lists up to these lengths give all their pairs,
#: one length after the other as long as clusters are too large; classes in longer ones are held together by their neighbours.
PAIR_LISTS = (16, 64, 256)
#: Lists about this long are merged and probed half and half.
MERGE = 4
#: Candidates up to this number are broadcast (16 bytes each) to pick their texts; more are joined by shuffle.
BROADCAST_ROWS = 1 << 20


def required(n: int) -> int:
    """Least overlap of a set of size n with any set that it links to."""
    return -(-SIMILAR[0] * n // SIMILAR[1])


def linked(n: int, m: int, overlap: int) -> bool:
    return SIMILAR[1] * overlap >= SIMILAR[0] * (n + m - overlap)


def text_sets(raw: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    word, _, _, first = words(raw, off)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        yield np.unique(shingle_hashes(word[a:b], min(SHINGLE, b - a))) if b > a else np.zeros(0, np.uint64)


def signature(s: np.ndarray) -> tuple[int, int]:
    """Two order-free 64-bit sums over a set; equal sets have equal ones."""
    a, b = mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def first_shingles(sets: list[np.ndarray], frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number of the set): the part of each set that any linked set must meet.

    Seldom shingles come first, each kind in hash order; ``frequent`` is sorted.
    """
    size = np.array([len(s) for s in sets], np.int64)
    code = np.concatenate([np.zeros(0, np.uint64), *sets])
    owner = np.repeat(np.arange(len(sets)), size)
    late = np.zeros(len(code), bool)
    if len(frequent):
        late = frequent[np.minimum(np.searchsorted(frequent, code), len(frequent) - 1)] == code
    order = np.lexsort((mix(code), late, owner))
    need = -(-SIMILAR[0] * size // SIMILAR[1])
    place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    keep = order[place < np.repeat(size - need + 1 + size // EXTRA, size)]
    return code[keep], owner[keep]


def enough(n):
    """Shared first shingles that a set of size n needs at least to link (partners have at least 0.8 n shingles)."""
    return F.lit(1) + F.floor(F.lit(SIMILAR[0]) * n / (SIMILAR[1] * EXTRA))


def _long(values) -> object:
    import pyarrow as pa

    return pa.array(np.asarray(values, np.int64), pa.int64())


def look(docs: DataFrame) -> DataFrame:
    """(kind, a, n, b, c): kind 0 a row per text (doc_id, set size, signature), kind 1 shingles that may be frequent (hash, count)."""

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        held, size = [], 0

        def often():
            nonlocal held, size
            u, n = np.unique(np.concatenate(held), return_counts=True)
            u, n, held, size = u[n >= OFTEN], n[n >= OFTEN], [], 0
            zero = np.zeros(len(u), np.int64)
            return pa.RecordBatch.from_arrays([pa.array([1] * len(u), pa.int32()), _long(u.view(np.int64)), _long(n), _long(zero), _long(zero)], names=["kind", "a", "n", "b", "c"])

        for whole in it:
            for b in batches(whole):
                sets = list(text_sets(*flat_bytes(b.column("text"))))
                sign = [signature(s) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array([0] * len(sets), pa.int32()), b.column("doc_id").cast(pa.int64()), _long([len(s) for s in sets]), _long([x for x, _ in sign]), _long([y for _, y in sign])], names=["kind", "a", "n", "b", "c"])
                for s in sets:
                    held.append(s)
                    size += len(s)
                    if size >= LOOK_SHINGLES:
                        yield often()
        if held:
            yield often()

    return docs.select("doc_id", "text").mapInArrow(run, "kind int, a long, n long, b long, c long")


def most_frequent(counts: DataFrame) -> np.ndarray:
    """Sorted hashes (a) of the highest counts (n): all from the lowest power of two on with which at most MAX_FREQUENT are left."""
    counts = stored(counts, "counts")
    sizes = {r.k: r.m for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("m")).collect()}  # a row per power of two
    low, total = 64, 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > MAX_FREQUENT:
            break
        low = k
    rows = counts.where(F.col("n") >= F.lit(2.0) ** low).select("a").toPandas()
    return np.sort(rows.a.to_numpy(np.int64).view(np.uint64))


POSTING = np.dtype([("h", "<u8"), ("c", "<i8"), ("n", "<i4")])


def shared_postings(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(h, c, n): first shingles that occur in two classes or more; c is the class's signature, n its set size.

    Postings travel packed by hash range, so that a task sorts each list once.
    """
    spark = docs.sparkSession
    parts = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    sent = spark.sparkContext.broadcast(frequent)

    def emit(it: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in it:
            for b in batches(whole, 8 << 20):
                rows, seen = [], set()
                for part in batches(b):
                    sets, names = [], []
                    for s in text_sets(*flat_bytes(part.column("text"))):
                        c = signature(s)[0]
                        if len(s) and c not in seen:
                            seen.add(c)
                            sets.append(s)
                            names.append(c)
                    h, owner = first_shingles(sets, sent.value)
                    r = np.empty(len(h), POSTING)
                    r["h"], r["c"], r["n"] = h, np.array(names, np.int64)[owner], np.array([len(s) for s in sets])[owner]
                    rows.append(r)
                if rows:
                    r = np.concatenate(rows)
                    to = (mix(r["h"]) % np.uint64(parts)).astype(np.int64)
                    r = r[np.argsort(to, kind="stable")]
                    cut = np.concatenate([[0], np.cumsum(np.bincount(to, minlength=parts))])
                    full = [k for k in range(parts) if cut[k + 1] > cut[k]]
                    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([r[cut[k]: cut[k + 1]].tobytes() for k in full], pa.binary())], names=["part", "rows"])

    def meet(it: Iterator) -> Iterator:
        import pyarrow as pa

        held, part = [], None

        def shared():
            r = np.concatenate(held)
            r = r[np.lexsort((r["c"], r["h"]))]
            same = r["h"][1:] == r["h"][:-1]
            fresh = np.ones(len(r), bool)
            fresh[1:] = ~same | (r["c"][1:] != r["c"][:-1])
            r = r[fresh]
            same = r["h"][1:] == r["h"][:-1]
            many = np.zeros(len(r), bool)
            many[1:] |= same
            many[:-1] |= same
            r = r[many]
            return pa.RecordBatch.from_arrays([_long(r["h"].view(np.int64)), _long(r["c"]), pa.array(r["n"])], names=["h", "c", "n"])

        for b in it:
            for p, rows in zip(b.column("part").to_pylist(), b.column("rows")):
                if p != part and held:
                    yield shared()
                    held = []
                part = p
                held.append(np.frombuffer(rows.as_buffer(), POSTING))
        if held:
            yield shared()
        release()

    packed = docs.select("text").mapInArrow(emit, "part int, rows binary")
    return packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(meet, "h long, c long, n int")


class Lists:
    """Inverted lists over the sets of one cluster, those of at least ``least`` members, flat: one array of members, cut by shingle.

    Built over one range of hashes after the other, so that building takes little more memory than the lists.
    """

    RANGES = 16

    def __init__(self, sets: list[np.ndarray], least: int = 1):
        self.sets = sets
        keys, sizes, members = [], [], []
        edges = [np.searchsorted(s, np.array([k << 60 for k in range(1, self.RANGES)], np.uint64)) for s in sets]
        for k in range(self.RANGES):
            parts = [s[(e[k - 1] if k else 0): (e[k] if k < self.RANGES - 1 else len(s))] for s, e in zip(sets, edges)]
            code = np.concatenate([np.zeros(0, np.uint64), *parts])
            owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(p) for p in parts])
            order = np.argsort(code, kind="stable")
            code, owner = code[order], owner[order]
            start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
            size = np.diff(np.append(start, len(code)))
            keep = size >= least
            keys.append(code[start[keep]])
            sizes.append(size[keep])
            members.append(owner[np.repeat(keep, size)])
        self.key = np.concatenate(keys)
        self.first = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate(sizes))])
        self.member = memoryview(np.concatenate(members))

    def search(self, s: np.ndarray, skip) -> Iterator[int]:
        """Members whose set links with s, in DivideSkip order; ``skip(member)`` leaves out those already joined."""
        n = len(s)
        need = required(n)
        at = np.searchsorted(self.key, s)
        inside = at < len(self.key)
        at, s = at[inside], s[inside]
        at = at[self.key[at] == s]
        if len(at) < need:
            return
        size = self.first[at + 1] - self.first[at]
        at = at[np.argsort(size, kind="stable")]
        lists = list(zip(self.first[at].tolist(), self.first[at + 1].tolist()))
        member_at = self.member
        # The longer the lists, the more of them are probed instead of merged; a member must still be met in a short one.
        most = lists[-1][1] - lists[-1][0]
        long = min(need - 1, need * most // (most + MERGE))
        cut = len(lists) - long
        short, rest = lists[:cut], lists[cut:]
        heads = [(member_at[a], a, z) for a, z in short]
        heapq.heapify(heads)
        while heads:
            member, count = heads[0][0], 0
            while heads and heads[0][0] == member:
                _, a, z = heads[0]
                count += 1
                if a + 1 < z:
                    heapq.heapreplace(heads, (member_at[a + 1], a + 1, z))
                else:
                    heapq.heappop(heads)
            m = len(self.sets[member])
            if count >= need - long and SIMILAR[1] * min(n, m) >= SIMILAR[0] * max(n, m) and not skip(member):
                least = -(-SIMILAR[0] * (n + m) // (SIMILAR[0] + SIMILAR[1]))
                for left, (a, z) in zip(range(len(rest), 0, -1), rest):
                    if count >= least or count + left < least:
                        break
                    k = bisect_left(member_at, member, a, z)
                    count += k < z and member_at[k] == member
                if count >= least:
                    yield member


class Joined:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def solve(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links that connect exactly the members of ``sets`` that links connect (a spanning forest).

    Every link between two components has an end outside a component that
    holds more than half of all members, so its members are not searched.
    """
    lists, joined = Lists(sets, 2), Joined(len(sets))  # a list of one holds only the set that asks
    size = [1] * len(sets)
    for k in sorted(range(len(sets)), key=lambda k: len(sets[k])):
        if 2 * size[joined.top(k)] > len(sets):
            continue
        for m in lists.search(sets[k], lambda x, k=k: joined.top(x) == joined.top(k)):
            a, b = joined.top(k), joined.top(m)
            if joined.join(a, b):
                size[min(a, b)] = size[a] + size[b]
                yield k, m


def _solve_groups(rows: DataFrame, key: str) -> DataFrame:
    """Links inside each group of ``rows`` (key, c, shingles); a group has about CLUSTER classes or CLUSTER_BYTES of sets."""

    def run(it: Iterator) -> Iterator:
        import pandas as pd

        now, ids, sets, seen = None, [], [], set()

        def links():
            out = [(ids[a], ids[b]) for a, b in solve(sets)]
            return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

        for pdf in it:
            for k, c, s in zip(pdf[key], pdf.c, pdf.shingles):
                if k != now:
                    if len(ids) > 1:
                        yield links()
                    now, ids, sets, seen = k, [], [], set()
                if c not in seen:
                    seen.add(c)
                    ids.append(c)
                    sets.append(np.frombuffer(s, "<u8"))
        if len(ids) > 1:
            yield links()
        release()

    return rows.select(key, "c", "shingles").repartition(key).sortWithinPartitions(key).mapInPandas(run, "a long, b long")


def _join_blocks(big: DataFrame, links: DataFrame) -> DataFrame:
    """All links between the pieces of clusters that were too large for one task.

    In every round at most QUERY_BLOCK classes of QUERY_BYTES together (one
    at least) outside the largest component of their cluster are the queries:
    their lists go to all tasks, and each task
    searches its own classes of these clusters in them. A link between two
    components has an end outside the largest one, which becomes a query
    unless it has been joined before, so no connection is lost.
    """
    spark = big.sparkSession
    asked = spark.createDataFrame([], "c long")
    while True:
        part = components(links)
        state = big.select("cluster", "c", F.length("shingles").alias("size")).join(part.withColumnRenamed("id", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
        state = stored(state, "state")
        sizes = state.groupBy("cluster", "component").count()
        top = sizes.groupBy("cluster").agg(F.max_by("component", F.struct("count", "component")).alias("top"))
        rest = state.join(top, "cluster").where("component <> top").join(asked, "c", "left_anti")
        first = rest.withColumn("k", F.row_number().over(Window.partitionBy("component").orderBy("size", "c"))).orderBy("k", "c").limit(QUERY_BLOCK)
        chosen, total = {}, 0
        for r in first.select("c", "component", "size").collect():
            total += r["size"]
            if chosen and total > QUERY_BYTES:
                break
            chosen[r.c] = r.component
        if not chosen:
            return links
        block = big.where(F.col("c").isin(list(chosen))).select("c", "cluster", "shingles").collect()
        sent = spark.sparkContext.broadcast([(r.c, r.cluster, chosen[r.c], bytes(r.shingles)) for r in block])

        def run(it: Iterator, sent=sent) -> Iterator:
            import pandas as pd

            by: dict[int, list] = {}
            for q in sent.value:
                by.setdefault(q[1], []).append(q)
            lists = {k: Lists([np.frombuffer(q[3], "<u8") for q in qs]) for k, qs in by.items()}
            seen = set()
            for pdf in it:
                out = []
                for cluster, c, component, s in zip(pdf.cluster, pdf.c, pdf.component, pdf.shingles):
                    qs = by.get(cluster)
                    if qs:
                        for m in lists[cluster].search(np.frombuffer(s, "<u8"), lambda x: qs[x][2] == component or (qs[x][0], component) in seen):
                            seen.add((qs[m][0], component))
                            out.append((c, qs[m][0]))
                yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

        found = big.join(state.select("c", "component"), "c").select("cluster", "c", "component", "shingles").mapInPandas(run, "a long, b long")
        links = stored(links.union(found), "links")
        asked = stored(asked.union(spark.createDataFrame([(c,) for c in chosen], "c long")), "asked")


def _chained(postings: DataFrame, *keys: str) -> DataFrame:
    """(c, c0): classes next to each other by size in a list (``keys``), if their sizes can link at all."""
    near = Window.partitionBy(*keys).orderBy("n", "c")
    return (
        postings.select("n", "c", F.lag("c").over(near).alias("c0"), F.lag("n").over(near).alias("n0"))
        .where(F.lit(SIMILAR[1]) * F.col("n0") >= F.lit(SIMILAR[0]) * F.col("n"))
        .select("c", "c0").distinct()
    )


def _parts():
    """Tasks' worth of a cluster's classes and sets (aggregate over n)."""
    return F.greatest(F.count("*") / CLUSTER, F.sum("n") * 8 / CLUSTER_BYTES)


def _split(postings: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """``classes`` (doc_id, c, cluster, n) in the smaller clusters that their possible links hold together; classes without one go.

    Sets of n shingles or more link only if they have 1 + n / EXTRA first
    shingles in common. These are counted for every pair that meets in a list
    of at most ``most`` classes of its cluster; of the longer lists a pair may
    share as many as its class with fewer of them has. Pairs that meet in
    longer lists only have enough of them each, and are held together there by
    the classes between them.
    """
    own = postings.join(classes.select("c", "cluster"), "c")
    sizes = own.groupBy("cluster", "h").agg(F.count("*").alias("size")).where("size > 1")
    lists = stored(own.join(sizes, ["cluster", "h"]), "lists")
    late = lists.where(F.col("size") > most).groupBy("c").agg(F.count("*").alias("late"))
    lists = stored(lists.join(late, "c", "left").fillna(0, ["late"]), "lists")
    x, y = (lists.where(F.col("size") <= most).select("cluster", "h", *[F.col(k).alias(k + end) for k in ("c", "n", "late")]) for end in "xy")
    after = (F.col("ny") > F.col("nx")) | ((F.col("ny") == F.col("nx")) & (F.col("cy") > F.col("cx")))
    met = x.join(y, ["cluster", "h"]).where(after & (F.lit(SIMILAR[1]) * F.col("nx") >= F.lit(SIMILAR[0]) * F.col("ny")))
    common = met.groupBy("cx", "cy", "nx", "latex", "latey").agg(F.count("*").alias("k"))
    pairs = common.where(F.col("k") + F.least("latex", "latey") >= 1 + F.floor(F.col("nx") / EXTRA)).select(F.col("cx").alias("c"), F.col("cy").alias("c0"))
    chains = _chained(lists.where((F.col("size") > most) & (F.col("late") >= enough(F.col("n")))), "cluster", "h")
    smaller = components(pairs.union(chains), "c", "c0").select(F.col("id").alias("c"), F.col("component").alias("cluster"))
    return classes.drop("cluster").join(smaller, "c").select(*classes.columns)


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable by links, itself included.
    Texts without words (null, empty, blank) have an empty set and link with
    nothing. Equal sets link, repeated rows as well. A row without doc_id
    belongs to the class of its set; a set that no row with a doc_id has is
    not searched, and its component is null.
    An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    seen = stored(look(docs), "sets")
    sets = seen.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("b").alias("c"), F.col("c").alias("c2"))
    frequent = most_frequent(seen.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")))
    postings = stored(shared_postings(docs, frequent), "postings")
    strong = postings.groupBy("c").agg(F.count("*").alias("k"), F.first("n").alias("n")).where(F.col("k") >= enough(F.col("n"))).select("c")
    strong = stored(strong, "strong")
    # Classes next to each other by size in a list, if their sizes can link at all, hold a cluster together.
    pairs = _chained(postings.join(strong, "c", "left_semi"), "h")
    clusters = stored(components(pairs, "c", "c0").select(F.col("id").alias("c"), F.col("component").alias("cluster")), "clusters")
    # One text of every candidate class; what is known of the class rides along, so that the sets move once.
    classes = sets.join(clusters, "c").groupBy("c").agg(F.min("doc_id").alias("doc_id"), F.first("cluster").alias("cluster"), F.first("n_shingles").alias("n")).where("doc_id is not null")
    classes = stored(classes, "candidate_classes")
    for most in PAIR_LISTS:
        large = stored(classes.groupBy("cluster").agg(_parts().alias("parts")).where("parts > 1").select("cluster"), "large")
        if not large.limit(1).count():
            break
        kept = classes.join(F.broadcast(large), "cluster", "left_anti").select(*classes.columns)
        smaller = _split(postings, stored(classes.join(F.broadcast(large), "cluster", "left_semi").select(*classes.columns), "large_classes"), most)
        classes = stored(kept.union(smaller), "candidate_classes")
    part = _parts()
    sizes = classes.groupBy("cluster").agg(F.when(part <= 1, 1).otherwise(F.ceil(2 * part)).cast("long").alias("pieces"))
    classes = stored(classes.drop("n").join(sizes, "cluster"), "classes")
    rows = stored(_fetch(docs, F.broadcast(classes) if classes.count() <= BROADCAST_ROWS else classes), "candidates")
    links = _solve_groups(rows.where("pieces = 1"), "cluster")
    big = rows.where("pieces > 1")
    if big.limit(1).count():
        big = stored(big.dropDuplicates(["c"]).withColumn("piece", F.pmod(F.xxhash64("c"), "pieces")), "big")
        own = _solve_groups(big.withColumn("key", F.concat_ws("-", "cluster", "piece")), "key")
        links = links.union(_join_blocks(big, stored(own, "links")))
    merged = components(links).select(F.col("id").alias("c"), "component")
    with_class = sets.join(merged, "c", "left").withColumn("root", F.coalesce("component", "c")).withColumn("own", F.when(F.col("n_shingles") > 0, F.col("c2")).otherwise(F.col("doc_id")))
    # Unlinked classes are told apart by both signatures; empty sets by their doc_id.
    alone = F.when(F.col("component").isNull(), F.col("own"))
    with_class = with_class.withColumns({"own": F.coalesce(alone, F.lit(0)), "empty": F.col("n_shingles") == 0})
    names = with_class.groupBy("root", "own", "empty").agg(F.min("doc_id").alias("component_id"))
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in ("root", "own", "empty")]
    return with_class.alias("x").join(names.alias("y"), same).select("x.doc_id", "x.n_shingles", "y.component_id")


def _fetch(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(c, cluster, pieces, shingles) of the texts of ``classes`` (doc_id, c, cluster, pieces); rows that repeat a doc_id repeat its class."""

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in it:
            for b in batches(whole):
                sets = list(text_sets(*flat_bytes(b.column("text"))))
                mine = [k for k, (s, c) in enumerate(zip(sets, b.column("c").to_pylist())) if len(s) and signature(s)[0] == c]
                kept = b.take(pa.array(mine, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in ("c", "cluster", "pieces")), pa.array([sets[k].tobytes() for k in mine], pa.binary())], names=["c", "cluster", "pieces", "shingles"])

    wanted = docs.select("doc_id", "text").join(classes, "doc_id").select("text", "c", "cluster", "pieces")
    return wanted.mapInArrow(run, "c long, cluster long, pieces long, shingles binary")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id.

    Of rows that repeat that doc_id one stays. Rows without doc_id stay (they
    cannot be named), and so do texts without words.
    """
    groups = stored(join(docs), "groups")
    many = groups.where("doc_id = component_id").groupBy("doc_id", "n_shingles").count().where("count > 1 and n_shingles > 0").select("doc_id")
    kept = without_ids(docs, groups.where("doc_id <> component_id"))
    again = kept.join(F.broadcast(many) if many.count() <= BROADCAST_ROWS else many, "doc_id", "left_semi").select(*docs.columns)
    return without_ids(kept, many).union(again.dropDuplicates(["doc_id"]))
