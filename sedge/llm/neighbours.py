"""Most similar vectors for every vector (problem 1).

Index: one low-dimensional stable (Gaussian) projection, indexed by a kd-tree, one coordinate a level, whose split
values are medians of a sample.  Its leaves say which vectors are compared; its upper levels, the regions, are the
partitions of the search, so that a vector is moved once a region, however many leaves it visits there.  The difference of two
vectors at distance d is, in each projected coordinate, d times a standard normal variable, so its
squares over d^2 are chi-square distributed.

1. Every vector goes to its own leaf, its nearest region, where all are verified against each other
   by true distance.  That gives each vector the distance of its k-th neighbour so far.
2. Each vector then visits further leaves, in rising projected distance, scaled by the distance D up to
   which it still has to look (of its k-th neighbour so far, or of the wanted least similarity if
   that is nearer).  From its distances to the faces of the tree and D, the law of the projected squares gives for
   each leaf the chance that a neighbour at D is in it; a vector stops when the chance that such a neighbour
   is in none of its leaves has come down to ``miss``.  It has no other end: a vector visits as many leaves
   as its own test asks for, up to all of them.
3. In every leaf residents are verified against each other and against the visitors, never visitors against visitors:
   their number grows with the table, and its square with it.  A pair is only lost if neither side visits the
   other's own leaf, that is if the tests of both its sides fail.

New neighbours only bring D down, so a test that held still holds after the second verification.

Copies of a vector are taken out first: one representative of each group is indexed, and the copies get
theirs from it.  Near copies, however many, differ in their projections, and medians split them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.operators.skew import salted_join
from sedge.session import cut, drop, spread

#: Vectors a leaf, if there are many; fewer where else there were less than LEAVES a core, but not less than LEAST.
LEAF, LEAVES, LEAST = 1024, 4, 64
#: Vectors a region, if there are many; fewer where else there were less than REGIONS a core.
REGION, REGIONS = 300_000, 2
#: The medians are of about so many vectors, of least hash, and of so many a leaf.
SAMPLE, SAMPLE_LEAF = 20_000, 16
#: Up to so many vectors that are copies of another one are named in a broadcast; beyond it they are taken out by a join.
MOST_COPIES = 2_000_000
_SCALE = 32767.0
#: Rows of one block of similarities, and of visitors looked for at once.
BLOCK, SLICE = 512, 4096


def clean_vectors(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, vec) without null ids and without null, empty, all-zero and non-finite vectors."""
    v = F.col("vec")
    given = df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<float>").alias("vec")).where("id is not null and vec is not null")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return given.where(finite & F.exists(v, lambda x: x != 0))


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        codes = []
        for v in pdf["vec"]:
            x = np.asarray(v, dtype=np.float64)
            codes.append(np.rint(x / np.sqrt((x * x).sum()) * _SCALE).astype(np.int16).tobytes())
        yield pd.DataFrame({"id": pdf["id"], "code": codes})


def _unit(codes: pd.Series) -> np.ndarray:
    x = np.frombuffer(b"".join(codes), dtype=np.int16).reshape(len(codes), -1).astype(np.float32)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def normal_cdf(z: np.ndarray) -> np.ndarray:
    """The standard normal distribution function (a polynomial of five terms, error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * np.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = np.exp(-z * z / 2) / np.sqrt(2 * np.pi) * poly
    return np.where(z > 0, 1 - tail, tail)


class Tree:
    """A kd-tree over the coordinates of a stable projection: one coordinate a level, split at the median of the sample below each node."""

    def __init__(self, project: np.ndarray, sample: np.ndarray):
        self.project, self.depth = project, project.shape[1]
        self.splits: list[np.ndarray] = []
        node = np.zeros(len(sample), dtype=np.int64)
        for level in range(self.depth):
            medians = np.full(1 << level, np.median(sample[:, level]) if len(sample) else 0.0, dtype=np.float32)
            order = np.argsort(node, kind="stable")
            bounds = np.searchsorted(node[order], np.arange((1 << level) + 1))
            for k in range(1 << level):
                below = sample[order[bounds[k] : bounds[k + 1]], level]
                if len(below):
                    medians[k] = np.median(below)
            self.splits.append(medians)
            node = node * 2 + (sample[:, level] > medians[node])

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        y, node = x @ self.project, np.zeros(len(x), dtype=np.int64)
        for level in range(self.depth):
            node = node * 2 + (y[:, level] > self.splits[level][node])
        return node

    def visits(self, x: np.ndarray, d: np.ndarray, miss: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of the leaves each vector has to visit beside its own, until the chance to miss a neighbour at distance ``d`` is at most ``miss``."""
        y, rows, out = x @ self.project, np.arange(len(x)), []
        least = miss / 64
        while len(rows):
            row, node, chance = rows, np.zeros(len(rows), dtype=np.int64), np.ones(len(rows))
            for level in range(self.depth):
                above = normal_cdf((y[row, level] - self.splits[level][node]) / d[row])
                row, node = np.concatenate([row, row]), np.concatenate([node * 2, node * 2 + 1])
                chance = np.concatenate([chance * (1 - above), chance * above])
                kept = chance >= least
                row, node, chance = row[kept], node[kept], chance[kept]
            order = np.lexsort((-chance, row))
            row, node, chance = row[order], node[order], chance[order]
            total = np.bincount(row, chance, len(x))
            running = np.cumsum(chance)
            first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, dtype=bool)
            base = np.repeat(running[first] - chance[first], np.diff(np.append(np.flatnonzero(first), len(row))))
            short = rows[(total[rows] < 1 - miss) & (least > 1e-12)]  # too much was left out as unlikely: look again, closer
            wanted = (running - chance - base < 1 - miss) & ~np.isin(row, short)
            out.append((row[wanted], node[wanted]))
            rows, least = short, least / 16
        row, node = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, dtype=np.int64),) * 2
        other = node != self.leaf(x)[row]
        return row[other], node[other]


def _top(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` greatest of each ``a``, ties to the smaller ``b``."""
    order = np.lexsort((b, -s, a))
    a, b, s = a[order], b[order], s[order]
    start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
    return a[place < k], b[place < k], s[place < k]


def verified(x: np.ndarray, k: int, floor: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other row, cosine): the ``k`` most similar others of every row, of cosine ``floor`` or more; every two rows are compared once."""
    held = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32))]
    pending = 0
    for start in range(0, len(x), BLOCK):
        s = x[start : start + BLOCK] @ x[start:].T
        s[np.tri(len(s), s.shape[1], dtype=bool)] = -2  # itself, and what is compared in the other direction
        if floor is not None:
            r, c = np.nonzero(s >= floor)
        else:
            keep = min(k, s.shape[1])
            r1, c1 = np.repeat(np.arange(len(s)), keep), np.argpartition(-s, keep - 1, axis=1)[:, :keep].ravel()
            keep = min(k, len(s))
            r2, c2 = np.argpartition(-s, keep - 1, axis=0)[:keep].ravel(), np.tile(np.arange(s.shape[1]), keep)
            code = np.unique(np.concatenate([r1 * s.shape[1] + c1, r2 * s.shape[1] + c2]))
            r, c = code // s.shape[1], code % s.shape[1]
            r, c = r[s[r, c] > -2], c[s[r, c] > -2]
        v = s[r, c]
        held.append((np.concatenate([r, c]) + start, np.concatenate([c, r]) + start, np.concatenate([v, v])))
        pending += len(v)
        if pending > 1_000_000:
            held, pending = [_top(*(np.concatenate(z) for z in zip(*held)), k)], 0
    return _top(*(np.concatenate(z) for z in zip(*held)), k)


def between(v: np.ndarray, x: np.ndarray, k: int, floor: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``v``, row of ``x``, cosine): pairs of cosine ``floor`` or more, or those among the ``k`` most similar of either side."""
    held = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32))]
    for start in range(0, len(v) if len(x) else 0, BLOCK):
        s = v[start : start + BLOCK] @ x.T
        if floor is not None:
            r, c = np.nonzero(s >= floor)
        else:
            keep, wide = min(k, len(x)), min(k, len(s))
            r1, c1 = np.repeat(np.arange(len(s)), keep), np.argpartition(-s, keep - 1, axis=1)[:, :keep].ravel()
            r2, c2 = np.argpartition(-s, wide - 1, axis=0)[:wide].ravel(), np.tile(np.arange(len(x)), wide)
            r, c = np.divmod(np.unique(np.concatenate([r1 * len(x) + c1, r2 * len(x) + c2])), len(x))
        held.append((r + start, c, s[r, c]))
    return tuple(np.concatenate(z) for z in zip(*held))


def _homes(shared, redundant, local: int):
    """Rows (id, code, leaf, region): each representative in its own leaf; the sorted ``redundant`` ids are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gone = redundant.value
        for pdf in batches:
            at = np.minimum(np.searchsorted(gone, pdf["id"].to_numpy()), max(len(gone) - 1, 0))
            own = pdf if not len(gone) else pdf[gone[at] != pdf["id"].to_numpy()]
            if len(own):
                leaf = shared.value.leaf(_unit(own["code"]))
                yield own.assign(leaf=leaf, region=leaf >> local)

    return run


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """(region, rows) of batches that are sorted by region; one region may come in several pieces."""
    for pdf in batches:
        region = pdf["region"].to_numpy()
        ends = np.append(np.flatnonzero(region[1:] != region[:-1]) + 1, len(region))
        for start, end in zip(np.append(0, ends[:-1]), ends):
            if end > start:
                yield int(region[start]), pdf.iloc[start:end]


def _runs(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value with its places."""
    order = np.argsort(values, kind="stable")
    starts = np.flatnonzero(np.diff(values[order], prepend=-1))
    for start, end in zip(starts, np.append(starts[1:], len(order))):
        yield int(values[order[start]]), order[start:end]


def _visiting(shared, local: int, k: int, floor: float | None, miss: float):
    """Rows (id, code, region, away, at): the residents of each region, and each again for every further region its test asks for.

    ``at`` holds the leaves there by their number in the region; that of a resident begins with its own.
    """
    far = 9.0 if floor is None else float(np.sqrt(max(2 - 2 * floor, 1e-9)))

    def visits(region: int, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        x, own = _unit(pdf["code"]), pdf["leaf"].to_numpy(dtype=np.int64)
        worst, count = np.full(len(x), np.inf), np.zeros(len(x), dtype=np.int64)
        for _, rows in _runs(own):
            a, _, s = verified(x[rows], k, floor)
            np.minimum.at(worst, rows[a], s)
            count[rows] = np.bincount(a, minlength=len(rows))
        d = np.minimum(np.where(count >= k, np.sqrt(np.maximum(2 - 2 * worst, 1e-9)), far), far)
        for start in range(0, len(x), SLICE):
            some = slice(start, start + SLICE)
            row, leaf = shared.value.visits(x[some], d[some], miss)
            row, leaf = np.concatenate([np.arange(len(x[some])), row]), np.concatenate([own[some], leaf])
            to, first = leaf >> local, np.arange(len(row)) >= len(x[some])
            order = np.lexsort((leaf, first, to, row))
            row, leaf, to = row[order], leaf[order], to[order]
            begins = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(to, prepend=-1) != 0))
            numbers = (leaf & ((1 << local) - 1)).astype("<u4")
            ends = np.append(begins[1:], len(row))
            met = pdf.iloc[start + row[begins]][["id", "code"]]
            yield met.assign(region=to[begins], away=to[begins] != region, at=[numbers[b:e].tobytes() for b, e in zip(begins, ends)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, parts = -1, []
        for region, pdf in _stretches(batches):
            if region != now and parts:
                yield from visits(now, pd.concat(parts, ignore_index=True))
                parts = []
            now = region
            parts.append(pdf)
        if parts:
            yield from visits(now, pd.concat(parts, ignore_index=True))

    return run


class Region:
    """The residents of one region by leaf; visitors are verified against them as they come, and only residents are held."""

    def __init__(self, pdf: pd.DataFrame, k: int, floor: float | None):
        self.k, self.floor = k, floor
        own = np.array([int.from_bytes(a[:4], "little") for a in pdf["at"]], dtype=np.int64)
        self.rows = pdf.iloc[np.argsort(own, kind="stable")]
        own = np.sort(own)
        self.ids, self.x = self.rows["id"].to_numpy(), _unit(self.rows["code"])
        self.of = {leaf: slice(at[0], at[-1] + 1) for leaf, at in _runs(own)}

    def residents(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for at in self.of.values():
            a, b, s = verified(self.x[at], self.k, self.floor)
            yield self.ids[at][a], self.ids[at][b], s
        yield from self.visitors(self.rows.assign(at=[a[4:] for a in self.rows["at"]]))

    def visitors(self, pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for start in range(0, len(pdf), SLICE):
            some = pdf.iloc[start : start + SLICE]
            ids, v = some["id"].to_numpy(), _unit(some["code"])
            row = np.repeat(np.arange(len(some)), [len(a) // 4 for a in some["at"]])
            for leaf, places in _runs(np.frombuffer(b"".join(some["at"]), dtype="<u4").astype(np.int64)):
                at = self.of.get(leaf)
                if at is not None:
                    r, c, s = between(v[row[places]], self.x[at], self.k, self.floor)
                    a, b = ids[row[places][r]], self.ids[at][c]
                    yield np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s])


def _verified(k: int, floor: float | None):
    """(id, other, sim) of rows sorted by region, residents first."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        now, parts, held = -1, [], None
        for region, pdf in _stretches(batches):
            if region != now:
                if parts:
                    yield from Region(pd.concat(parts, ignore_index=True), k, floor).residents()
                now, parts, held = region, [], None
            away = pdf["away"].to_numpy()
            if not away.all():
                parts.append(pdf[~away])
            if away.any():
                if parts:
                    held, parts = Region(pd.concat(parts, ignore_index=True), k, floor), []
                    yield from held.residents()
                if held is not None:
                    yield from held.visitors(pdf[away])
        if parts:
            yield from Region(pd.concat(parts, ignore_index=True), k, floor).residents()

    def best(found: list) -> pd.DataFrame:
        a, b, s = (np.concatenate(z) for z in zip(*found))
        order = np.lexsort((-s, b, a))  # two vectors may visit each other
        a, b, s = a[order], b[order], s[order]
        once = (np.diff(a, prepend=-1) != 0) | (np.diff(b, prepend=-1) != 0)
        return pd.DataFrame(dict(zip(("id", "other", "sim"), _top(a[once], b[once], s[once], k))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pending, size = [], 0
        for one in found(batches):
            pending.append(one)
            size += len(one[0])
            if size > 1_000_000:
                yield best(pending)
                pending, size = [], 0
        if pending:
            yield best(pending)

    return run


def nearest(df: DataFrame, id_col: str, vector: str, k: int = 5, min_sim: float | None = None, miss: float = 0.1, leaf: int = LEAF) -> DataFrame:
    """(id_a, id_b, cosine): up to ``k`` most similar other ids of every id, of cosine ``min_sim`` or more if that is given.

    All vectors must have one length.  Ids with null, empty, all-zero or non-finite vectors take no part; repeated
    ids count once, by the vector of least md5.  Of a group of equal vectors each member gets the k members of smallest id (cosine 1), and if there are
    fewer the neighbours of the group.  An empty table gives no rows.  Answers are approximate: ``miss`` is the chance of one
    side's leaves to hold no neighbour at the distance of its k-th neighbour or of ``min_sim``; a pair is lost where
    neither side visits the other's own leaf, which is less likely, and far less still for nearer pairs.
    Similarities are of vectors rounded to 16 bits a coordinate (error below 1e-4).
    """
    spark = df.sparkSession
    packed = spread(clean_vectors(df, id_col, vector)).mapInPandas(_pack, f"id {dict(df.dtypes)[id_col]}, code binary").withColumn("n", F.monotonically_increasing_id())
    packed = cut(packed)
    # 128 bits stand for a code, so that few bytes are moved
    members = cut(packed.select("id", F.struct(F.md5("code").alias("mark"), "n").alias("x")).groupBy("id").agg(F.min("x").alias("x")).select("id", "x.mark", "x.n"))
    groups = cut(members.groupBy("mark").agg(F.min_by("id", "n").alias("rep"), F.min("n").alias("n"), F.count(F.lit(1)).alias("copies")))
    total = groups.count()
    found = None
    if total > 1:
        wanted = max(log2(total / leaf), log2(LEAVES * spark.sparkContext.defaultParallelism))
        depth = max(0, ceil(min(wanted, log2(total / LEAST))))
        local = depth - max(0, min(depth, ceil(max(log2(total / REGION), log2(REGIONS * spark.sparkContext.defaultParallelism)))))
        width = packed.select((F.length("code") / 2).cast("int")).first()[0]
        project = np.random.default_rng(100).standard_normal((width, depth)).astype(np.float32)
        share = min(1.0, max(SAMPLE, SAMPLE_LEAF << depth) / total)

        def projected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield pd.DataFrame({"y": [y.tobytes() for y in _unit(pdf["code"]) @ project]})

        drawn = packed.where(F.pmod(F.xxhash64("code"), F.lit(1 << 40)) < int(share * (1 << 40))).select("code").distinct().mapInPandas(projected, "y binary")
        sample = np.frombuffer(b"".join(sorted(r[0] for r in drawn.collect())), dtype=np.float32).reshape(-1, depth) if depth else np.zeros((0, 0), dtype=np.float32)
        shared = spark.sparkContext.broadcast(Tree(project, sample))
        base = packed.select(F.col("n").alias("id"), "code")
        if packed.count() - total <= MOST_COPIES:
            extra = packed.select("n").join(groups.select("n"), "n", "left_anti").toPandas()["n"].to_numpy(dtype=np.int64)
        else:
            base, extra = base.join(groups.select(F.col("n").alias("id")), "id", "left_semi"), np.zeros(0, dtype=np.int64)
        redundant = spark.sparkContext.broadcast(np.sort(extra))
        parts = 2 << (depth - local) if depth - local < 10 else 1 << (depth - local)
        home = base.mapInPandas(_homes(shared, redundant, local), "id long, code binary, leaf int, region int").repartition(parts, "region").sortWithinPartitions("region")
        met = home.mapInPandas(_visiting(shared, local, k, min_sim, miss), "id long, code binary, region int, away boolean, at binary")
        pairs = met.repartition(parts, "region").sortWithinPartitions("region", "away").mapInPandas(_verified(k, min_sim), "id long, other long, sim float")
        distinct = pairs.groupBy("id", "other").agg(F.max("sim").alias("sim"))
        order = Window.partitionBy("id").orderBy(F.desc("sim"), "other")
        found = cut(distinct.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("id", "other", "sim"))
    drop(packed)
    return _named(members, groups, found, k)


def _named(members: DataFrame, groups: DataFrame, found: DataFrame | None, k: int) -> DataFrame:
    """Neighbours of representatives, as ids; copies are linked to the members of smallest id of their group."""
    copied = groups.where("copies > 1").select("mark", F.col("n").alias("g"))
    members = cut(salted_join(members.select("mark", "id"), copied, "mark").select("g", "id"))
    order = Window.partitionBy("g").orderBy("id")
    low = cut(members.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).select("g", F.col("id").alias("other"), "r"))
    links = salted_join(members, low, "g").where("id <> other").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("r"))).where(F.col("rank") <= k)
    out = links.select(F.col("id").alias("id_a"), F.col("other").alias("id_b"), F.lit(1.0).cast("float").alias("cosine"))
    if found is None:
        return out
    one = found.join(groups.select(F.col("n").alias("id"), F.col("rep").alias("rep_a"), F.col("copies").alias("copies_a")), "id")
    two = one.join(groups.select(F.col("n").alias("other"), F.col("rep").alias("rep_b"), F.col("copies").alias("copies_b")), "other")
    two = cut(two.where(f"copies_a <= {k}").select("id", "rep_a", "copies_a", "other", "rep_b", "copies_b", "sim"))
    single = two.where("copies_a = 1").select(F.col("rep_a").alias("id_a"), "other", "rep_b", "copies_b", "sim")
    several = two.where("copies_a > 1").select(F.col("id").alias("g"), "other", "rep_b", "copies_b", "sim")
    member_rows = several.join(low.where(F.col("r") <= k).select("g", F.col("other").alias("id_a")), "g").select("id_a", "other", "rep_b", "copies_b", "sim")
    asked = single.unionByName(member_rows)
    plain = asked.where("copies_b = 1").select("id_a", F.col("rep_b").alias("id_b"), F.col("sim").alias("cosine"))
    group = asked.where("copies_b > 1").select("id_a", F.col("other").alias("g"), "sim").join(low.where(F.col("r") <= k), "g").select("id_a", F.col("other").alias("id_b"), F.col("sim").alias("cosine"))
    every = plain.unionByName(group).unionByName(out)
    rank = Window.partitionBy("id_a").orderBy(F.desc("cosine"), "id_b")
    return every.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("id_a", "id_b", "cosine")


def similar_pairs(df: DataFrame, id_col: str, vector: str, k: int, min_sim: float) -> DataFrame:
    """(id_a, id_b, cosine), a < b: pairs of which one is among the other's ``k`` nearest, of cosine ``min_sim`` or more."""
    top = nearest(df, id_col, vector, k, min_sim)
    return top.groupBy(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).agg(F.max("cosine").alias("cosine"))
