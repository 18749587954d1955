"""Resolution and links over time: neighbour ranks, equal facts, strata and draws, counters, and the smallest cut of contradicting groups."""

from __future__ import annotations

from collections import deque
from collections.abc import Hashable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.operators.vectors import top_k


def neighbour_ranks(base: DataFrame, queries: DataFrame, key: str, vector: str, facet: str | None, top: int) -> DataFrame:
    """(a, b, rank, cosine), a < b: pairs of which one is among the other's ``top`` nearest, with the better rank of both directions."""
    near = top_k(base, queries, top, key, vector, facet)
    return near.groupBy(F.least("query", key).alias("a"), F.greatest("query", key).alias("b")).agg(F.min("rank").alias("rank"), F.max("score").alias("cosine"))


def earlier_neighbours(later: DataFrame, earlier: DataFrame, key: str, vector: str, pair: str, top: int) -> DataFrame:
    """(later_key, earlier_key, rank, cosine): of each later item the ``top`` nearest earlier ones of its filing pair, ties by key."""
    near = top_k(earlier, later, top, key, vector, pair, skip_self=False)
    return near.select(F.col("query").alias("later_key"), F.col(key).alias("earlier_key"), "rank", F.col("score").alias("cosine"))


def same_facts(nodes: DataFrame, key: str, facts: list[str]) -> DataFrame:
    """(key, fact_class, links): keys that state the same facts, by the least key of their class; classes of one key are left out, and so are null facts.

    One row a key instead of all pairs within a class: every two keys of a class are linked.
    """
    rows = nodes.select(key, *facts).dropna().distinct()
    g = rows.groupBy(*facts).agg(F.min(key).alias("fact_class"), (F.count_distinct(key) - 1).alias("links")).where("links > 0")
    return rows.join(g, facts).select(key, "fact_class", "links")


def stratum(rules: Column, fuzzy: Column, rank: Column, cutoff: float, top: int, margin: float = 10.0, factor: int = 3) -> Column:
    """candidate where any rule fired, near where a score just missed its cutoff, else rest."""
    near = (F.coalesce(fuzzy, F.lit(0.0)) >= cutoff - margin) | (F.coalesce(rank, F.lit(1 << 30)) <= factor * top)
    return F.when(F.size(rules) > 0, "candidate").when(near, "near").otherwise("rest")


def draw_strata(pairs: DataFrame, sizes: dict[str, int], seed: str, exclude: DataFrame | None = None) -> DataFrame:
    """(stratum, key_a, key_b, place, population): of each stratum the first ``sizes`` pairs in the order of a salted SHA-256, without excluded pairs.

    pairs: stratum, key_a, key_b; ``population`` is the number of pairs the stratum was drawn from.
    """
    rows = pairs.select("stratum", "key_a", "key_b").distinct()
    if exclude is not None:
        rows = rows.join(exclude.select("key_a", "key_b").distinct(), ["key_a", "key_b"], "left_anti")
    population = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("population"))
    order = F.sha2(F.concat_ws("\n", F.lit(seed), "key_a", "key_b"), 256)
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("stratum").orderBy(order, "key_a", "key_b")))
    wanted = F.try_element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("stratum"))
    return placed.where(F.col("place") <= wanted).join(population, "stratum").select("stratum", "key_a", "key_b", "place", "population")


def round_robin(pool: DataFrame, by: str, once: str, key: str, n: int, seed: str) -> DataFrame:
    """(key, by, place): ``n`` rows drawn in turn from the groups of ``by``, no value of ``once`` twice.

    A value of ``once`` stands for its row of least salted hash; groups are drawn from in that order, one row a turn, in order of name.
    """
    order = F.sha2(F.concat_ws("\n", F.lit(seed), F.col(key).cast("string")), 256)
    one = pool.where(F.col(once).isNotNull()).groupBy(once).agg(F.min(F.struct(order.alias("h"), F.col(key), F.col(by))).alias("x")).select("x.*")
    turns = one.withColumn("turn", F.row_number().over(Window.partitionBy(by).orderBy("h", key)))
    drawn = turns.orderBy("turn", by).limit(n)
    return drawn.withColumn("place", F.row_number().over(Window.orderBy("turn", by))).select(key, by, "place")  # over n rows


def slots(pool: DataFrame, by: str, key: str, quotas: dict[str, int], seed: str) -> DataFrame:
    """(key, by, fallback): each group's quota in the order of a salted hash; slots a group cannot fill go to the least hashes of all others."""
    order = F.sha2(F.concat_ws("\n", F.lit(seed), F.col(key).cast("string")), 256)
    wanted = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(by)), F.lit(0))
    rows = pool.select(key, by).distinct().withColumn("__h", order).withColumn("__p", F.row_number().over(Window.partitionBy(by).orderBy("__h", key)))
    own = rows.where(F.col("__p") <= wanted)
    size = sum(quotas.values())
    spare = rows.where(F.col("__p") > wanted).orderBy("__h", key).limit(size)  # no more than all slots are ever open
    both = own.withColumn("__own", F.lit(0)).unionByName(spare.withColumn("__own", F.lit(1))).orderBy("__own", "__h", key).limit(size)
    return both.select(key, by, (F.col("__own") == 1).alias("fallback"))


def rule_counts(pairs: DataFrame) -> DataFrame:
    """(rule, pairs, only): pairs each rule proposed, and those no other rule did.  pairs: rules (array)."""
    return pairs.select(F.explode("rules").alias("rule"), (F.size("rules") == 1).alias("alone")).groupBy("rule").agg(F.count(F.lit(1)).alias("pairs"), F.count_if("alone").alias("only"))


def pair_counts(pairs: DataFrame, items: DataFrame, links: DataFrame) -> DataFrame:
    """(later, earlier, later_items, earlier_items, possible, exact, open): counters of each filing pair.

    pairs: later, earlier; items: filing, key; links: later, later_key (exact matches).  ``possible`` is the number of pairs of items, which are not formed.
    """
    n = items.groupBy("filing").agg(F.count_distinct("key").alias("n"))
    e = links.groupBy("later").agg(F.count_distinct("later_key").alias("exact"))
    zero = F.lit(0)
    out = pairs.join(n.select(F.col("filing").alias("later"), F.col("n").alias("a")), "later", "left").join(n.select(F.col("filing").alias("earlier"), F.col("n").alias("b")), "earlier", "left").join(e, "later", "left")
    a, b, x = F.coalesce("a", zero), F.coalesce("b", zero), F.coalesce("exact", zero)
    return out.select("later", "earlier", a.alias("later_items"), b.alias("earlier_items"), (a * b).alias("possible"), x.alias("exact"), (a - x).alias("open"))


class Cuts:
    """All smallest sets of links whose removal separates every forbidden pair, by branch and bound on a shrinking graph.

    A step takes a forbidden pair that is still linked: a direct link between the two has to go; else the first link of a shortest path
    between them is either kept, which makes its ends one vertex, or cut.  A branch ends when it costs more than the best so far.
    """

    def __init__(self, links: dict[tuple[int, int], int], apart: set[tuple[int, int]], n: int):
        self.n, self.links = n, links
        self.best, self.found = sum(links.values()), set()
        near: dict[int, dict[int, int]] = {v: {} for v in range(n)}
        for (a, b), w in links.items():
            near[a][b] = near[b][a] = near[a].get(b, 0) + w
        foes: dict[int, set[int]] = {v: set() for v in range(n)}
        for a, b in apart:
            foes[a].add(b), foes[b].add(a)
        self._step(near, foes, {v: (v,) for v in range(n)}, 0)

    def _linked(self, near: dict, foes: dict) -> tuple[int, int, int] | None:
        """(a, first vertex on a shortest way to b, b) of a forbidden pair still linked, the nearest first."""
        best, length = None, self.n + 1
        for a in sorted(foes):
            if not foes[a]:
                continue
            first, seen = {a: a}, deque([(a, 0)])
            while seen:
                v, k = seen.popleft()
                if k + 1 >= length:
                    break
                for u in sorted(near[v]):
                    if u not in first:
                        first[u] = u if v == a else first[v]
                        if u in foes[a]:
                            best, length = (a, first[u], u), k + 1
                            break
                        seen.append((u, k + 1))
                else:
                    continue
                break
            if length == 1:
                break
        return best

    def _step(self, near: dict, foes: dict, held: dict, cost: int) -> None:
        if cost > self.best:
            return
        way = self._linked(near, foes)
        if way is None:
            if cost < self.best:
                self.best, self.found = cost, set()
            self.found.add(self._pieces(near, held))
            return
        a, x, b = way
        without = {v: dict(u) for v, u in near.items()}
        w = without[a].pop(x)
        without[x].pop(a)
        if x != b and x not in foes[a]:
            joined, other = {v: dict(u) for v, u in near.items()}, {v: set(u) for v, u in foes.items()}
            for u, k in joined.pop(x).items():
                joined[u].pop(x)
                if u != a:
                    joined[a][u] = joined[u][a] = joined[a].get(u, 0) + k
            for u in other.pop(x):
                other[u].discard(x)
                other[a].add(u), other[u].add(a)
            both = dict(held)
            both[a] = tuple(sorted(both[a] + both.pop(x)))
            self._step(joined, other, both, cost)
        self._step(without, foes, held, cost + w)

    def _pieces(self, near: dict, held: dict) -> tuple:
        out, seen = [], set()
        for v in near:
            if v not in seen:
                own, todo = [], [v]
                seen.add(v)
                while todo:
                    u = todo.pop()
                    own += held[u]
                    todo += [t for t in near[u] if t not in seen]
                    seen.update(near[u])
                out.append(tuple(sorted(own)))
        return tuple(sorted(out))


def smallest_cut(same: list[tuple], against: list[tuple]) -> tuple[int, list[tuple[Hashable, Hashable]], int, list]:
    """(answers cut, (key, piece) of every key, number of smallest cuts, tied keys) that separates every ``against`` pair.

    A pair that ``same`` names again counts again.  Of several smallest cuts their common refinement is taken: keys stay together only where all
    of them keep them so; ``tied`` are the keys that stand alone in it though not in every cut.
    """
    nodes = sorted({x for p in [*same, *against] for x in p})
    at = {x: k for k, x in enumerate(nodes)}
    links: dict[tuple[int, int], int] = {}
    for a, b in same:
        i, j = sorted((at[a], at[b]))
        if i != j:
            links[i, j] = links.get((i, j), 0) + 1
    apart = {tuple(sorted((at[a], at[b]))) for a, b in against if a != b}
    cuts = Cuts(links, apart, len(nodes))
    marks = [[0] * len(nodes) for _ in cuts.found]
    for row, pieces in zip(marks, sorted(cuts.found)):
        for k, piece in enumerate(pieces):
            for v in piece:
                row[v] = k
    together: dict[tuple, list[int]] = {}
    for v in range(len(nodes)):
        together.setdefault(tuple(row[v] for row in marks), []).append(v)
    piece_of = {v: min(vs) for vs in together.values() for v in vs}
    alone = {vs[0] for vs in together.values() if len(vs) == 1}
    tied = [nodes[v] for v in sorted(alone) if any(sum(r == row[v] for r in row) > 1 for row in marks)]
    return cuts.best, [(nodes[v], nodes[piece_of[v]]) for v in range(len(nodes))], len(cuts.found), tied
