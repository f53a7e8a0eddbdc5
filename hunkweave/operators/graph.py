"""Graph operators over (case_id, src, dst) edges and (case_id, patch_id) nodes.

A case's graph is one composite commit's and small, so it is gathered into one row after the distinct edges were
found, and a map over rows finds its components; cases are spread over all tasks.  A case too large for that goes through
joins instead (``large_graph``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from . import large_graph
from .large_graph import SMALL, partition_large


def add_edges(*edges: DataFrame) -> DataFrame:
    """Union of edge sets: (source, target, type) is a key, self edges are none."""
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out.where("src <> dst").distinct()


def add_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes with the ends of the edges."""
    return nodes.select("case_id", "patch_id").union(edges.select("case_id", "src")).union(edges.select("case_id", "dst")).distinct()


def successors(edges: DataFrame) -> DataFrame:
    """Distinct (case_id, src, dst): types are collapsed."""
    return edges.select("case_id", "src", "dst").distinct()


def has_edge(edges: DataFrame, src: Column, dst: Column) -> Column:
    """An aggregate: whether the edge is there."""
    return F.coalesce(F.bool_or((F.col("src") == src) & (F.col("dst") == dst)), F.lit(False))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(case_id, patch_id, n_out, n_in), zero for isolated nodes; edges of two types count twice."""
    ends = edges.select("case_id", F.col("src").alias("patch_id"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    ends = ends.union(edges.select("case_id", "dst", F.lit(0), F.lit(1))).union(nodes.select("case_id", "patch_id", F.lit(0), F.lit(0)))
    return ends.groupBy("case_id", "patch_id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def strong_components(nodes: list[int], out: dict[int, list[int]]) -> list[list[int]]:
    """Strongly connected components of more than one node or with a self loop, by paths grown on an explicit stack."""
    seen: dict[int, int] = {}
    done: set[int] = set()
    path: list[int] = []  # nodes that may still join the component of one below them
    bounds: list[int] = []  # first numbers of the components on the path
    found = []
    for root in nodes:
        if root in seen:
            continue
        work: list[tuple[int, Iterator[int]]] = []

        def enter(v: int) -> None:
            seen[v] = len(seen)
            path.append(v)
            bounds.append(seen[v])
            work.append((v, iter(out.get(v, ()))))

        enter(root)
        while work:
            v, targets = work[-1]
            for w in targets:
                if w not in seen:
                    enter(w)
                    break
                if w not in done:
                    while bounds[-1] > seen[w]:
                        bounds.pop()
            else:
                work.pop()
                if bounds[-1] == seen[v]:
                    bounds.pop()
                    own = []
                    while not own or own[-1] != v:
                        own.append(path.pop())
                    done.update(own)
                    if len(own) > 1 or v in out.get(v, ()):
                        found.append(own)
    return found


def weak_components(nodes: list[int], pairs: list[tuple[int, int]]) -> list[list[int]]:
    parent = {v: v for v in nodes}

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    held: dict[int, list[int]] = {}
    for v in nodes:
        held.setdefault(root(v), []).append(v)
    return list(held.values())


def partition(nodes: list[int], pairs: list[tuple[int, int]], classes: list[list[int]] | None = None) -> list[tuple[str, list[int]]]:
    """("strong", members) and ("weak", members): strong components, and weak ones of what is left without the edges to them.

    classes: nodes of which each has an edge to all smaller ones.  What these edges reach, and what they tie of any of them, a chain from
    each node to the next smaller one does too, so the pairs are never made.
    """
    out: dict[int, list[int]] = {}
    chains = [sorted(set(c)) for c in classes or ()]
    for a, b in [*pairs, *((b, a) for c in chains for a, b in zip(c, c[1:]))]:
        out.setdefault(a, []).append(b)
    strong = strong_components(nodes, out)
    taken = {v for g in strong for v in g}
    rest = [v for v in nodes if v not in taken]
    left = [[v for v in c if v not in taken] for c in chains]
    weak = weak_components(rest, [(a, b) for a, b in [*pairs, *(x for c in left for x in zip(c, c[1:]))] if a not in taken and b not in taken])
    return [("strong", g) for g in strong] + [("weak", g) for g in weak]


def _partitioned(nodes: DataFrame, edges: DataFrame, small: int = SMALL, classes: DataFrame | None = None) -> DataFrame:
    """(case_id, group_id, patch_id, kind); group_id is the smallest member.

    classes: (case_id, class_id, patch_id), whose every hunk has an edge to each smaller one of its class.  A case of up to ``small`` edges is a row and one task's; larger ones go through joins.
    """
    pairs = written(successors(edges).where("src <> dst"), "pairs")
    loops = edges.where("src = dst").select("case_id", F.col("src").alias("patch_id"))
    none = F.lit(None).cast("long")
    rows = nodes.select("case_id", "patch_id").union(loops).select("case_id", "patch_id", none.alias("src"), none.alias("dst"), none.alias("class_id")).union(pairs.select("case_id", none, "src", "dst", none))
    if classes is not None:
        rows = rows.union(classes.select("case_id", "patch_id", none, none, "class_id"))
    counted = pairs.select("case_id") if classes is None else pairs.select("case_id").union(classes.select("case_id"))
    large = counted.groupBy("case_id").count().where(F.col("count") > small).select("case_id")
    joined = None
    if not large.isEmpty():
        large = written(large, "large")
        own = pairs.join(large, "case_id", "left_semi")
        tied = None if classes is None else classes.join(large, "case_id", "left_semi")
        all_nodes = nodes.join(large, "case_id", "left_semi")
        joined = partition_large(add_nodes(all_nodes if tied is None else all_nodes.select("case_id", "patch_id").union(tied.select("case_id", "patch_id")), own), own, small, tied)
        rows = rows.join(large, "case_id", "left_anti")
    held = rows.groupBy("case_id").agg(F.collect_list("patch_id").alias("ids"), F.collect_list("src").alias("srcs"), F.collect_list("dst").alias("dsts"), F.collect_list(F.when(F.col("class_id").isNotNull(), F.struct(F.col("class_id").cast("long").alias("c"), F.col("patch_id").cast("long").alias("p")))).alias("classes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cases, groups, members, kinds = [], [], [], []
            for case, ids, srcs, dsts, tied in zip(*(b.column(c).to_pylist() for c in ("case_id", "ids", "srcs", "dsts", "classes"))):
                held: dict[int, list[int]] = {}
                for x in tied:
                    held.setdefault(x["c"], []).append(x["p"])
                for kind, own in partition(sorted({*ids, *srcs, *dsts}), list(zip(srcs, dsts)), list(held.values())):
                    cases += [case] * len(own)
                    groups += [min(own)] * len(own)
                    members += own
                    kinds += [kind] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(cases, pa.int64()), pa.array(groups, pa.int64()), pa.array(members, pa.int64()), pa.array(kinds, pa.string())], ["case_id", "group_id", "patch_id", "kind"])

    longs = held.select(F.col("case_id").cast("long"), F.col("ids").cast("array<bigint>"), F.col("srcs").cast("array<bigint>"), F.col("dsts").cast("array<bigint>"), "classes")
    out = longs.mapInArrow(run, "case_id long, group_id long, patch_id long, kind string")
    return out if joined is None else out.unionByName(joined)


def partition_groups(nodes: DataFrame, edges: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(case_id, group_id, patch_id): every node in one group.

    Strong components of two nodes or more are groups; the rest are weakly connected components of the graph that is left
    without them, so a node that only touches a strong component stays outside it.  classes: as ``joins.trivial_classes`` gives them, in place of
    the edges between all their hunks.
    """
    return _partitioned(nodes, edges, classes=classes).drop("kind")


def scc_groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _partitioned(nodes, edges).where("kind = 'strong'").drop("kind")


def weak_groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Weakly connected components of what no strong component holds."""
    return _partitioned(nodes, edges).where("kind = 'weak'").drop("kind")


def weak_components_large(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of one graph too large for a row, by joins."""
    return large_graph.weak_components_large(edges.select(F.lit(0).alias("case_id"), "src", "dst"), rounds).select("node", "root")


def group_report(groups: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_groups, n_members, largest) of a partition (keys, group_id, member)."""
    sizes = groups.groupBy(*keys, "group_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_members"), F.max("n").alias("largest"))


def connected(groups: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src, dst, connected) of the pairs: whether both are in one group; a node of no group is connected to nothing."""
    side = lambda c: groups.select(*keys, F.col("patch_id").alias(c), F.col("group_id").alias(f"{c}_group"))
    out = pairs.join(side("src"), [*keys, "src"], "left").join(side("dst"), [*keys, "dst"], "left")
    return out.select(*keys, "src", "dst", F.coalesce(F.col("src_group") == F.col("dst_group"), F.lit(False)).alias("connected"))
