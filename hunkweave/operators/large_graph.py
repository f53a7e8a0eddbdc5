"""Components of graphs that are too large for a row, by joins; edges are (case_id, src, dst), nodes are known by case and number.

Strong components are found by trimming, chain contraction and colouring.  A node that no edge leads to or from is in no cycle and goes.  A
run of nodes with one edge in and one out is drawn together into one edge: whether it is in a cycle follows from the edge's ends.  Of what is left, each
node takes the highest mark of all that reach it, its colour; a component lies within one colour, and what reaches the node that a colour comes from, in this colour,
is its component.  The edges between other nodes of one colour are the next round's graph.  Cases whose edges have become few are searched in a task.

Tables between the steps are dealt once, by case, or for cases too large for that by case and node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import Dealt, stay_dealt, tasks, written

#: Edges of a case that one task may search: some 100 MB as Python objects.
SMALL = 200_000
#: Edges of a case that is dealt as a whole, and edges that a task is dealt.
WHOLE = ROWS = 131_072
#: Keeps a table of this name, dealt by its cases, or by them and this column.
Keep = Callable[[DataFrame, str, str], Dealt]
NODE, EDGE = ["case_id", "node"], ["case_id", "src", "dst"]


def _ends(edges: DataFrame, c: str) -> DataFrame:
    return edges.select("case_id", F.col(c).alias("node"))


def _on(nodes: DataFrame, c: str, *also: str) -> DataFrame:
    """nodes with their node column named as an edge's end, and other columns with that name in front."""
    return nodes.select("case_id", F.col("node").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in also])


def trimmed(edges: DataFrame, keep: Keep) -> DataFrame:
    """The edges left once nodes without edges in or without edges out were taken away again and again, as long as that takes a tenth away."""
    n = edges.count()
    while n:
        live = _ends(edges, "src").distinct().join(_ends(edges, "dst").distinct(), NODE)
        left = edges.join(_on(live, "src"), ["case_id", "src"], "left_semi").join(_on(live, "dst"), ["case_id", "dst"], "left_semi").select(*EDGE)
        m = left.count()
        if m < n:
            edges = keep(left, "trimmed", "src").rows
        if 10 * (n - m) < n:
            break
        n = m
    return edges


def contracted(edges: DataFrame, keep: Keep) -> tuple[DataFrame, DataFrame]:
    """(edges, inner (case_id, node, before, after)): runs of nodes with one edge in and one out as one edge from before to after.

    Each inner node doubles its steps towards the ends of its run, so there are as many rounds as the longest run's length has binary digits.
    """
    end = lambda c, o, i: F.struct(F.col(c).alias("node"), F.lit(o).alias("o"), F.lit(i).alias("i"))
    degree = edges.select("case_id", F.explode(F.array(end("src", 1, 0), end("dst", 0, 1))).alias("e")).select("case_id", "e.*")
    inner = degree.groupBy(*NODE).agg(F.sum("o").alias("o"), F.sum("i").alias("i")).where("o = 1 AND i = 1").select(*NODE)
    inner = keep(inner, "inner", "node").rows
    back = edges.join(_on(inner, "dst"), ["case_id", "dst"], "left_semi").select("case_id", F.col("dst").alias("node"), F.col("src").alias("before"))
    on = edges.join(_on(inner, "src"), ["case_id", "src"], "left_semi").select("case_id", F.col("src").alias("node"), F.col("dst").alias("after"))
    mine = lambda c: _on(inner, c).withColumn(f"{c}_open", F.lit(True))
    runs = back.join(on, NODE).join(mine("before"), ["case_id", "before"], "left").join(mine("after"), ["case_id", "after"], "left")
    runs = keep(runs.select(*NODE, "before", "after", *[F.coalesce(f"{c}_open", F.lit(False)).alias(f"{c}_open") for c in ("before", "after")]), "runs", "node").rows
    open_ = F.count_if("before_open") + F.count_if("after_open")
    n = runs.agg(open_).first()[0]
    while n:
        for c in ("before", "after"):
            step = runs.select("case_id", F.col("node").alias(c), F.col(c).alias("further"), F.col(f"{c}_open").alias("more"))
            runs = runs.join(step, ["case_id", c], "left").withColumn(c, F.coalesce("further", c)).withColumn(f"{c}_open", F.coalesce("more", F.lit(False))).drop("further", "more")
        runs = keep(runs.select(*NODE, "before", "after", "before_open", "after_open"), "runs", "node").rows
        m = runs.agg(open_).first()[0]
        if m == n:  # some node of every run with ends comes to one in each round, so what is open now are cycles
            break
        n = m
    # A cycle of inner nodes alone has no ends and stays as it is.
    gone = runs.where("NOT before_open AND NOT after_open").select(*NODE, "before", "after")
    kept = edges.join(_on(gone, "src"), ["case_id", "src"], "left_anti").join(_on(gone, "dst"), ["case_id", "dst"], "left_anti")
    ends = gone.select("case_id", F.col("before").alias("src"), F.col("after").alias("dst")).where("src <> dst").distinct()
    out = keep(kept.select(*EDGE), "edges", "src")
    out.add(ends.join(out.rows, EDGE, "left_anti"))
    return out.rows, gone


def coloured(edges: DataFrame, keep: Keep) -> DataFrame:
    """(case_id, node, of): the node with the highest mark of all that reach a node, itself included.

    A round tells only what the last one changed, and adds only what it changes itself.
    """
    mark = lambda of: F.struct(F.xxhash64("case_id", of).alias("mark"), F.col(of).alias("of"))
    nodes = edges.select("case_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    colours = keep(nodes.select(*NODE, F.col("node").alias("of"), F.lit(0).alias("round")), "colours", "node")
    k = 0
    while True:
        best = colours.rows.groupBy(*NODE).agg(F.max(mark("of")).alias("c"))
        last = colours.rows.where(F.col("round") == k)
        if last.isEmpty():
            return best.select(*NODE, "c.of")
        told = edges.join(_on(last, "src", "of"), ["case_id", "src"]).groupBy("case_id", F.col("dst").alias("node")).agg(F.max(mark("src_of")).alias("p"))
        k += 1
        colours.add(told.join(best, NODE).where("p > c").select(*NODE, "p.of", F.lit(k)))


def _found(edges: DataFrame, colours: DataFrame, keep: Keep) -> tuple[DataFrame, DataFrame]:
    """((case_id, node, of) of the nodes that reach their colour's origin within the colour, the edges of one colour between the others)."""
    own = edges.join(_on(colours, "src", "of"), ["case_id", "src"]).join(_on(colours, "dst", "of"), ["case_id", "dst"]).where("src_of = dst_of")
    own = keep(own.select(*EDGE, F.col("src_of").alias("of")), "own", "dst").rows
    reached = keep(colours.where("node = of").select(*NODE, "of", F.lit(0).alias("round")), "reached", "node")
    k = 0
    while not (last := reached.rows.where(F.col("round") == k)).isEmpty():
        met = own.join(_on(last, "dst"), ["case_id", "dst"], "left_semi").select("case_id", F.col("src").alias("node"), "of").distinct()
        k += 1
        reached.add(met.join(reached.rows, NODE, "left_anti").select(*NODE, "of", F.lit(k)))
    has = reached.rows.select(*NODE, "of")
    left = own.join(_on(has, "src"), ["case_id", "src"], "left_anti").join(_on(has, "dst"), ["case_id", "dst"], "left_anti")
    return has, keep(left.select(*EDGE), "edges", "src").rows


def _in_tasks(edges: DataFrame) -> DataFrame:
    """(case_id, node, of) of the strong components of cases whose edges fit a row each."""
    from .graph import strong_components

    held = edges.groupBy(F.col("case_id").cast("long").alias("case_id")).agg(F.collect_list(F.col("src").cast("long")).alias("srcs"), F.collect_list(F.col("dst").cast("long")).alias("dsts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cases, nodes, of = [], [], []
            for case, srcs, dsts in zip(*(b.column(c).to_pylist() for c in ("case_id", "srcs", "dsts"))):
                out: dict[int, list[int]] = {}
                for s, d in zip(srcs, dsts):
                    out.setdefault(s, []).append(d)
                for own in strong_components(list(out), out):
                    cases += [case] * len(own)
                    nodes += own
                    of += [own[0]] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (cases, nodes, of)], ["case_id", "node", "of"])

    return held.mapInArrow(run, "case_id long, node long, of long")


def strong_components_large(edges: DataFrame, small: int = SMALL, whole: int = WHOLE) -> DataFrame:
    """(case_id, node, root) of the strong components of two nodes or more; root is the smallest node of each.

    small: edges of a case that one task may search.  whole: edges of a case that is dealt as a whole, so that no join moves its edges
    or nodes again; larger ones are dealt by their nodes.  The rounds follow the longest shortest way within a colour once runs were
    drawn together; each adds no more than the nodes that it changes.
    """
    edges = written(edges.select(F.col("case_id").cast("long").alias("case_id"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src <> dst").distinct(), "edges")
    wide = written(edges.groupBy("case_id").count().where(F.col("count") > whole).select("case_id"), "wide")
    if wide.isEmpty():
        return _strong(edges, small, by_case=True)
    narrow = _strong(edges.join(wide, "case_id", "left_anti"), small, by_case=True)
    return narrow.unionByName(_strong(edges.join(wide, "case_id", "left_semi"), small, by_case=False))


def _strong(edges: DataFrame, small: int, by_case: bool) -> DataFrame:
    n = tasks(edges.count(), ROWS)

    def keep(df: DataFrame, name: str, by: str) -> Dealt:
        return Dealt(df, name, n, ["case_id"] if by_case else ["case_id", by])

    with stay_dealt(edges.sparkSession):
        edges = keep(edges, "edges", "src").rows
        found, runs = [], []
        while True:
            edges = trimmed(edges, keep)
            if small:
                sizes = edges.groupBy("case_id").count()
                few = sizes.where(F.col("count") <= small).select("case_id")
                found.append(keep(_in_tasks(edges.join(few, "case_id", "left_semi")), "strong", "node").rows)
                edges = keep(edges.join(few, "case_id", "left_anti"), "edges", "src").rows
            if edges.isEmpty():
                break
            edges, gone = contracted(edges, keep)
            runs.append(gone)
            own, edges = _found(edges, coloured(edges, keep), keep)
            found.append(own.join(own.groupBy("case_id", "of").count().where("count > 1"), ["case_id", "of"], "left_semi").select(*NODE, "of"))
        all_ = keep(edges.select("case_id", F.col("src").alias("node"), F.col("dst").alias("of")), "strong", "node")  # no edge is left, so no row
        for x in found:
            all_.add(x)
        for gone in reversed(runs):  # the inner nodes of a run are in its ends' component if both are in one; a run from a node to itself is a cycle
            ends = gone.join(_on(all_.rows, "before", "of"), ["case_id", "before"], "left").join(_on(all_.rows, "after", "of"), ["case_id", "after"], "left")
            same = (F.col("before") == F.col("after")) | (F.col("before_of") == F.col("after_of"))
            of = F.coalesce("before_of", "before")
            with_before = F.when(F.col("before_of").isNull(), F.array("node", "before")).otherwise(F.array("node"))
            all_.add(ends.where(same).select("case_id", F.explode(with_before).alias("node"), of.alias("of")).distinct())
        roots = all_.rows.groupBy("case_id", "of").agg(F.min("node").alias("root"))
        return keep(all_.rows.join(roots, ["case_id", "of"]).select(*NODE, "root"), "roots", "node").rows


def weak_components_large(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(case_id, node, root) of every node that has an edge: every node takes the least label around it, then its label's label."""
    both = written(edges.select("case_id", "src", "dst").union(edges.select("case_id", "dst", "src")).distinct(), "edges")
    labels = written(both.groupBy("case_id", F.col("src").alias("node")).agg(F.least(F.col("node"), F.min("dst")).alias("root")), "labels")
    last = None
    for _ in range(rounds):
        near = both.join(_on(labels, "dst", "root"), ["case_id", "dst"]).groupBy("case_id", F.col("src").alias("node")).agg(F.min("dst_root").alias("near"))
        hop = labels.select("case_id", F.col("node").alias("root"), F.col("root").alias("next"))
        labels = written(labels.join(near, NODE).join(hop, ["case_id", "root"]).select(*NODE, F.least("near", "next").alias("root")), "labels")
        state = labels.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if state == last:
            return labels
        last = state
    raise RuntimeError("labels did not settle")


def chain_edges(classes: DataFrame) -> DataFrame:
    """(case_id, src, dst) from each member of a class (case_id, class_id, patch_id) to the next smaller one."""
    below = F.lag("patch_id").over(Window.partitionBy("case_id", "class_id").orderBy("patch_id"))
    return classes.select("case_id", F.col("patch_id").alias("src"), below.alias("dst")).where("dst IS NOT NULL")


def partition_large(nodes: DataFrame, edges: DataFrame, small: int = SMALL, classes: DataFrame | None = None) -> DataFrame:
    """(case_id, group_id, patch_id, kind) as ``graph.partition_groups`` gives them, of cases of any size.  nodes hold the ends of all edges and the members of all classes."""
    edges = edges.select(*EDGE)
    strong = written(strong_components_large(edges if classes is None else edges.union(chain_edges(classes)), small), "strong")
    if classes is not None:
        left = classes.join(_on(strong, "patch_id"), ["case_id", "patch_id"], "left_anti")
        edges = edges.union(chain_edges(left))
    rest = written(nodes.select("case_id", F.col("patch_id").alias("node")).join(strong, NODE, "left_anti"), "rest")
    free = edges.where("src <> dst").join(_on(rest, "src"), ["case_id", "src"], "left_semi").join(_on(rest, "dst"), ["case_id", "dst"], "left_semi")
    weak = weak_components_large(free)
    weak = rest.join(weak, NODE, "left").select("case_id", F.coalesce("root", "node").alias("group_id"), F.col("node").alias("patch_id"), F.lit("weak").alias("kind"))
    return strong.select("case_id", F.col("root").alias("group_id"), F.col("node").alias("patch_id"), F.lit("strong").alias("kind")).union(weak)
