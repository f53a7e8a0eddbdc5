"""A Merkle manifest of a dataset: built from the leaves up, with proofs pushed from the root down.

The rows of each part (a language, say) are the leaves of a tree, the parts' roots those of a tree above them.  Levels are
persisted in tiers: a row of a tier holds the ``TIER`` lowest levels above 2 ** TIER consecutive nodes, whose top is a node of the next tier.
On the way down a block joins its parent block, each child prepends its own siblings to the suffix of the proof that its parent
inherited, and only the suffixes of blocks are written: a leaf's whole proof exists only while its digest is taken.
A step of a proof is a digest with L or R in front, for the side the sibling stands on, or empty where a node has no sibling.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Levels in a tier: a block has 2 ** TIER nodes of its lowest level, and 1,024 digests are 64 KB.
TIER = 10
#: Rows that are ranked in one task.
RANGE_ROWS = 1 << 18


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, digests as their hex text, one after another."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value so that no two rows have the same fields in a row: its bytes are counted first; null: a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def ranked(rows: DataFrame, part: str, order: list[str], ranges: int) -> DataFrame:
    """The rows with pos (from 0, in the order given, nulls first) and n, the rows of their part.

    Rows are dealt to ranges of (part, order), so a part of any share of the rows is spread over as many tasks as it needs; ranges are
    numbered within by one task each, and a range starts where those before it end.
    """
    dealt = rows.repartitionByRange(ranges, F.col(part).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order])
    dealt = written(dealt.withColumn("range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(part, "range").agg(F.count(F.lit(1)).alias("held"))
    # As many rows as ranges and parts.
    ahead = Window.partitionBy(part).orderBy("range")
    sizes = sizes.select(F.col(part).alias("of"), F.col("range").alias("at"), (F.sum("held").over(ahead) - F.col("held")).alias("before"), F.sum("held").over(Window.partitionBy(part)).alias("n"))
    local = F.row_number().over(Window.partitionBy(part, "range").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    placed = dealt.withColumn("local", local).join(sizes, F.col("of").eqNullSafe(F.col(part)) & (F.col("at") == F.col("range")))
    return placed.select(*rows.columns, (F.col("before") + F.col("local") - 1).alias("pos"), "n")


def levels(nodes: Column, n: Column, tier: int) -> Column:
    """The levels above a block's nodes, lowest first: ``tier`` of them, or up to the root where these are all n nodes of their part."""
    up = lambda a: F.transform(F.sequence(F.lit(1), F.size(a), F.lit(2)), lambda i: digest(F.element_at(a, i), F.when(i < F.size(a), F.element_at(a, i + 1)).otherwise("")))
    height = F.when(n > 1 << tier, tier).otherwise(F.ceil(F.log2(n)).cast("int"))
    steps = F.slice(F.array(*map(F.lit, range(1, tier + 1))), F.lit(1), height)
    return F.aggregate(steps, F.array(nodes), lambda all_, _: F.concat(all_, F.array(up(F.element_at(all_, -1)))))


def build(nodes: DataFrame, tier: int = TIER) -> list[DataFrame]:
    """The tiers (part, block, n, held, levels), each written, of nodes (part, pos, n, hash, held); the last has one block a part.

    held: what the lowest tier carries for each leaf beside its hash, in order; null above.
    """
    tiers, most = [], 1 << tier
    while True:
        block = nodes.groupBy("part", F.expr(f"pos div {most}").alias("block"), "n").agg(F.sort_array(F.collect_list(F.struct("pos", "hash", "held"))).alias("x"))
        block = block.select("part", "block", "n", F.col("x.held").alias("held"), levels(F.col("x.hash"), F.col("n"), tier).alias("levels"))
        tiers.append(written(block, "tier"))
        above = tiers[-1].where(F.col("n") > most)
        if above.isEmpty():
            return tiers
        nodes = above.select("part", F.col("block").alias("pos"), F.ceil(F.col("n") / most).cast("long").alias("n"), F.element_at(F.element_at("levels", -1), 1).alias("hash"), F.lit(None).cast(tiers[0].schema["held"].dataType.elementType).alias("held"))


def siblings(tree: Column, i: Column) -> Column:
    """The steps of node i (from 0) of a block, from its own level up to the one below the block's top."""

    def step(level: Column, height: Column) -> Column:
        at = F.floor(i / F.pow(F.lit(2), height)).cast("int")
        on_left = at % 2 == 1
        other = F.when(on_left, at - 1).otherwise(at + 1)
        return F.when(other >= F.size(level), "").otherwise(F.concat(F.when(on_left, "L").otherwise("R"), F.get(level, other)))

    return F.transform(F.slice(tree, F.lit(1), F.size(tree) - 1), step)


def push(tiers: list[DataFrame], roots: DataFrame, tier: int = TIER) -> DataFrame:
    """The nodes of the lowest tier: part, held, hash, steps and the other columns of roots (part, suffix, ...).

    Each tier's blocks inherit the suffix of the node above; a part whose tree ends below a tier waits for its own.
    """
    carried = [c for c in roots.columns if c not in ("part", "suffix")]
    down = roots.select("part", F.lit(0).cast("long").alias("block"), "suffix", *carried)
    own = lambda df: df.select(F.col("part").alias("of"), F.col("block").alias("at"), *[c for c in df.columns if c not in ("part", "block")])
    meet = F.col("of").eqNullSafe(F.col("part")) & (F.col("at") == F.col("block"))
    for depth in range(len(tiers) - 1, -1, -1):
        met = tiers[depth].join(own(down), meet)
        # A block's children become rows of their own only with their steps, so that its levels aren't copied for each.
        child = lambda i: F.struct(i.alias("i"), F.get(F.element_at("levels", 1), i).alias("hash"), F.get("held", i).alias("held"), F.concat(siblings(F.col("levels"), i), F.col("suffix")).alias("steps"))
        rows = met.select("part", "block", *carried, F.inline(F.transform(F.sequence(F.lit(0), F.size(F.element_at("levels", 1)) - 1), child)))
        if not depth:
            return rows.drop("block", "i")
        below = rows.select("part", (F.col("block") * (1 << tier) + F.col("i")).alias("block"), F.col("steps").alias("suffix"), *carried)
        waiting = down.join(own(tiers[depth].select("part", "block")), meet, "left_anti")
        down = written(below.unionByName(waiting), "suffixes")
    raise ValueError("a tree has at least one tier")


def fold(hash_: Column, steps: Column) -> Column:
    """The root that a leaf and the steps of its proof give."""
    other = lambda s: F.substring(s, 2, 64)
    return F.aggregate(steps, hash_, lambda h, s: F.when(s == "", digest(h)).when(s.startswith("L"), digest(other(s), h)).otherwise(digest(h, other(s))))


def proof_digest(steps: Column) -> Column:
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.substring(s, 2, 64)), "").cast("binary"), 256)


def manifest(rows: DataFrame, columns: list[str], part_col: str, id_col: str, shown: Column | None = None, tier: int = TIER) -> DataFrame:
    """(id, part, leaf, shown, subroot, root, steps): every row's leaf with its proof.

    A leaf is the digest of a row's ``columns``, in this order.  Leaves stand by id, null ones first, rows that share an id by leaf, so a
    repeated row has a leaf each time; parts stand by name in UTF-8 bytes, a null one first, and are leaves of the tree above.  shown: another leaf to
    be proved in a row's stead, or null.  Null and empty values differ.  An empty table gives no rows; other columns aren't looked at.
    """
    held = rows.select(F.col(part_col).cast("string").alias("part"), F.col(id_col).cast("long").alias("id"), leaf(*[F.col(c) for c in columns]).alias("hash"), (F.lit(None) if shown is None else shown).cast("string").alias("shown"))
    leaves = written(held, "leaves")
    flat = ranked(leaves, "part", ["id", "hash"], _ranges(leaves))
    tiers = build(flat.select("part", "pos", "n", "hash", F.struct("id", "shown").alias("held")), tier)
    tops = [t.where(F.col("n") <= 1 << tier).select(F.lit(0).alias("all"), F.col("part").alias("name"), F.element_at(F.element_at("levels", -1), 1).alias("hash")) for t in tiers]
    parts = written(reduce(DataFrame.union, tops), "subroots")
    if parts.isEmpty():
        schema = "id long, part string, leaf string, shown string, subroot string, root string, steps array<string>"
        return rows.sparkSession.createDataFrame([], schema)
    above = ranked(parts, "all", ["name"], _ranges(parts))
    crown = build(above.select(F.col("all").alias("part"), "pos", "n", "hash", F.struct("name").alias("held")), tier)
    root = crown[-1].select("part", F.array().cast("array<string>").alias("suffix"), F.element_at(F.element_at("levels", -1), 1).alias("root"))
    roots = push(crown, root, tier).select(F.col("held.name").alias("part"), F.col("steps").alias("suffix"), F.col("hash").alias("subroot"), "root")
    proved = push(tiers, written(roots, "roots"), tier)
    return proved.select("held.id", "part", F.col("hash").alias("leaf"), "held.shown", "subroot", "root", "steps")


def _ranges(rows: DataFrame) -> int:
    return max(1, min(100_000, -(-rows.count() // RANGE_ROWS)))


def verify(proofs: DataFrame) -> DataFrame:
    """manifest()'s rows with proof_sha256, folded_root (from the leaf shown, the own one where there is none) and verified."""
    out = proofs.withColumn("proof_sha256", proof_digest(F.col("steps"))).withColumn("folded_root", fold(F.coalesce("shown", "leaf"), F.col("steps")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
