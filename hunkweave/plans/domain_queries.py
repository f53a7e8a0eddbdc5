"""Queries of the untangling rules themselves, on sources, histories and changes that fixed rules make from the driver's tables.

A rule gives each part a Java file, each customer a history of commits and two versions of a file; what must follow is
then SQL on the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import diff, facts, graph, joins, refactorings, sequence
from ..operators.java_edges import Program
from ..sources.java import parse_files
from ..sources.tables import table, written
from .untangle import untangle

#: A part's class, line by line.  Part k is P<k> of package g<k mod 5>; it extends part s = k - 1 but where k is divisible by 20.
CLASS = """package g{g};
{import_type}
{import_static}
public class P{k} {extends}{{
  int f = {k};
  public void run(int a) {{ }}
  public void run(String a) {{ f = 1; }}
  {name}
  public void go(P{s} other) {{
    if (f > 0) {{ run(1); }} else {{ run("x"); }}
    other.run(f);
    while (f < 9) {{ f = f + 1; }}
    Runnable r = this::stop;
    P{s} held = new P{k}(); held.run("y");
    P{s} late = null; late = new P{k}(); late.run(2);
  }}
  public static void stop() {{ stop(); }}
}}
"""

#: A part's class of chains: Q<k> of package h<k mod 5> leads to Q<s>, whose number is one less but where k is divisible by 20.
CHAINS = """package h{g};
import java.util.*;
{import_next}
public class Q{k} {{ public static class Box<T> {{ T held; T take() {{ return held; }} }}
  public Q{s} next;
  public Box<Q{s}> boxed;
  public Q{s} step() {{ return next; }}
  public int end(int a) {{ return a; }}
  public int end(String a) {{ return 0; }}
  public void all(List<Q{k}> some, Map<String, List<Q{s}>> map) {{
    step().end(1);
    next.next.end("x");
    some.get(0).end(2);
    map.get("a").get(0).step().end(3);
    boxed.take().next.end(4);
    step().step().step().step().step().step().step().step().step().step().end(5);
  }}
}}
"""


def _filled(template: str, **values: Column) -> Column:
    parts, rest = [], template.replace("{{", "\1").replace("}}", "\2")
    plain = lambda s: F.lit(s.replace("\1", "{").replace("\2", "}"))
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [plain(before), values[name]]
    return F.concat(*parts, plain(rest))


def java_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, side, path, content): a file for each part."""
    k = F.col("p_partkey")
    top = (k % 20) == 0
    text = lambda c: c.cast("string")
    s = F.when(top, k).otherwise(k - 1)
    name = F.when((k % 20).isin(0, 15, 16), F.lit('@Override public String name() { return "x"; }')).otherwise(F.lit("// no name"))
    super_ = F.concat(F.lit("g"), text(s % 5), F.lit(".P"), text(s))
    content = _filled(
        CLASS, g=text(k % 5), k=text(k), s=text(s), name=name, extends=F.when(top, F.lit("")).otherwise(F.concat(F.lit("extends P"), text(s), F.lit(" "))),
        import_type=F.when(top, F.lit("// none")).otherwise(F.concat(F.lit("import "), super_, F.lit(";"))), import_static=F.when(top, F.lit("// none")).otherwise(F.concat(F.lit("import static "), super_, F.lit(".stop;"))),
    )
    path = F.concat(F.lit("src/main/java/g"), text(k % 5), F.lit("/P"), text(k), F.lit(".java"))
    return table(spark, sf_dir, "part").select(F.lit(0).cast("long").alias("case_id"), F.lit("R").alias("side"), path.alias("path"), content.alias("content"))


def _part(path: str) -> Column:
    return F.regexp_extract(path, "P([0-9]+)\\.java$", 1).cast("long")


def java_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations of every file as the graph shows them, by line."""
    nodes = parse_files(java_sources(spark, sf_dir)).where("kind IN ('Class', 'Method', 'Variable', 'Import', 'Parameter')")
    a = F.col("attrs")
    label = tx.node_label(F.col("kind"), F.col("name"), F.substring_index(a["owner"], ".", -1), a["sig"], F.array("name"))
    return nodes.select(_part("path").alias("part"), "kind", F.col("b.line").alias("line"), label.alias("label"))


def java_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges between syntax nodes, counted by the lines and kinds that they tie."""
    return _edge_counts(java_sources(spark, sf_dir))


def _edge_counts(files: DataFrame) -> DataFrame:
    program = Program(parse_files(files))
    n = program.nodes.select("case_id", "side", "key", _part("path").alias("part"), "kind", F.col("b.line").alias("line"))
    side = lambda c: n.select("case_id", "side", F.col("key").alias(f"{c}_id"), F.col("part").alias(f"{c}_part"), F.col("kind").alias(f"{c}_kind"), F.col("line").alias(f"{c}_line"))
    edges = program.edges().join(side("src"), ["case_id", "side", "src_id"]).join(side("dst"), ["case_id", "side", "dst_id"])
    return edges.groupBy("etype", "src_part", "src_kind", "src_line", "dst_part", "dst_kind", "dst_line").agg(F.count(F.lit(1)).alias("n"))


def java_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What calls on calls, fields of fields and what is taken out of generic types lead to, counted by lines and kinds."""
    k = F.col("p_partkey")
    text = lambda c: c.cast("string")
    s = F.when((k % 20) == 0, k).otherwise(k - 1)
    next_ = F.when((k % 20) == 0, F.lit("// none")).otherwise(F.concat(F.lit("import h"), text(s % 5), F.lit(".Q"), text(s), F.lit(";")))
    path = F.concat(F.lit("src/main/java/h"), text(k % 5), F.lit("/P"), text(k), F.lit(".java"))
    files = table(spark, sf_dir, "part").select(F.lit(0).cast("long").alias("case_id"), F.lit("R").alias("side"), path.alias("path"), _filled(CHAINS, g=text(k % 5), k=text(k), s=text(s), import_next=next_).alias("content"))
    return _edge_counts(files).where("etype IN ('METHOD_CALL', 'DEF_USE')")


#: Both versions of a customer's class: by its key modulo 4 a method is renamed, code is extracted from one, a method is inlined, or statements change only.
REFACTORED = {
    "L": """package r;
class C{k} {{
  int keep(int a) {{ {kept} return a; }}
  {old}
}}
""",
    "R": """package r;
class C{k} {{
  int keep(int a) {{ {now} return a; }}
  {new}
}}
""",
}


def refactored_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refactorings between two versions of each customer's class; a segment's name and a nation's number stand in its statements."""
    rows = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    text = lambda *x: F.concat(*[y if isinstance(y, Column) else F.lit(y) for y in x])
    body = text('log("', F.col("c_mktsegment"), '"); int n = ', F.col("c_nationkey").cast("string"), "; n = n * a; store(n); audit(n, a);")
    rule = k % 4
    values = {
        "k": k.cast("string"),
        "kept": F.when(rule == 1, text("check(a); ", body)).when(rule == 2, text("check(a); helper(a);")).otherwise(text("check(a);")),
        "now": F.when(rule == 1, text("check(a); helper(a);")).when(rule == 2, text("check(a); ", body)).when(rule == 3, text("check(a + 1);")).otherwise(text("check(a);")),
        "old": F.when(rule == 0, text("void before(int a) { ", body, " }")).when(rule == 2, text("void helper(int a) { ", body, " }")).otherwise(text("// nothing")),
        "new": F.when(rule == 0, text("void after(int a) { ", body, " flush(); }")).when(rule == 1, text("void helper(int a) { ", body, " }")).otherwise(text("// nothing")),
    }
    path = text("src/main/java/r/C", k.cast("string"), ".java")
    files = [rows.select((k % 100).cast("long").alias("case_id"), F.lit(s).alias("side"), path.alias("path"), _filled(REFACTORED[s], **values).alias("content")) for s in "LR"]
    files = written(files[0].union(files[1]), "files")
    found = refactorings.refactorings(refactorings.method_bodies(parse_files(files), files))
    return found.select("case_id", "kind", "old", "new")


#: Both versions of a customer's file; the numbers in braces differ between them where a rule on the customer's key says so.
CHANGED = """package u;
class C {{
  int f() {{ return {a}; }}
  // a
  // b
  // c
  int sum() {{ int total = 10; int more = f(){b}; return total + more; }}
  // d
  // e
  // g
  void last(int n) {{ while (n > {c}) {{
  // h
  // i
  // j
    n = n - {d}; }} }}
  // k
  // l
  // m
  // some words {e}
  // o
  // p
  // quite other things {f}
}}
"""


def changed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rules = {"a": k % 2 == 0, "b": k % 3 == 0, "c": k % 5 < 2, "d": (k % 5).isin(1, 2), "e": k % 7 == 0, "f": k % 7 < 2}
    values = {"a": ("1", "2"), "b": ("", " + 1"), "c": ("0", "5"), "d": ("1", "2"), "e": ("old", "new"), "f": ("before", "after")}
    left = _filled(CHANGED, **{x: F.lit(v[0]) for x, v in values.items()})
    right = _filled(CHANGED, **{x: F.when(rules[x], F.lit(v[1])).otherwise(F.lit(v[0])) for x, v in values.items()})
    rows = table(spark, sf_dir, "customer")
    of = lambda side, c: rows.select(k.alias("case_id"), F.lit(side).alias("side"), F.lit("src/main/java/u/C.java").alias("path"), c.alias("content"))
    return of("L", left).union(of("R", right))


def untangled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of hunks by the whole plan."""
    groups, _, _ = untangle(changed_sources(spark, sf_dir))
    return groups.select("case_id", "group_id", "patch_id", F.col("right.begin").alias("line"))


def untangled_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges, _ = untangle(changed_sources(spark, sf_dir))
    return edges.select("case_id", "src", "dst", "etype").distinct()


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders, one a line, before and after some went and some changed."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("key"), "o_orderstatus")
    was = F.concat(F.lit("k"), F.col("key").cast("string"), F.lit("  "), "o_orderstatus")
    now = F.when(F.col("key") % 7 == 0, F.concat(F.lit("k"), F.col("key").cast("string"), F.lit(" changed"))).otherwise(was)
    text = lambda c, ok: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("key", c.alias("line"))))), lambda r: r["line"]), "\n")
    rows = o.groupBy("case_id").agg(text(was, F.lit(True)).alias("left_content"), text(now, F.col("key") % 5 != 0).alias("right_content"))
    path = F.lit("src/main/java/Orders.java")
    return rows.select("case_id", F.lit("MODIFY").alias("change_type"), path.alias("left_path"), path.alias("right_path"), "left_content", "right_content")


def order_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = diff.line_patches(_files(spark, sf_dir), ["case_id"])
    return p.select("case_id", "patch_id", *[F.col(f"{s}.{e}").cast("long").alias(f"{s}_{e}") for s in ("left", "right") for e in ("begin", "end")])


def order_patches_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same hunks by joins, as files of any size have them."""
    p = diff.line_patches(_files(spark, sf_dir), ["case_id"], small=0)
    return p.select("case_id", "patch_id", *[F.col(f"{s}.{e}").cast("long").alias(f"{s}_{e}") for s in ("left", "right") for e in ("begin", "end")])


def repeated_line_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as blocks of three lines, two of which repeat; some blocks go from every other customer, the first line of some changes with the rest."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("key"), "o_orderstatus")
    block = lambda extra: F.concat(F.lit("order "), F.col("key").cast("string"), extra, F.lit(" {\n  status "), "o_orderstatus", F.lit("\n}"))
    even = F.col("case_id") % 2 == 0
    now = block(F.when(~even & (F.col("key") % 7 == 0), F.lit(" changed")).otherwise(""))
    text = lambda c, ok: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("key", c.alias("line"))))), lambda r: r["line"]), "\n")
    rows = o.groupBy("case_id").agg(text(block(F.lit("")), F.lit(True)).alias("left_content"), text(now, ~even | (F.col("key") % 5 != 0)).alias("right_content"))
    path = F.lit("src/main/java/Orders.java")
    files = rows.select("case_id", F.lit("MODIFY").alias("change_type"), path.alias("left_path"), path.alias("right_path"), "left_content", "right_content")
    p = diff.line_patches(files, ["case_id"], small=0)
    return p.select("case_id", "patch_id", *[F.col(f"{s}.{e}").cast("long").alias(f"{s}_{e}") for s in ("left", "right") for e in ("begin", "end")])


def similar_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation is a case; each of its customers' files moves to another path and changes, and some are there twice after that."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("k"), "o_orderstatus").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("case_id")), "key")
    line = F.concat(F.lit("order "), F.col("k").cast("string"), F.lit(" "), "o_orderstatus")
    now = F.when(F.col("k") % 3 == 0, F.concat(line, F.lit(" changed"))).otherwise(line)
    text = lambda c: F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", c.alias("line")))), lambda r: r["line"]), "\n"), F.lit("\n}"))
    files = o.groupBy("case_id", "key").agg(text(line).alias("L"), text(now).alias("R"))
    name = lambda folder: F.concat(F.lit(folder), F.col("key").cast("string"), F.lit(".java"))
    twice = F.when(F.col("key") % 4 == 0, F.array(name("copy/C"), name("new/C"))).otherwise(F.array(name("new/C")))
    left = files.select("case_id", name("old/C").alias("path"), F.col("L").alias("content"))
    right = files.select("case_id", F.explode(twice).alias("path"), F.col("R").alias("content"))
    left, right = (x.withColumn("blob_id", F.sha1(F.col("content").cast("binary"))) for x in (left, right))
    contents = left.select("blob_id", "content").union(right.select("blob_id", "content")).dropDuplicates(["blob_id"])
    entries = written(diff.tree_diff(left, right, ["case_id"], copies=True), "entries")
    return diff.similar_renames(entries, ["case_id"], contents, copies=True).select("case_id", "change_type", "left_path", "right_path")


def order_word_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = written(_files(spark, sf_dir), "files")
    patches = written(diff.line_patches(files, ["case_id"]), "patches")
    spans = diff.token_spans(diff.regions(patches, files, ["case_id"]), ["case_id"])
    return spans.select("case_id", "side", F.col("b.line").cast("long").alias("line"), F.col("b.col").cast("long").alias("begin"), F.col("e.col").cast("long").alias("end"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer is a repository, its orders are commits and their lines changed files."""
    from pyspark.sql import Window

    name = lambda c: F.concat(F.lit("src/main/java/F"), (F.col(c) % 40).cast("string"), F.lit(".java"))
    file = F.struct(F.when(F.col("l_returnflag") != "A", name("l_partkey")).alias("a_path"), F.when(F.col("l_returnflag") != "R", name("l_suppkey")).alias("b_path"), (F.col("l_quantity").cast("long") % 7).alias("n_hunks"))
    files = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(file).alias("files"))
    o = table(spark, sf_dir, "orders").join(files, "o_orderkey", "left")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    sha = F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    before = F.lag(sha).over(w)
    parents = F.when(before.isNull(), F.array().cast("array<string>")).when(F.col("o_orderstatus") == "P", F.array(before, F.lit("other"))).otherwise(F.array(before))
    keep = lambda c: tx.miner_path(c)
    diffs = F.transform("files", lambda x: F.struct(x["a_path"].alias("a_path"), x["b_path"].alias("b_path"), x["n_hunks"].alias("n_hunks"), (keep(x["a_path"]) & keep(x["b_path"])).alias("valid")))
    return o.select(F.col("o_custkey").cast("string").alias("repo"), F.row_number().over(w).cast("long").alias("seq"), sha.alias("sha"), parents.alias("parents"), diffs.alias("diffs"))


def mined_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.mine_chains(commits(spark, sf_dir)).select("repo", F.col("case_id").cast("long").alias("case_id"), F.array_join("hashes", " ").alias("hashes"))


def mined_chains_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same chains with histories cut into blocks of four commits, as long ones are cut into larger blocks."""
    return sequence.mine_chains(commits(spark, sf_dir), block=4).select("repo", F.col("case_id").cast("long").alias("case_id"), F.array_join("hashes", " ").alias("hashes"))


def continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    c = commits(spark, sf_dir).withColumn("before", F.lag("sha").over(Window.partitionBy("repo").orderBy("seq")))
    return c.select("repo", "seq", F.coalesce(sequence.is_continuation(F.col("parents"), F.col("before")), F.lit(False)).alias("continues"), tx.short_sha(F.col("sha")).alias("short"))


def nodes_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as nodes over some lines, order by order; a supplier's number makes regions."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").cast("long").alias("b_line"), (F.col("l_suppkey") + F.col("l_quantity").cast("long") % 9).alias("e_line"), "l_returnflag", "l_quantity")
    region = rows.where("l_returnflag = 'R'").select("l_orderkey", F.col("b_line").alias("begin"), (F.col("b_line") + 3).alias("end"))
    return joins.inside(rows.where("l_returnflag <> 'R'"), region, ["l_orderkey"], ["l_orderkey", "l_linenumber", "l_partkey", "b_line", "e_line"]).select("l_orderkey", "l_linenumber", "l_partkey")


def group_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.group_report(table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("group_id")), ["o_custkey"])


def connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    pairs = sequence.consecutive_pairs(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey").select("o_custkey", F.col("a").alias("src"), F.col("b").alias("dst"))
    return graph.connected(o.select("o_custkey", F.col("o_orderkey").alias("patch_id"), F.col("o_orderstatus").alias("group_id")), pairs, ["o_custkey"])


def map_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", ["ts", "event_id"])


def map_fact_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user takes over what the user of half its number knows of clicks."""
    e = table(spark, sf_dir, "events")
    known = facts.latest(e, ["user_id", "event_type"], "value", ["ts", "event_id"])
    pairs = e.select("user_id").distinct().select(F.col("user_id").alias("to"), F.floor(F.col("user_id") / 2).alias("user_id"), F.lit("click").alias("event_type"))
    return facts.assign(known, facts.if_known(pairs, known, ["user_id", "event_type"]), ["user_id", "event_type"], "value")


def set_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_returnflag").alias("value"))  # noqa: E741
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_orderstatus").alias("value"))
    return facts.merged(l, o)


def fact_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.rendered(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], F.concat(F.col("o_orderkey").cast("string"), F.lit("="), "o_orderstatus"), F.col("o_orderstatus") != "P")


def phase_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("ms"))
    phases = F.transform(F.array_sort(F.collect_list(F.struct("event_type", "ms"))), lambda r: F.struct(r["event_type"].alias("phase"), r["ms"].alias("ms")))
    return rows.groupBy("user_id").agg(phases.alias("x")).select("user_id", tx.phase_times(F.col("x")).alias("line"))


_P = "p AS (SELECT p_partkey AS k, p_partkey % 20 = 0 AS top, CASE WHEN p_partkey % 20 = 0 THEN p_partkey ELSE p_partkey - 1 END AS s, p_partkey % 20 IN (0, 15, 16) AS named FROM part)"


def _edge(etype: str, src: str, dst: str, where: str = "true", n: int = 1, frm: str = "p", to: str = "k") -> str:
    """src and dst: kind@line."""
    (sk, sl), (dk, dl) = src.split("@"), dst.split("@")
    return f"SELECT '{etype}' AS etype, k AS src_part, '{sk}' AS src_kind, {sl} AS src_line, {to} AS dst_part, '{dk}' AS dst_kind, {dl} AS dst_line, {n}::BIGINT AS n FROM {frm} WHERE {where}"


#: A type with all above it, up to the part whose number is divisible by 20.
_UP = "(SELECT p.k, j AS above, CASE WHEN top THEN k ELSE k - 1 END AS s, top FROM p, range(20) t(i), LATERAL (SELECT k - i AS j) WHERE i <= k % 20)"

_EDGES = [
    _edge("IMPORT", "Import@2", "Class@4", "NOT top", to="s"), _edge("IMPORT", "Import@3", "Method@17", "NOT top", to="s"), _edge("EXTEND", "Class@4", "Class@4", "NOT top", to="s"),
    *[_edge("REFERENCE", f"Type@{line}", "Import@2", "NOT top") for line in (4, 9, 14, 15)], _edge("REFERENCE", "Call@17", "Import@3", "NOT top"), _edge("REFERENCE", "MethodRef@13", "Import@3", "NOT top"),
    _edge("OVERLOAD", "Method@7", "Method@6"), _edge("OVERRIDE", "Method@8", "Method@8", "k % 20 = 15", to="k - 15"), _edge("OVERRIDE", "Method@8", "Method@8", "k % 20 = 16", to="k - 1"),
    _edge("DEF_USE", "Name@7", "Variable@5"), _edge("DEF_USE", "Name@10", "Variable@5"), _edge("DEF_USE", "Name@11", "Variable@5"), _edge("DEF_USE", "Name@11", "Parameter@9"), _edge("DEF_USE", "Name@12", "Variable@5", n=3),
    _edge("DEF_USE", "Name@14", "Variable@14"), _edge("DEF_USE", "Name@15", "Variable@15", n=2), _edge("CONTROL", "Block@10", "Condition@10", n=2), _edge("CONTROL", "Block@12", "Condition@12"),
    _edge("METHOD_CALL", "Call@10", "Method@6"), _edge("METHOD_CALL", "Call@10", "Method@7"), _edge("METHOD_CALL", "Call@17", "Method@17"), _edge("METHOD_CALL", "MethodRef@13", "Method@17"),
    _edge("METHOD_CALL", "Call@11", "Method@6", "top OR above <> k", frm=_UP, to="above"), _edge("METHOD_CALL", "Call@14", "Method@7", frm=_UP, to="above"), _edge("METHOD_CALL", "Call@15", "Method@6", frm=_UP, to="above"),
]

#: s and t: what Q<k> leads to, and what that leads to; u<i>: what i steps lead to.
_Q = "q AS (SELECT p_partkey AS k, greatest(p_partkey - 1, p_partkey - p_partkey % 20) AS s, greatest(p_partkey - 2, p_partkey - p_partkey % 20) AS t FROM part)"
_CHAIN = [
    _edge("DEF_USE", "Name@4", "Variable@4", frm="q"), _edge("DEF_USE", "Name@7", "Variable@5", frm="q"), _edge("DEF_USE", "Name@8", "Parameter@8", frm="q"), _edge("DEF_USE", "Name@12", "Variable@5", frm="q"), _edge("DEF_USE", "Access@12", "Variable@5", frm="q", to="s"),
    _edge("DEF_USE", "Name@13", "Parameter@10", frm="q"), _edge("DEF_USE", "Name@14", "Parameter@10", frm="q"), _edge("DEF_USE", "Name@15", "Variable@6", frm="q"), _edge("DEF_USE", "Access@15", "Variable@5", frm="q", to="s"),
    _edge("METHOD_CALL", "Call@11", "Method@7", frm="q"), _edge("METHOD_CALL", "Call@11", "Method@8", frm="q", to="s"), _edge("METHOD_CALL", "Call@12", "Method@9", frm="q", to="t"), _edge("METHOD_CALL", "Call@13", "Method@8", frm="q"),
    _edge("METHOD_CALL", "Call@14", "Method@7", frm="q", to="s"), _edge("METHOD_CALL", "Call@14", "Method@8", frm="q", to="t"), _edge("METHOD_CALL", "Call@15", "Method@4", frm="q"), _edge("METHOD_CALL", "Call@15", "Method@8", frm="q", to="t"),
    *[_edge("METHOD_CALL", "Call@16", "Method@7" if i < 10 else "Method@8", frm="q", to=f"greatest(k - {i}, k - k % 20)") for i in range(11)],
]


def _label(kind: str, line: int, label: str, where: str = "true") -> str:
    return f"SELECT k AS part, '{kind}' AS kind, {line} AS line, {label} AS label FROM p WHERE {where}"


_LABELS = [
    _label("Import", 2, "'g' || s % 5 || '.P' || s", "NOT top"), _label("Import", 3, "'g' || s % 5 || '.P' || s || '.stop'", "NOT top"), _label("Class", 4, "'Class<P' || k || '>'"), _label("Variable", 5, "'Var<f>'"),
    _label("Method", 6, "'Method<P' || k || ': run(int)>'"), _label("Method", 7, "'Method<P' || k || ': run(String)>'"), _label("Method", 8, "'Method<P' || k || ': name()>'", "named"), _label("Method", 9, "'Method<P' || k || ': go(P' || s || ')>'"),
    _label("Method", 17, "'Method<P' || k || ': stop()>'"), _label("Parameter", 6, "'a'"), _label("Parameter", 7, "'a'"), _label("Parameter", 9, "'other'"), _label("Variable", 13, "'Var<r>'"), _label("Variable", 14, "'Var<held>'"), _label("Variable", 15, "'Var<late>'"),
]

_H = """h AS (SELECT c_custkey AS case_id, line, flag FROM customer, LATERAL (SELECT unnest([3, 7, 11, 15, 19, 22]) AS line,
            unnest([c_custkey % 2 = 0, c_custkey % 3 = 0, c_custkey % 5 < 2, c_custkey % 5 IN (1, 2), c_custkey % 7 = 0, c_custkey % 7 < 2]) AS flag)),
        n AS (SELECT case_id, line, row_number() OVER (PARTITION BY case_id ORDER BY line) - 1 AS patch_id FROM h WHERE flag),
        t AS (SELECT b.case_id, b.patch_id AS src, a.patch_id AS dst, CASE WHEN b.line = 22 THEN 'TRIVIAL' ELSE 'DEPEND' END AS etype FROM n a JOIN n b ON a.case_id = b.case_id AND (a.line, b.line) IN ((3, 7), (11, 15), (19, 22)))"""
_O = """o AS (SELECT o_custkey AS case_id, o_orderkey AS k, length('k' || o_orderkey) AS w, length(o_orderstatus) AS v, o_orderkey % 5 = 0 AS gone, o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0 AS changed FROM orders),
        x AS (SELECT *, row_number() OVER c AS l, count(*) FILTER (NOT gone) OVER (c ROWS UNBOUNDED PRECEDING) AS r, count(*) FILTER (NOT gone AND NOT changed) OVER (c ROWS UNBOUNDED PRECEDING) AS gap FROM o WINDOW c AS (PARTITION BY case_id ORDER BY k))"""

SQL = {
    "java_nodes": f"WITH {_P} " + " UNION ALL ".join(_LABELS),
    "java_edges": f"WITH {_P} SELECT etype, src_part, src_kind, src_line, dst_part, dst_kind, dst_line, sum(n)::BIGINT AS n FROM (" + " UNION ALL ".join(_EDGES) + ") GROUP BY ALL",
    "java_chains": f"WITH {_Q} SELECT etype, src_part, src_kind, src_line, dst_part, dst_kind, dst_line, sum(n)::BIGINT AS n FROM (" + " UNION ALL ".join(_CHAIN) + ") GROUP BY ALL",
    "refactored_methods": """SELECT c_custkey % 100 AS case_id, ['MOVE', 'EXTRACT', 'INLINE'][c_custkey % 4 + 1] AS kind,
            'r.C' || c_custkey || ['#before(int)', '#keep(int)', '#helper(int)'][c_custkey % 4 + 1] AS old, 'r.C' || c_custkey || ['#after(int)', '#helper(int)', '#keep(int)'][c_custkey % 4 + 1] AS new FROM customer WHERE c_custkey % 4 < 3""",
    "untangled": f"WITH {_H} SELECT n.case_id, coalesce(dst, patch_id) AS group_id, patch_id, line FROM n LEFT JOIN t ON n.case_id = t.case_id AND patch_id = src",
    "untangled_edges": f"WITH {_H} SELECT * FROM t",
    "order_patches": f"""WITH {_O}, e AS (SELECT case_id, gap, min(l) AS lb, max(l) AS le, min(r) FILTER (changed) AS rb, max(r) FILTER (changed) AS re, min(r) AS r0 FROM x WHERE gone OR changed GROUP BY ALL)
        SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY gap) - 1 AS patch_id, lb AS left_begin, le AS left_end, coalesce(rb, r0 + 1) AS right_begin, coalesce(re, r0) AS right_end FROM e""",
    "order_patches_joined": f"""WITH {_O}, e AS (SELECT case_id, gap, min(l) AS lb, max(l) AS le, min(r) FILTER (changed) AS rb, max(r) FILTER (changed) AS re, min(r) AS r0 FROM x WHERE gone OR changed GROUP BY ALL)
        SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY gap) - 1 AS patch_id, lb AS left_begin, le AS left_end, coalesce(rb, r0 + 1) AS right_begin, coalesce(re, r0) AS right_end FROM e""",
    "repeated_line_patches": """WITH o AS (SELECT o_custkey AS case_id, o_orderkey AS k, o_custkey % 2 = 0 AND o_orderkey % 5 = 0 AS gone, o_custkey % 2 = 1 AND o_orderkey % 7 = 0 AS changed FROM orders),
        x AS (SELECT *, row_number() OVER c AS l, count(*) FILTER (NOT gone) OVER (c ROWS UNBOUNDED PRECEDING) AS r FROM o WINDOW c AS (PARTITION BY case_id ORDER BY k)),
        e AS (SELECT case_id, 3 * min(l) - 2 AS lb, 3 * max(l) AS le, 3 * r + 1 AS rb, 3 * r AS re FROM x WHERE gone GROUP BY case_id, r UNION ALL SELECT case_id, 3 * l - 2, 3 * l - 2, 3 * l - 2, 3 * l - 2 FROM x WHERE changed)
        SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY lb) - 1 AS patch_id, lb AS left_begin, le AS left_end, rb AS right_begin, re AS right_end FROM e""",
    "similar_renames": """WITH f AS (SELECT c_nationkey AS case_id, c_custkey AS k, count(*) AS n, count(*) FILTER (o_orderkey % 3 <> 0) AS kept FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
        m AS (SELECT *, 10 * (kept + 1) >= 6 * (n + 1) AS alike, k % 4 = 0 AS twice FROM f)
        SELECT case_id, CASE WHEN alike THEN 'RENAME' ELSE 'ADD' END AS change_type, CASE WHEN alike THEN 'old/C' || k || '.java' END AS left_path, CASE WHEN twice THEN 'copy/C' ELSE 'new/C' END || k || '.java' AS right_path FROM m
        UNION ALL SELECT case_id, CASE WHEN alike THEN 'COPY' ELSE 'ADD' END, CASE WHEN alike THEN 'old/C' || k || '.java' END, 'new/C' || k || '.java' FROM m WHERE twice
        UNION ALL SELECT case_id, 'DELETE', 'old/C' || k || '.java', NULL FROM m WHERE NOT alike""",
    "order_word_spans": f"""WITH {_O} SELECT case_id, 'L' AS side, l AS line, CASE WHEN gone THEN 1 ELSE w + 3 END AS "begin", w + 2 + v AS "end" FROM x WHERE gone OR changed
        UNION ALL SELECT case_id, 'R', r, w + 2, w + 8 FROM x WHERE changed""",
    "mined_chains": """WITH RECURSIVE f AS (SELECT l_orderkey AS k, count(*) AS n, max(l_quantity::BIGINT % 7) AS h,
              coalesce(list(DISTINCT 'F' || l_partkey % 40) FILTER (l_returnflag <> 'A'), []) AS a, coalesce(list(DISTINCT 'F' || l_suppkey % 40) FILTER (l_returnflag <> 'R'), []) AS b FROM lineitem GROUP BY l_orderkey),
        c AS (SELECT o_custkey AS repo, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, substr(md5(o_orderkey::VARCHAR), 1, 10) AS sha, o_orderstatus <> 'P' AS one,
                coalesce(n, 0) AS n, coalesce(h, 0) AS h, coalesce(a, []) AS a, coalesce(b, []) AS b FROM orders LEFT JOIN f ON o_orderkey = k),
        g AS (SELECT repo, seq, sha, 1 AS len, []::VARCHAR[] AS old, []::VARCHAR[] AS new, 0 AS segment FROM c WHERE seq = 1
              UNION ALL SELECT repo, seq, sha, CASE WHEN ok THEN len + 1 ELSE 1 END, CASE WHEN ok THEN list_concat(old, a) ELSE [] END, CASE WHEN ok THEN list_concat(new, b) ELSE [] END, CASE WHEN ok THEN segment ELSE segment + 1 END
              FROM (SELECT c.*, g.len, g.old, g.new, g.segment, g.len <= 5 AND c.one AND c.n BETWEEN 1 AND 3 AND c.h <= 5 AND NOT list_has_any(c.a, g.new) AND NOT list_has_any(c.b, g.old) AS ok FROM g JOIN c ON c.repo = g.repo AND c.seq = g.seq + 1)),
        s AS (SELECT repo, segment, string_agg(sha, ' ' ORDER BY seq) AS hashes FROM g GROUP BY ALL HAVING count(*) > 2)
        SELECT repo::VARCHAR AS repo, row_number() OVER (PARTITION BY repo ORDER BY segment) - 1 AS case_id, hashes FROM s""",
    "mined_chains_in_blocks": """WITH RECURSIVE f AS (SELECT l_orderkey AS k, count(*) AS n, max(l_quantity::BIGINT % 7) AS h,
              coalesce(list(DISTINCT 'F' || l_partkey % 40) FILTER (l_returnflag <> 'A'), []) AS a, coalesce(list(DISTINCT 'F' || l_suppkey % 40) FILTER (l_returnflag <> 'R'), []) AS b FROM lineitem GROUP BY l_orderkey),
        c AS (SELECT o_custkey AS repo, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, substr(md5(o_orderkey::VARCHAR), 1, 10) AS sha, o_orderstatus <> 'P' AS one,
                coalesce(n, 0) AS n, coalesce(h, 0) AS h, coalesce(a, []) AS a, coalesce(b, []) AS b FROM orders LEFT JOIN f ON o_orderkey = k),
        g AS (SELECT repo, seq, sha, 1 AS len, []::VARCHAR[] AS old, []::VARCHAR[] AS new, 0 AS segment FROM c WHERE seq = 1
              UNION ALL SELECT repo, seq, sha, CASE WHEN ok THEN len + 1 ELSE 1 END, CASE WHEN ok THEN list_concat(old, a) ELSE [] END, CASE WHEN ok THEN list_concat(new, b) ELSE [] END, CASE WHEN ok THEN segment ELSE segment + 1 END
              FROM (SELECT c.*, g.len, g.old, g.new, g.segment, g.len <= 5 AND c.one AND c.n BETWEEN 1 AND 3 AND c.h <= 5 AND NOT list_has_any(c.a, g.new) AND NOT list_has_any(c.b, g.old) AS ok FROM g JOIN c ON c.repo = g.repo AND c.seq = g.seq + 1)),
        s AS (SELECT repo, segment, string_agg(sha, ' ' ORDER BY seq) AS hashes FROM g GROUP BY ALL HAVING count(*) > 2)
        SELECT repo::VARCHAR AS repo, row_number() OVER (PARTITION BY repo ORDER BY segment) - 1 AS case_id, hashes FROM s""",
    "continuations": "SELECT o_custkey::VARCHAR AS repo, row_number() OVER w AS seq, o_orderstatus <> 'P' AND row_number() OVER w > 1 AS continues, substr(md5(o_orderkey::VARCHAR), 1, 10) AS short FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "nodes_inside": "WITH n AS (SELECT *, l_suppkey + l_quantity::BIGINT % 9 AS e FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey FROM n WHERE l_returnflag <> 'R' AND EXISTS (SELECT 1 FROM n r WHERE r.l_orderkey = n.l_orderkey AND r.l_returnflag = 'R' AND n.l_suppkey <= r.l_suppkey + 3 AND n.e >= r.l_suppkey)",
    "group_report": "SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_groups, count(*) AS n_members, max(n) AS largest FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS n FROM orders) GROUP BY o_custkey",
    "connectivity": "SELECT * FROM (SELECT o_custkey, o_orderkey AS src, lead(o_orderkey) OVER w AS dst, o_orderstatus = lead(o_orderstatus) OVER w AS connected FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE dst IS NOT NULL",
    "map_fact": "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "map_fact_assign": "WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type = 'click'), u AS (SELECT DISTINCT user_id FROM events) SELECT u.user_id AS \"to\", value FROM u JOIN f ON f.user_id = u.user_id // 2",
    "set_fact": "SELECT l_orderkey AS node, l_returnflag AS value FROM lineitem UNION SELECT o_orderkey, o_orderstatus FROM orders",
    "fact_render": "SELECT o_custkey, '[' || string_agg(o_orderkey || '=' || o_orderstatus, ', ' ORDER BY o_orderdate, o_orderkey) || ']' AS line FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey",
    "phase_times": "SELECT user_id, '[' || string_agg('Phase ' || event_type || ' cost ' || n || 'ms', ', ' ORDER BY event_type) || ']' AS line FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: globals()[k] for k in SQL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
