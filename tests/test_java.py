from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hunkweave.operators.java_edges import Program
from hunkweave.plans.untangle import untangle
from hunkweave.sources.java import JavaError, parse, parse_files

SHAPES = """package zoo.shapes;
public enum Shapes {
  ROUND { @Override public int sides() { return 0; } }, SQUARE;
  public static int known = 2;
  public static void all() { }
  public int sides() { return 4; }
}
"""
TOOLS = """package zoo.tools;
public class Tools {
  public static class Hammer { }
  public class Saw { }
  protected static void hidden() { }
  public static int cut(int n) { return n; }
}
"""
FARM = """package zoo;

import zoo.shapes.Shapes;
import zoo.tools.Tools;
import zoo.tools.Tools.*;
import static zoo.shapes.Shapes.*;
import static zoo.tools.Tools.cut;
import java.util.List;

interface Noisy { default void noise(int n) { } }
class Animal implements Noisy { void eat() { } public String toString() { return ""; } }
class Cow extends Animal {
  int milk = 0;
  @Override public String toString() { return "cow"; }
  @Override public void noise(int n) { }
  void eat(int much) { if (much > milk) { milk = much; } else { eat(); } }
  void eat() { for (int i = 0; i < milk; i++) { cut(i); } Saw saw = null; Tools t = new Tools(); List<Integer> l; }
}
"""


def edges(spark, files):
    rows = [(1, "L", p, c) for p, c in files.items()]
    program = Program(parse_files(spark.createDataFrame(rows, "case_id long, side string, path string, content string")))
    names = {r.key: f"{(r.attrs or {}).get('owner', '').split('.')[-1]}.{r['name']}:{r.kind}@{r.b.line}" for r in program.nodes.collect()}
    return {(r.etype, names[r.src_id], names[r.dst_id]) for r in program.edges().collect()}


@pytest.fixture(scope="module")
def found(spark):
    return edges(spark, {"a/src/main/java/zoo/shapes/Shapes.java": SHAPES, "a/src/main/java/zoo/tools/Tools.java": TOOLS, "a/src/main/java/zoo/Farm.java": FARM})


def of(found, kind):
    return {(a, b) for k, a, b in found if k == kind}


def test_inheritance(found):
    assert of(found, "EXTEND") == {(".Cow:Class@12", ".Animal:Class@11")}
    assert of(found, "IMPLEMENT") == {(".Animal:Class@11", ".Noisy:Interface@10")}


def test_imports(found):
    got = {(a.split("@")[1], b.split(":")[0]) for a, b in of(found, "IMPORT")}
    assert got == {("3", ".Shapes"), ("4", ".Tools"), ("5", ".Hammer"), ("5", ".Saw"), ("6", "Shapes.ROUND"), ("6", "Shapes.SQUARE"), ("6", "Shapes.known"), ("6", "Shapes.all"), ("7", "Tools.cut")}


def test_overrides_are_the_nearest(found):
    got = {(a.split("@")[0], b.split("@")[0]) for a, b in of(found, "OVERRIDE")}
    assert got == {("Cow.toString:Method", "Animal.toString:Method"), ("Cow.noise:Method", "Noisy.noise:Method"), ("ROUND.sides:Method", "Shapes.sides:Method")}


def test_overloads_calls_definitions_and_control(found):
    assert of(found, "OVERLOAD") == {("Cow.eat:Method@17", "Cow.eat:Method@16")}
    calls = {(a.split(":")[0].split(".")[-1], a.split("@")[1], b) for a, b in of(found, "METHOD_CALL")}
    assert ("eat", "16", "Cow.eat:Method@17") in calls
    assert {b for a, b in of(found, "DEF_USE") if ".milk:" in a} == {"Cow.milk:Variable@13"}
    assert len(of(found, "CONTROL")) == 2  # the two branches stand in one line
    assert {(a.split(":")[0], b.split("@")[1]) for a, b in of(found, "REFERENCE")} >= {(".Saw", "5"), (".Tools", "4"), ("Cow.cut", "7"), (".List", "8")}


def test_calls_follow_argument_types_and_what_names_hold(spark):
    code = """package p;
class Base { void k(int a) { } void k(String a) { } void only() { } }
class Sub extends Base { void k(int a) { } private void k(long a) { } }
class Other { void only() { } void k(Base b) { } }
class Use {
  Base[] all = { new Sub() };
  void m(int n) {
    k("x");
    Base b = new Sub();
    b.k(1);
    b.k("y");
    Object o = null;
    o = new Other();
    o.only();
    all[0].k(2);
    all[1] = new Base();
    all[0].k(3);
    new Thread(this::m);
  }
  void k(int a) { }
  void k(String a) { }
}
"""
    found = edges(spark, {"src/main/java/p/Use.java": code})
    got = {(a.split("@")[1], b.split(":")[0] + "@" + b.split("@")[1]) for a, b in of(found, "METHOD_CALL")}
    assert got == {("8", "Use.k@21"), ("10", "Sub.k@3"), ("10", "Base.k@2"), ("11", "Base.k@2"), ("14", "Other.only@4"), ("15", "Sub.k@3"), ("15", "Base.k@2"), ("17", "Sub.k@3"), ("17", "Base.k@2"), ("18", "Use.m@7")}


def test_overrides_are_found_at_any_height(spark):
    code = "package p;\n" + "\n".join(f"class C{i} {f'extends C{i - 1} ' if i else ''}{{ {'@Override public String name() { return null; }' if i in (0, 30) else ''} }}" for i in range(31)) + "\nclass A extends B { }\nclass B extends A { }\n"
    assert of(edges(spark, {"src/main/java/p/C.java": code}), "OVERRIDE") == {("C30.name:Method@32", "C0.name:Method@2")}


def test_unreadable_files_are_told(spark):
    with pytest.raises(JavaError):
        parse("class A { int x = ; ")
    assert parse("") == []
    rows = parse_files(spark.createDataFrame([(1, "L", "A.java", "class {"), (1, "L", "B.java", "class B { }"), (2, "L", "C.java", None)], "case_id long, side string, path string, content string"))
    assert {(r.path, r.kind) for r in rows.select("path", "kind").collect()} >= {("A.java", "Failed"), ("B.java", "Class")}


def test_untangle(spark):
    p = "src/main/java/p/"
    old = "package p;\nclass A {\n  int f() { return 1; }\n\n\n\n\n  int g() { return 2; }\n\n\n\n\n  // old words\n}\n"
    new = "package p;\nclass A {\n  int f() { return h(); }\n\n\n\n\n  int h() { return 2; }\n\n\n\n\n  // new words here\n}\n"
    rows = [(1, "L", p + "A.java", old), (1, "R", p + "A.java", new), (2, "L", p + "B.java", "class B { }"), (2, "R", p + "B.java", "class {"), (3, "R", p + "C.java", "package p;\nclass C { }\n")]
    groups, found, failed = untangle(spark.createDataFrame(rows, "case_id long, side string, path string, content string"))
    got = {(r.case_id, r.group_id, r.patch_id) for r in groups.select("case_id", "group_id", "patch_id").collect()}
    assert got == {(1, 0, 0), (1, 0, 1), (1, 2, 2), (3, 0, 0)}
    assert (1, 0, 1, "DEPEND") in {tuple(r) for r in found.where("case_id = 1").select("case_id", "src", "dst", "etype").collect()}
    assert [r.case_id for r in failed.collect()] == [2]
    assert groups.where(F.col("case_id") == 3).first().left is None


def test_hunks_of_a_condition_and_its_braced_body_are_tied(spark):
    text = "package p;\nclass A {\n  void f(int n) { while (n > %d) {\n\n\n\n\n  n = n - %d; } }\n}\n"
    rows = [(1, s, "src/main/java/p/A.java", text % v) for s, v in (("L", (0, 1)), ("R", (5, 2)))]
    groups, found, _ = untangle(spark.createDataFrame(rows, "case_id long, side string, path string, content string"))
    assert [(r.src, r.dst, r.etype) for r in found.distinct().collect()] == [(1, 0, "DEPEND")]
    assert {r.group_id for r in groups.collect()} == {0} and groups.count() == 2


def calls(found):
    return {(a.split(":")[0].split(".")[-1] + "@" + a.split("@")[1], b.split(":")[0] + "@" + b.split("@")[1]) for a, b in of(found, "METHOD_CALL")}


def test_receivers_of_any_kind_have_types(spark):
    code = """package p;
class A { B v; B b() { return new B(); } static A make() { return null; } }
class B extends Top { A a; A back() { return a; } void go(int n) { } void go(String s) { } }
class Top { int depth; Top up() { return this; } }
class Use {
  A own;
  A a() { return own; }
  void m(A a, boolean c) {
    a.b().go(1);
    a().b().back().b().back().v.go("x");
    a.v.a.v.go(a.v.depth);
    this.own.b().go(2);
    (c ? a.b() : a.v).go("y" + c);
    ((B) a.v.up()).go(3);
    A.make().b().up();
    B x = a.b(); x.go(4);
    x = a.v.back().v; x.go("z");
    unknown().b().go(5);
    new B() { }.go(6);
    later.b().go(7);
  }
  A later;
}
"""
    found = edges(spark, {"src/main/java/p/Use.java": code})
    got = calls(found)
    assert {x for x in got if x[0].startswith("go@")} == {("go@9", "B.go@3"), ("go@10", "B.go@3"), ("go@11", "B.go@3"), ("go@12", "B.go@3"), ("go@13", "B.go@3"), ("go@14", "B.go@3"), ("go@16", "B.go@3"), ("go@17", "B.go@3"), ("go@19", "B.go@3"), ("go@20", "B.go@3")}
    assert {x for x in got if x[0].startswith(("up@", "make@", "back@"))} == {("up@14", "Top.up@4"), ("up@15", "Top.up@4"), ("make@15", "A.make@2"), ("back@10", "B.back@3"), ("back@17", "B.back@3")}
    reads = {(a.split("Access@")[1], b.split(":")[0]) for a, b in of(found, "DEF_USE") if "Access" in a}
    assert reads == {("10", "A.v"), ("11", "A.v"), ("11", "B.a"), ("11", "Top.depth"), ("13", "A.v"), ("14", "A.v"), ("17", "A.v")}


def test_chains_of_ten_and_longer(spark):
    n = 24
    code = "package p;\n" + "\n".join(f"class C{i} {{ C{i + 1} next() {{ return null; }} C{i + 1} f; }}" for i in range(n)) + f"\nclass C{n} {{ void end() {{ }} }}\nclass U {{ void m(C0 c) {{\n c{'.next()' * n}.end();\n c{'.f' * n}.end();\n }} }}\n"
    got = calls(edges(spark, {"src/main/java/p/C.java": code}))
    assert got == {(f"next@{n + 4}", f"C{i}.next@{i + 2}") for i in range(n)} | {(f"end@{n + 4}", f"C{n}.end@{n + 2}"), (f"end@{n + 5}", f"C{n}.end@{n + 2}")}


def test_type_arguments_are_put_in_place(spark):
    code = """package p;
import java.util.*;
class B { void go() { } int n; }
class Box<T extends B & Comparable<T>> { T held; T take() { return held; } Box<T> same() { return this; } void use() { held.go(); take().go(); } }
class Pair<X, Y> { X first; Map<X, List<Y>> both() { return null; } }
class Named<Z> extends Pair<String, Z> { }
class Rows extends ArrayList<B> { void all() { get(0).go(); } }
class Sub extends B { void go() { } }
class Use {
  List<B> all;
  <Q extends B> void m(Box<Sub> box, Named<B> named, Map<String, List<B>> map, Box raw, Rows rows, Q q) {
    all.get(0).go();
    box.take().go();
    box.same().same().held.go();
    named.both().get("x").get(0).go();
    for (Iterator<B> i = all.iterator(); i.hasNext(); ) { i.next().go(); }
    List<B> made = new ArrayList<>(); made.get(0).go();
    raw.take().go();
    rows.get(1).go();
    q.go();
    map.entrySet().iterator().next().getValue().get(0).go();
    int k = all.get(1).n;
    List<? extends B> wild = all; wild.stream().filter(x -> true).findFirst().get().go();
  }
}
"""
    found = edges(spark, {"src/main/java/p/Use.java": code})
    to_b = {(f"go@{n}", "B.go@3") for n in (4, 7, 12, 15, 16, 17, 18, 19, 20, 21, 23)}
    # A call on Sub goes to its own method and to the one above.
    assert {x for x in calls(found) if x[0].startswith("go@")} == to_b | {(f"go@{n}", b) for n in (13, 14) for b in ("B.go@3", "Sub.go@8")}
    assert {b for a, b in of(found, "DEF_USE") if "Access@22" in a} == {"B.n:Variable@3"}


def test_a_broken_member_costs_itself_only(spark):
    p = "src/main/java/p/A.java"
    text = "package p;\nclass A {\n  int f() { return %d; }\n\n\n\n\n  void broken( { int x = ; }\n\n\n\n\n  int g() { return f()+%d; }\n}\n"
    rows = [(1, s, p, text % v) for s, v in (("L", (1, 1)), ("R", (2, 2)))]
    nodes = parse_files(spark.createDataFrame(rows, "case_id long, side string, path string, content string"))
    assert [(r.side, r.kind, r.line) for r in nodes.where("error IS NOT NULL").select("side", "kind", F.col("b.line").alias("line")).orderBy("side").collect()] == [("L", "Unread", 8), ("R", "Unread", 8)]
    groups, found, failed = untangle(spark.createDataFrame(rows, "case_id long, side string, path string, content string"))
    assert [(r.src, r.dst, r.etype) for r in found.distinct().collect()] == [(1, 0, "DEPEND")]
    assert failed.count() == 0 and groups.count() == 2
