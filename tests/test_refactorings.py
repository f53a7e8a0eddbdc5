from __future__ import annotations

from hunkweave.operators import refactorings
from hunkweave.plans.untangle import untangle
from hunkweave.sources.java import parse_files

OLD = """package p;
class A {
  void moved(int a) {
    open(a);
    if (a > 3) { read(a); }
    close(a);
  }




  int big(int a) {
    int n = a * 7;
    n = n + shift(a);
    store(n);
    return n;
  }




  void small(int a) {
    log("one");
    log("two");
  }




  void user(int a) {
    begin(a);
    small(a);
  }




  void getter() { x(); }
}
"""
NEW = """package p;
class A {
  void renamed(int a) {
    open(a);
    if (a > 3) { read(a); }
    close(a); // the same
  }




  int big(int a) {
    int n = part(a);
    return n;
  }
  int part(int a) {
    int n = a * 7;
    n = n + shift(a);
    store(n);
    return n;
  }




  void user(int a) {
    begin(a);
    log("one");
    log("two");
  }




  void other() { x(); }
}
"""
FILES = "case_id long, side string, path string, content string"


def test_moves_extractions_and_inlined_methods(spark):
    files = spark.createDataFrame([(1, "L", "src/main/java/p/A.java", OLD), (1, "R", "src/main/java/p/A.java", NEW), (2, "R", "src/main/java/p/A.java", NEW)], FILES)
    bodies = refactorings.method_bodies(parse_files(files), files)
    got = {tuple(r) for r in refactorings.refactorings(bodies).select("case_id", "kind", "old", "new").collect()}
    # A method of one statement, as the last, says too little to be told by it.
    assert got == {(1, "MOVE", "p.A#moved(int)", "p.A#renamed(int)"), (1, "EXTRACT", "p.A#big(int)", "p.A#part(int)"), (1, "INLINE", "p.A#small(int)", "p.A#user(int)")}
    assert refactorings.refactorings(bodies.limit(0)).count() == 0


def test_a_refactoring_ties_its_hunks(spark):
    files = spark.createDataFrame([(1, "L", "src/main/java/p/A.java", OLD), (1, "R", "src/main/java/p/A.java", NEW)], FILES)
    groups, edges, failed = untangle(files)
    assert failed.count() == 0
    lines = {r.patch_id: (r.left.begin, r.right.begin) for r in groups.collect()}
    tied = {frozenset((lines[r.src], lines[r.dst])) for r in edges.where("etype = 'REFACTOR'").collect()}
    small = next(v for v in lines.values() if v[0] == 22)
    user = next(v for v in lines.values() if v[0] == 32)
    assert frozenset((small, user)) in tied
    assert len({r.group_id for r in groups.collect() if lines[r.patch_id] in (small, user)}) == 1
