"""Column functions on paths, lines and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the analysed language and its tools prescribe.
SOURCE_SUFFIX = ".java"
SOURCE_ROOTS = ("src/main/java", "src/test/java")
CJK = "[\\u4E00-\\u9FFF]"
PLATFORM_PACKAGES = ("java", "javax", "javafx", "jdk", "sun")
LINE_BREAK = "\\r?\\n"


def is_source_file(path: Column) -> Column:
    return path.endswith(SOURCE_SUFFIX)


def is_valid_path(path: Column) -> Column:
    """No CJK character and below a source root."""
    below = path.contains(SOURCE_ROOTS[0]) | path.contains(SOURCE_ROOTS[1])
    return ~path.rlike(CJK) & below


def miner_path(path: Column) -> Column:
    """A missing side passes; any other must be a source file with a valid path."""
    return F.coalesce(is_source_file(path) & is_valid_path(path), F.lit(True))


def is_platform_import(name: Column) -> Column:
    return name.rlike(f"^({'|'.join(PLATFORM_PACKAGES)})\\.")


def lines_of(text: Column) -> Column:
    """Lines by \\n or \\r\\n, trailing empty ones kept."""
    return F.split(text, LINE_BREAK, -1)


def stripped(line: Column) -> Column:
    """Without the white space at both ends, tabs and such included."""
    return F.regexp_replace(line, "^\\s+|\\s+$", "")


def strip_lines(lines: Column) -> Column:
    return F.transform(lines, stripped)


def is_comment(lines: Column) -> Column:
    """Every line is empty or begins with a comment sign; no lines: true."""
    return F.forall(lines, lambda line: (line == "") | line.startswith("//") | line.startswith("/*") | line.startswith("*"))


def remove_tail(s: Column, n: int) -> Column:
    return F.substring(s, F.lit(1), F.greatest(F.length(s) - n, F.lit(0)))


def before_char(s: Column, ch: str) -> Column:
    """What stands before the first ``ch``; all if there is none."""
    return F.substring_index(s, ch, 1)


def region_code(content: Column, begin: Column, end: Column) -> Column:
    """Lines begin..end, 1-based; none if end < begin."""
    return F.slice(lines_of(content), begin, F.greatest(end - begin + 1, F.lit(0)))


def source_root(path: Column) -> Column:
    """The first source root a path lies in, or null."""
    found = F.regexp_extract(path, "^(.*?src/(?:main|test)/java)/", 1)
    return F.when((found != "") & is_valid_path(path), found)


def unix_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def short_sha(sha: Column) -> Column:
    return F.substring(sha, 1, 10)


def hunk_count(patch: Column) -> Column:
    """How many lines of a patch begin a hunk."""
    return F.size(F.filter(F.split(patch, "\n"), lambda line: line.startswith("@@")))


def node_label(kind: Column, name: Column, owner: Column, sig: Column, names: Column) -> Column:
    """How a declaration is shown: Method<Owner: sig>, Class<n>, Interface<n>, Enum<n>, EnumEntry<n>, Field<[a, b]>, Var<n>, Type<n>; else its name."""
    shown = F.when(kind.isin("Method", "Constructor"), F.format_string("Method<%s: %s>", F.coalesce(owner, F.lit("")), sig))
    for own in ("Class", "Interface", "Enum", "EnumEntry", "Type"):
        shown = shown.when(kind == own, F.format_string(f"{own}<%s>", name))
    return shown.when(kind == "Field", F.format_string("Field<[%s]>", F.array_join(names, ", "))).when(kind == "Variable", F.format_string("Var<%s>", name)).otherwise(name)


def phase_times(phases: Column) -> Column:
    """Phases, structs (phase, ms) in their order, as "[Phase p cost 1ms, ...]"."""
    return F.concat(F.lit("["), F.array_join(F.transform(phases, lambda r: F.format_string("Phase %s cost %dms", r["phase"], r["ms"])), ", "), F.lit("]"))


def intervals_meet(a_begin: Column, a_end: Column, b_begin: Column, b_end: Column) -> Column:
    """Closed intervals, of lines or of (line, column) structs, overlap."""
    return (a_end >= b_begin) & (a_begin <= b_end)
