"""Source sites, class names and lock names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the class file's access flags.
STATIC, PRIVATE, ABSTRACT, FINAL, VOLATILE = 0x8, 0x2, 0x400, 0x10, 0x40

# Longest lock path, and the marks of unnameable locks and unresolved sites.
LONGEST_PATH, OPAQUE, UNRESOLVED = 10, "?@", "N/A"
# Dumps and answers show locks by these texts, and results of earlier runs are compared by them. What
# stands before and after a value of each kind; where a value is first seen; a formal by its number; a cut path.
AFFIXES = {"this": ("this", ""), "param": ("$p", ""), "class": ("", ".class"), "alloc": ("new@", ""), "opaque": (OPAQUE, "")}
PLACE, OF_FORMAL, CUT = "{key}+{offset:04x}", "#p", "trunc:"


def site(text: Column) -> Column:
    """struct(file, line) of `File:line`, null if it isn't one: the line is a number after the last colon."""
    text = F.trim(text)
    line = F.trim(F.element_at(F.split(text, ":"), -1))
    file = F.substr(text, F.lit(1), F.length(text) - F.length(F.element_at(F.split(text, ":"), -1)) - 1)
    number = F.when(line.rlike("^[+-]?[0-9]+$"), line.try_cast("bigint"))
    good = (F.instr(text, ":") > 0) & ~F.contains(text, F.lit("<")) & (F.length(file) > 0) & number.isNotNull()
    return F.when(good, F.struct(file.alias("file"), number.alias("line")))


def relative_path(cls: Column) -> Column:
    """`a.b.C$D` -> `a/b/C.java`."""
    return F.concat(F.replace(F.substring_index(cls, "$", 1), F.lit("."), F.lit("/")), F.lit(".java"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def path_matches(asked: Column, path: Column) -> Column:
    """A bare file name matches any path; one with folders must end with the whole path."""
    return ~F.contains(asked, F.lit("/")) | F.endswith(asked, path)


def dotted(descriptor: Column) -> Column:
    """`La/b;` -> `a.b`; others as they are."""
    inner = F.replace(F.regexp_extract(descriptor, "^L(.*);$", 1), F.lit("/"), F.lit("."))
    return F.when(descriptor.rlike("^L.*;$"), inner).otherwise(descriptor)


def parameters(signature: Column) -> Column:
    """Descriptors of the parameters of `(...)R`."""
    inside = F.regexp_extract(signature, r"^\((.*)\)", 1)
    return F.regexp_extract_all(inside, F.lit(r"\[*(?:L[^;]*;|[A-Z])"), F.lit(0))


def flag(access: Column, bit: int) -> Column:
    return access.bitwiseAND(F.lit(bit)) != 0


def short_name(name: Column) -> Column:
    """The last two parts of a dotted name."""
    return F.substring_index(name, ".", -2)


def is_opaque(name: Column) -> Column:
    return F.startswith(name, F.lit(OPAQUE))


def line_at(positions: Column, offset: Column) -> Column:
    """Line of the last position at or before `offset`; null before the first."""
    return F.try_element_at(F.filter(positions, lambda p: p["offset"] <= offset), F.lit(-1))["line"]
