"""Column expressions over file paths and permission modes (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern: a directory path ends in "/" (or is empty), optional leading "/".
DIRECTORY_PATH_PATTERN = r"^(/)?([^/]*/)*$"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def band(c: str | Column, mask: int) -> Column:
    """Bitwise AND with an integer mask."""
    return _c(c).bitwiseAND(F.lit(mask))


def depth(path: str | Column) -> Column:
    """Number of '/' characters in the path."""
    p = _c(path)
    return (F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))).cast("int")


def filetype(path: str | Column, null_if_no_dot: bool = False) -> Column:
    """Text after the last '.', or the whole path when there is no dot."""
    p = _c(path)
    last = F.element_at(F.split(p, r"\."), -1)
    return F.when(p.contains("."), last).otherwise(F.lit(None)) if null_if_no_dot else last


def octal_mode(mode: str | Column) -> Column:
    """Last three octal digits of an integer mode (setuid etc. ignored), e.g. '755'."""
    return F.lpad(F.conv(band(mode, 511).cast("string"), 10, 8), 3, "0")


def perm_digit(mode: str | Column, who: str) -> Column:
    """Permission digit for 'user' / 'group' / 'other' (right-aligned, so 4-digit modes work)."""
    shift = {"user": 6, "group": 3, "other": 0}[who]
    return band(F.shiftright(_c(mode), shift), 7).cast("int")


def symbolic_mode(mode: str | Column, kind: str | Column | None = None) -> Column:
    """``-rwxr-xr-x`` text: type letter plus nine permission bits."""
    m = _c(mode)
    first = F.lit("-") if kind is None else F.when(_c(kind) == "directory", "d").otherwise("-")
    letters = "rwxrwxrwx"
    parts = [first]
    for i, ch in enumerate(letters):
        bit = 1 << (8 - i)
        parts.append(F.when(band(m, bit) != 0, F.lit(ch)).otherwise(F.lit("-")))
    return F.concat(*parts)


def path_parts(path: str | Column) -> Column:
    return F.split(_c(path), "/")


def ancestors(path: str | Column) -> Column:
    """Component-exact ancestor directories of a path, outermost first.

    ``a/b/c`` -> [``a``, ``a/b``]; ``a/b/`` -> [``a``, ``a/b``]. Prefix
    matching (``a/bc`` under ``a/b``) cannot happen. The i-th ancestor is the
    text before the i-th '/' (``substring_index``), so the path is never split
    into an array per ancestor.
    """
    p = _c(path)
    d = depth(p)
    return F.when(d > 0, F.transform(F.sequence(F.lit(1), d), lambda i: F.call_function("substring_index", p, F.lit("/"), i))) \
            .otherwise(F.array().cast("array<string>"))


def is_directory_path(path: str | Column) -> Column:
    return _c(path).rlike(DIRECTORY_PATH_PATTERN)


def human_size(size: str | Column) -> Column:
    """``du -h`` style text: integer bytes below 1 KiB, else one decimal below 10 units
    and whole units above, always rounded up; units K, M, G, T, P (base 1024)."""
    s = _c(size).cast("double")
    expr = s.cast("long").cast("string")
    for k, unit in enumerate("KMGTP", start=1):  # outermost test = largest unit
        v = s / float(1024 ** k)
        text = F.when(v < 10, F.format_string("%.1f%s", F.ceil(v * 10) / 10, F.lit(unit))) \
                .otherwise(F.format_string("%d%s", F.ceil(v), F.lit(unit)))
        expr = F.when(s >= float(1024 ** k), text).otherwise(expr)
    return expr
