"""``stat`` record lines (S3): one anchored expression per format, greedy path.

Formats: ``colon`` = ``%s:%n:%a:%U:%G:%Y:%X:%F`` (size, path, octal mode, user,
group, mtime, atime epoch seconds, type); ``space`` = ``%s %n %A %U %G %y %x``
(size, path, symbolic mode, user, group, mtime and atime as text). A ``:`` or
a space inside the path cannot break the record (Q5): every other field is
anchored from the right.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the two stat output formats.
COLON_PATTERN = r"^(\d+):(.*):([0-7]{3,4}):([^:]*):([^:]*):(-?\d+):(-?\d+):([^:]*)$"
STAMP = r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(?:\.\d+)? [+-]\d{4}"
SEP = "\u0001"  # group separator of the one-pass split (a control character, never in stat text)
SPACE_PATTERN = rf"^(\d+) (.*) ([-dlcbps][-r][-w][-xsS][-r][-w][-xsS][-r][-w][-xtT]) (\S+) (\S+) ({STAMP}) ({STAMP})$"


def read_stat_records(lines: DataFrame, fmt: str = "colon", col: str = "value") -> tuple[DataFrame, DataFrame]:
    """S3: text lines -> (files, rejects).

    One regex pass per line: the groups are written out with a separator
    and split (a line that holds the separator is matched group by group), behind a projection barrier so the match is not repeated for
    every field.
    """
    v = F.col(col)
    if fmt == "colon":
        pat, n = COLON_PATTERN, 8
    elif fmt == "space":
        pat, n = SPACE_PATTERN, 7
    else:
        raise ValueError(fmt)
    template = SEP.join(f"${i}" for i in range(1, n + 1))
    groups = F.array(*[F.regexp_extract(v, pat, i) for i in range(1, n + 1)])
    parts = F.when(~v.contains(SEP), F.split(F.regexp_replace(v, pat, template), SEP)).when(v.rlike(pat), groups)
    split = lines.select(F.inline(F.array(F.struct(v.alias("__line"), parts.alias("__p")))))
    g = [F.get("__p", F.lit(i)) for i in range(n)]
    numbers = (g[0], g[5], g[6]) if fmt == "colon" else (g[0],)  # beyond 64 bits: to the rejects
    ok = F.coalesce(F.size("__p") == n, F.lit(False))
    for x in numbers:
        ok = ok & x.try_cast("long").isNotNull()
    good = split.filter(ok)
    if fmt == "colon":
        files = good.select(
            g[0].try_cast("long").alias("size"), g[1].alias("path"),
            F.conv(g[2], 8, 10).cast("int").alias("mode"), g[3].alias("user"), g[4].alias("group"),
            g[5].try_cast("long").alias("mtime"), g[6].try_cast("long").alias("atime"), g[7].alias("type"))
    else:
        def stamp(c):
            return F.unix_timestamp(F.regexp_replace(c, r"\.\d+", ""), "yyyy-MM-dd HH:mm:ss Z")
        files = good.select(
            g[0].try_cast("long").alias("size"), g[1].alias("path"), g[2].alias("mode_symbolic"),
            g[3].alias("user"), g[4].alias("group"), stamp(g[5]).alias("mtime"), stamp(g[6]).alias("atime"))
    return files, split.filter(~ok).select(F.col("__line").alias("value"))


def render_colon(files: DataFrame) -> DataFrame:
    """The colon format of a file table (for tests and synthetic listings)."""
    return files.select(F.format_string("%d:%s:%s:%s:%s:%d:%d:%s", "size", "path",
                                        F.conv(F.col("mode").cast("string"), 10, 8), "user", "group", "mtime", "atime",
                                        "type").alias("value"))
