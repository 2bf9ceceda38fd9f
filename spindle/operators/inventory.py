"""File-inventory operators.

Input ``files``: one row per stat record with at least ``path``, ``size``,
``type`` (``regular file`` / ``directory``) and optionally ``mode``, ``uid``,
``gid``, ``user``, ``group``, ``mtime``, ``atime`` (epoch seconds).

The reference re-reads the whole listing once per directory; here the
directory rollup is one explode of ancestor paths plus one aggregation
(partial aggregation in every task, so a directory holding a third of all
files is pre-summed before the shuffle).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.functions import paths as P
from spindle.session import cut_lineage

REGULAR = "regular file"
DIRECTORY = "directory"


# ------------------------------------------------------------------ projections

def derive_path_columns(files: DataFrame, path: str = "path", mode: str = "mode") -> DataFrame:
    """Depth, filetype, permission digits, octal and symbolic mode text."""
    out = files.withColumn("depth", P.depth(path)).withColumn("filetype", P.filetype(path))
    if mode in files.columns:
        kind = F.col("type") if "type" in files.columns else None
        out = (out.withColumn("perm_user", P.perm_digit(mode, "user"))
                  .withColumn("perm_group", P.perm_digit(mode, "group"))
                  .withColumn("perm_other", P.perm_digit(mode, "other"))
                  .withColumn("mode_text", P.octal_mode(mode))
                  .withColumn("mode_symbolic", P.symbolic_mode(mode, kind)))
    return out


def write_access(requests: DataFrame, files: DataFrame, users: DataFrame, posix: bool = False) -> DataFrame:
    """write access of (user, path) requests.

    ``requests(user, path)``, ``files(path, uid, gid, mode)``, ``users(user, uid, gid)``.
    State: ``user_not_found`` / ``path_not_found`` / ``writable`` / ``not_writable``.
    Default ORs owner, group and other bits (parity); ``posix=True`` applies the
    first matching class only. Two equi left joins, no theta join.
    """
    f = files.select("path", F.col("uid").alias("f_uid"), F.col("gid").alias("f_gid"), "mode")
    u = users.select("user", F.col("uid").alias("u_uid"), F.col("gid").alias("u_gid"))
    j = requests.join(u, "user", "left").join(f, "path", "left")
    owner = F.col("f_uid") == F.col("u_uid")
    group = F.col("f_gid") == F.col("u_gid")
    ow = P.band("mode", 0o200) != 0
    gw = P.band("mode", 0o020) != 0
    xw = P.band("mode", 0o002) != 0
    if posix:
        ok = F.when(owner, ow).when(group, gw).otherwise(xw)
    else:
        ok = (owner & ow) | (group & gw) | xw
    state = (F.when(F.col("u_uid").isNull(), "user_not_found")
              .when(F.col("mode").isNull(), "path_not_found")
              .when(ok, "writable").otherwise("not_writable"))
    return j.select("user", "path", state.alias("state"))


def writable_state(files: DataFrame, writable: str = "writable", exists: str = "exists") -> DataFrame:
    """writable / missing / exists-not-writable label from snapshot columns."""
    label = (F.when(F.col(writable), "writable")
              .when(~F.col(exists), "missing")
              .otherwise("exists_not_writable"))
    return files.withColumn("writable_state", label)


def age_days(files: DataFrame, asof_epoch: int, cols: Sequence[str] = ("mtime", "atime")) -> DataFrame:
    """epoch seconds -> timestamp text and whole days since, against an as-of instant."""
    asof = F.timestamp_seconds(F.lit(asof_epoch))
    out = files
    for c in cols:
        ts = F.timestamp_seconds(F.col(c))
        out = (out.withColumn(f"{c}_text", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
                  .withColumn(f"{c}_days", F.datediff(asof, ts)))
    return out


def filter_depth(files: DataFrame, lo: int, hi: int, kind: str | None = DIRECTORY) -> DataFrame:
    """F8: ``-mindepth lo -maxdepth hi -type d``; depth counted in '/' separators."""
    cond = P.depth("path").between(lo, hi)
    if kind is not None:
        cond = cond & (F.col("type") == kind)
    return files.filter(cond)


def unique_ts(df: DataFrame, base_ns: int, order_cols: Sequence[str], partition_cols: Sequence[str] = ()) -> DataFrame:
    """distinct timestamps for equal-time points, ``base + ordinal`` in ns.

    With ``partition_cols`` the ordinal restarts per bucket; the numbering is
    distributed (no bucket has to fit one task). Without, the order-free
    form: ``monotonically_increasing_id`` (unique, not dense).
    """
    from spindle.operators.ordering import row_numbers
    if partition_cols:
        return row_numbers(df, list(partition_cols), list(order_cols), "__rn") \
            .withColumn("ts_ns", F.lit(base_ns) + F.col("__rn") - 1).drop("__rn")
    return df.withColumn("ts_ns", F.lit(base_ns) + F.monotonically_increasing_id())


def unique_paths(files: DataFrame) -> DataFrame:
    """distinct paths (sorting is left to the sink)."""
    return files.select("path").distinct()


# ------------------------------------------------------------------ aggregations

def directory_entries(files: DataFrame) -> DataFrame:
    """(dir, path, size, type) for every component-exact ancestor directory of every record."""
    return files.select(F.explode(P.ancestors("path")).alias("dir"), "path", "size", "type")


def directory_rollup(files: DataFrame) -> DataFrame:
    """A1/A4: per directory, recursive size and count of regular files, count of
    directories beneath, and its depth.

    One scan of the listing: every record is exploded to its ancestors and
    aggregated once per directory (directory records also count as their own
    row, so an empty directory appears). The directory count is a second,
    small aggregation over the directory set itself (rows = directories,
    not files) read from the checkpointed per-directory table.
    """
    is_reg = (F.col("type") == REGULAR)
    own = F.when(F.col("type") == DIRECTORY, F.array(F.regexp_replace("path", "/+$", ""))) \
           .otherwise(F.array().cast("array<string>"))
    entries = files.select(F.explode(F.concat(P.ancestors("path"), own)).alias("dir"),
                           F.when(is_reg, F.col("size")).alias("reg_size"), is_reg.alias("is_reg"),
                           F.col("type"), F.col("path"))
    # a directory record is not "beneath" itself: only ancestors carry its size / file counts
    per_dir = entries.groupBy("dir").agg(F.coalesce(F.sum("reg_size"), F.lit(0)).cast("long").alias("size"),
                                         F.count_if("is_reg").alias("files"))
    # materialised once (rows = directories): the directory count reads it instead
    # of exploding every file path a second time
    per_dir = cut_lineage(per_dir)
    sub = (per_dir.select(F.explode(P.ancestors("dir")).alias("dir"))
                  .groupBy("dir").agg(F.count(F.lit(1)).alias("dirs")))
    return (per_dir.join(sub, "dir", "left")
                   .select("dir", "size", "files", F.coalesce("dirs", F.lit(0)).alias("dirs"),
                           (P.depth("dir") + 1).alias("depth")))


def total_size(files: DataFrame) -> DataFrame:
    """A2: total size of regular files."""
    return files.filter(F.col("type") == REGULAR).agg(F.sum("size").cast("long").alias("total_size"),
                                                      F.count(F.lit(1)).alias("files"))


def top_level_sizes(files: DataFrame, root: str | None = None, human: bool = True) -> DataFrame:
    """A3: ``du -sh root/*/`` -- size of each immediate subdirectory of ``root``
    (``None``: of the top level)."""
    f = files.filter(F.col("type") == REGULAR)
    if root:
        prefix = root.rstrip("/") + "/"
        f = f.filter(F.col("path").startswith(prefix)).withColumn(
            "rel", F.substring(F.col("path"), len(prefix) + 1, 1 << 30))
    else:
        f = f.withColumn("rel", F.col("path"))
    parts = F.split("rel", "/")
    f = f.filter(F.size(parts) > 1)  # files directly in root belong to no subdirectory
    top = F.element_at(parts, 1)
    name = top if not root else F.concat(F.lit(root.rstrip("/") + "/"), top)
    out = f.groupBy(name.alias("dir")).agg(F.sum("size").cast("long").alias("size"))
    return out.withColumn("size_text", P.human_size("size")) if human else out


def sum_by_directory(points: DataFrame, dir_col: str = "path", size_col: str = "size", time_col: str | None = None,
                     asof: str | Column | None = None, interval: str = "1 HOUR") -> DataFrame:
    """A5: ``SUM(size) ... WHERE time >= asof - interval AND dir =~ directory pattern GROUP BY dir``
    (all times without ``time_col``)."""
    if time_col is not None:
        from spindle.operators.timeseries import since
        points = since(points, time_col, asof, interval)
    return (points.filter(P.is_directory_path(dir_col))
                  .groupBy(F.col(dir_col).alias("directory_path"))
                  .agg(F.sum(size_col).cast("long").alias("sum_size")))


def cardinality(df: DataFrame, cols: Sequence[str], approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Distinct count per column (exact, or HyperLogLog++ for large tags)."""
    fn = (lambda c: F.approx_count_distinct(c, rsd)) if approx else F.count_distinct
    return df.agg(*[fn(F.col(c)).alias(f"distinct_{c}") for c in cols])


def numbered_distinct(df: DataFrame, col: str, partitions: int | None = None) -> DataFrame:
    """``sort | uniq | cat -n`` -- distinct values numbered 1..n in sort order.

    Distributed: the distinct values are range-partitioned and sorted, each
    gets its global position from a per-partition count table. No single-task
    window.
    """
    from spindle.operators.ordering import global_positions
    d = df.select(F.col(col).alias("value")).filter(F.col("value").isNotNull()).distinct()
    return global_positions(d, ["value"], partitions).select((F.col("__g") + 1).alias("n"), "value")


def distinct_counts(df: DataFrame, subsets: Mapping[str, Sequence[str]]) -> DataFrame:
    """Distinct record counts over several column subsets, one row.

    Rows holding nulls count, like ``drop_duplicates().shape[0]``.
    """
    # one aggregate a subset (a joint one would expand every row by the number of subsets)
    counts = None
    for label, cols in subsets.items():
        one = df.select(*cols).distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("label"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts.agg(*[F.max(F.when(F.col("label") == label, F.col("n"))).alias(label) for label in subsets])


def distinct_sketches(df: DataFrame, col: str, by: Sequence[str | Column], bits: int = 12) -> DataFrame:
    """A6 stored form: one HyperLogLog sketch of ``col`` per group (a day and a tag), to be kept
    as a column and united at read; ``2^bits`` registers, standard error 1.04 / 2^(bits / 2)."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(F.col(col), bits).alias("sketch"))


def distinct_of_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Estimated distinct count over the sketches of each group, ``estimate``."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def null_counts(df: DataFrame, prefix: str) -> DataFrame:
    """Null and non-null cell totals over the columns starting with ``prefix``."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    nulls = sum((F.sum(F.col(c).isNull().cast("long")) for c in cols), F.lit(0))
    return df.agg(nulls.alias("null_cells"), (F.count(F.lit(1)) * len(cols) - nulls).alias("non_null_cells"))


def count_where(df: DataFrame, cond: Column, name: str = "n") -> DataFrame:
    """A10: conditional count."""
    return df.agg(F.count_if(cond).alias(name))
