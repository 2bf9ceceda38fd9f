"""Registered file-inventory queries on B-WEB (pages as files) and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindle.functions import paths as P
from spindle.operators import inventory as inv
from spindle.plans import bindings as b
from spindle.plans.registry import register, ts_text
from spindle.session import store

W = b.web_files_sql()
# DuckDB: ancestors of every record, the same rule as functions.paths.ancestors
ANC = f"""SELECT f.*, array_to_string(list_slice(string_split(path, '/'), 1, i), '/') AS dir
  FROM ({W}) f, unnest(generate_series(1, len(string_split(path, '/')) - 1)) AS t(i)"""
ASOF_EPOCH = b.BASE_MTIME + 400 * 86400


def _bits(col: str) -> str:
    letters = "rwxrwxrwx"
    return " || ".join(f"CASE WHEN ({col} & {1 << (8 - i)}) <> 0 THEN '{ch}' ELSE '-' END"
                       for i, ch in enumerate(letters))


@register("f1_f4_path_columns", f"""
SELECT file_id, CAST(length(path) - length(replace(path, '/', '')) AS INTEGER) AS depth,
       string_split(path, '.')[-1] AS filetype,
       CAST((mode >> 6) & 7 AS INTEGER) AS perm_user, CAST((mode >> 3) & 7 AS INTEGER) AS perm_group,
       CAST(mode & 7 AS INTEGER) AS perm_other, lpad(format('{{:o}}', mode & 511), 3, '0') AS mode_text,
       '-' || {_bits('mode')} AS mode_symbolic
FROM ({W}) w""")
def f1_f4(spark, sf):
    d = inv.derive_path_columns(b.web_files(spark, sf))
    return d.select("file_id", "depth", "filetype", "perm_user", "perm_group", "perm_other",
                    "mode_text", "mode_symbolic")


REQ_SQL = f"""SELECT 'user' || CAST(1000 + (file_id * 3) % 6 AS VARCHAR) AS "user", path FROM ({W}) w
  UNION ALL SELECT 'user' || CAST(1000 + (file_id * 3) % 6 AS VARCHAR), path || '.bak' FROM ({W}) w"""
USERS_SQL = """SELECT 'user' || CAST(u AS VARCHAR) AS "user", u AS uid, 100 + u % 3 AS gid
  FROM range(1000, 1005) t(u)"""


def _requests(files):
    uname = F.concat(F.lit("user"), (F.lit(1000) + F.pmod(F.col("file_id") * 3, F.lit(6))).cast("string"))
    return (files.select(uname.alias("user"), "path")
            .unionByName(files.select(uname.alias("user"), F.concat("path", F.lit(".bak")).alias("path"))))


def _users(files):
    # the owners seen in the listing, primary group = 100 + uid % 3
    return files.select("uid").distinct().select(
        F.concat(F.lit("user"), F.col("uid").cast("string")).alias("user"), "uid",
        (F.lit(100) + F.pmod("uid", F.lit(3))).cast("int").alias("gid"))


@register("f5_write_access", f"""
SELECT r."user" AS "user", r.path AS path,
  CASE WHEN u.uid IS NULL THEN 'user_not_found' WHEN f.mode IS NULL THEN 'path_not_found'
       WHEN (f.uid = u.uid AND (f.mode & 128) <> 0) OR (f.gid = u.gid AND (f.mode & 16) <> 0)
            OR (f.mode & 2) <> 0 THEN 'writable' ELSE 'not_writable' END AS state
FROM ({REQ_SQL}) r LEFT JOIN ({USERS_SQL}) u ON r."user" = u."user"
LEFT JOIN ({W}) f ON r.path = f.path""")
def f5(spark, sf):
    files = b.web_files(spark, sf)
    return inv.write_access(_requests(files), files, _users(files))


@register("f6_writable_state", f"""
SELECT r.path AS path, CASE WHEN f.mode IS NOT NULL AND (f.mode & 146) <> 0 THEN 'writable'
  WHEN f.mode IS NULL THEN 'missing' ELSE 'exists_not_writable' END AS writable_state
FROM ({REQ_SQL}) r LEFT JOIN ({W}) f ON r.path = f.path""")
def f6(spark, sf):
    files = b.web_files(spark, sf)
    snap = (_requests(files).join(files.select("path", "mode"), "path", "left")
            .select("path", F.col("mode").isNotNull().alias("exists"),
                    F.coalesce(P.band("mode", 0o222) != 0, F.lit(False)).alias("writable")))
    return inv.writable_state(snap).select("path", "writable_state")


@register("f7_age_days", f"""
SELECT file_id, strftime(make_timestamp(mtime * 1000000), '%Y-%m-%d %H:%M:%S') AS mtime_text,
  CAST(date_diff('day', make_timestamp(mtime * 1000000), make_timestamp({ASOF_EPOCH}::BIGINT * 1000000)) AS INTEGER) AS mtime_days,
  strftime(make_timestamp(atime * 1000000), '%Y-%m-%d %H:%M:%S') AS atime_text,
  CAST(date_diff('day', make_timestamp(atime * 1000000), make_timestamp({ASOF_EPOCH}::BIGINT * 1000000)) AS INTEGER) AS atime_days
FROM ({W}) w""")
def f7(spark, sf):
    d = inv.age_days(b.web_files(spark, sf), ASOF_EPOCH)
    return d.select("file_id", "mtime_text", "mtime_days", "atime_text", "atime_days")


@register("f8_dirs_depth_1_to_2", f"""
SELECT DISTINCT dir AS path FROM ({ANC}) a
WHERE length(dir) - length(replace(dir, '/', '')) BETWEEN 1 AND 2""")
def f8(spark, sf):
    files = b.web_files(spark, sf)
    dirs = (files.select(F.explode(P.ancestors("path")).alias("path")).distinct()
            .withColumn("type", F.lit(inv.DIRECTORY)))
    listing = files.select("path", "type").unionByName(dirs)
    return inv.filter_depth(listing, 1, 2, inv.DIRECTORY).select("path")


@register("f9_directory_path_flag", f"""
SELECT file_id, regexp_matches(path, '^(/)?([^/]*/)*$') AS is_dir_path FROM ({W}) w""")
def f9(spark, sf):
    files = b.web_files(spark, sf)
    return files.select("file_id", P.is_directory_path("path").alias("is_dir_path"))


@register("f11_unique_ts", """
SELECT event_id, 1700000000000000000 + row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS ts_ns
FROM events""")
def f11(spark, sf):
    ev = b.table(spark, sf, "events").select("event_id", "event_type", "ts")
    return inv.unique_ts(ev, 1700000000000000000, ["ts", "event_id"], ["event_type"]).select("event_id", "ts_ns")


@register("f12_unique_paths", f"SELECT DISTINCT path FROM ({W}) w")
def f12(spark, sf):
    return inv.unique_paths(b.web_files(spark, sf))


@register("a1_directory_rollup", f"""
WITH d AS (SELECT DISTINCT dir FROM ({ANC}) a),
sz AS (SELECT dir, CAST(sum(size) AS BIGINT) AS size, count(*) AS files FROM ({ANC}) a
       WHERE type = 'regular file' GROUP BY dir),
sub AS (SELECT array_to_string(list_slice(string_split(dir, '/'), 1, i), '/') AS dir, count(*) AS dirs
        FROM d, unnest(generate_series(1, len(string_split(dir, '/')) - 1)) AS t(i) GROUP BY 1)
SELECT d.dir AS dir, coalesce(sz.size, 0) AS size, coalesce(sz.files, 0) AS files,
       coalesce(sub.dirs, 0) AS dirs, CAST(length(d.dir) - length(replace(d.dir, '/', '')) + 1 AS INTEGER) AS depth
FROM d LEFT JOIN sz ON d.dir = sz.dir LEFT JOIN sub ON d.dir = sub.dir""")
def a1(spark, sf):
    return inv.directory_rollup(b.web_files(spark, sf))


@register("a2_total_size", f"""
SELECT CAST(sum(size) AS BIGINT) AS total_size, count(*) AS files FROM ({W}) w WHERE type = 'regular file'""")
def a2(spark, sf):
    return inv.total_size(b.web_files(spark, sf))


def _human_sql(col: str) -> str:
    expr = f"CAST(CAST({col} AS BIGINT) AS VARCHAR)"
    for k, unit in enumerate("KMGTP", start=1):
        v = f"({col} / {float(1024 ** k)})"
        text = (f"CASE WHEN {v} < 10 THEN printf('%.1f%s', ceil({v} * 10) / 10, '{unit}') "
                f"ELSE printf('%d%s', CAST(ceil({v}) AS BIGINT), '{unit}') END")
        expr = f"CASE WHEN {col} >= {float(1024 ** k)} THEN {text} ELSE {expr} END"
    return expr


@register("a3_top_level_sizes", f"""
SELECT dir, size, {_human_sql('size')} AS size_text FROM (
  SELECT string_split(path, '/')[1] AS dir, CAST(sum(size) AS BIGINT) AS size
  FROM ({W}) w WHERE type = 'regular file' AND len(string_split(path, '/')) > 1 GROUP BY 1) x""")
def a3(spark, sf):
    return inv.top_level_sizes(b.web_files(spark, sf))


@register("a5_sum_by_directory_path", f"""
SELECT path AS directory_path, CAST(sum(size) AS BIGINT) AS sum_size FROM ({W}) w
WHERE regexp_matches(path, '^(/)?([^/]*/)*$') GROUP BY path""")
def a5(spark, sf):
    return inv.sum_by_directory(b.web_files(spark, sf))


@register("a5_recent_sum_by_directory", f"""
SELECT directory_path, CAST(sum(size) AS BIGINT) AS sum_size FROM (
  SELECT regexp_replace(path, '[^/]*$', '') AS directory_path, size, mtime FROM ({W}) w)
WHERE mtime >= (SELECT max(mtime) - 86400 * 2 FROM ({W}) m) GROUP BY directory_path""")
def a5t(spark, sf):
    """The files of the last two days before the newest, by directory."""
    f = b.web_files(spark, sf).select(F.regexp_replace("path", "[^/]*$", "").alias("path"), "size", F.timestamp_seconds("mtime").cast("timestamp_ntz").alias("t"))
    newest = f.agg(F.max("t").cast("string")).first()[0]
    return inv.sum_by_directory(f, time_col="t", asof=newest, interval="2 DAYS")


@register("a6_cardinality", """
SELECT count(DISTINCT event_type) AS distinct_event_type, count(DISTINCT user_id) AS distinct_user_id,
       count(DISTINCT props) AS distinct_props FROM events""")
def a6(spark, sf):
    return inv.cardinality(b.table(spark, sf, "events"), ["event_type", "user_id", "props"])


@register("a6_numbered_distinct", """
SELECT row_number() OVER (ORDER BY value) AS n, value FROM (SELECT DISTINCT props AS value FROM events
WHERE props IS NOT NULL) d""")
def a6n(spark, sf):
    return inv.numbered_distinct(b.table(spark, sf, "events"), "props")


@register("a7_distinct_counts", """
SELECT (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS order_line,
       (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) AS part_supp,
       (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)) AS flags,
       (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS all_columns""")
def a7(spark, sf):
    li = b.table(spark, sf, "lineitem")
    return inv.distinct_counts(li, {"order_line": ["l_orderkey", "l_linenumber"],
                                    "part_supp": ["l_partkey", "l_suppkey"],
                                    "flags": ["l_returnflag", "l_linestatus"],
                                    "all_columns": li.columns})


@register("a6_sketches_united_at_read", """SELECT event_type AS tag, count(DISTINCT user_id) AS exact, true AS within_5_percent FROM events GROUP BY 1""")
def a6s(spark, sf):
    """Sketches stored per day and tag, united over the days; held against the exact count."""
    ev = b.table(spark, sf, "events").select(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day"), F.col("event_type").alias("tag"), "user_id")
    stored = store(inv.distinct_sketches(ev, "user_id", ["day", "tag"]))
    exact = ev.groupBy("tag").agg(F.count_distinct("user_id").alias("exact"))
    return inv.distinct_of_sketches(stored, ["tag"]).join(exact, "tag").select(
        "tag", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 0.05 * F.col("exact")).alias("within_5_percent"))


@register("j7_directory_entries", f"SELECT dir, path, size FROM ({ANC}) a")
def j7(spark, sf):
    return inv.directory_entries(b.web_files(spark, sf)).select("dir", "path", "size")


@register("c3_epoch_text", f"""
SELECT file_id, strftime(make_timestamp(mtime * 1000000), '%Y-%m-%d %H:%M:%S') AS mtime_text,
       mtime * 1000000000 AS mtime_ns FROM ({W}) w""")
def c3(spark, sf):
    files = b.web_files(spark, sf)
    ts = F.timestamp_seconds("mtime")
    return files.select("file_id", ts_text(ts).alias("mtime_text"),
                        (F.unix_micros(ts) * 1000).alias("mtime_ns"))


# ------------------------------------------------------------------ the data-lake listing (lineitem)

LAKE = b.LAKE_SQL
LAKE_ANC = f"""SELECT f.*, array_to_string(list_slice(string_split(path, '/'), 1, i), '/') AS dir
  FROM ({LAKE}) f, unnest(generate_series(1, len(string_split(path, '/')) - 1)) AS t(i)"""


@register("a1_lake_directory_rollup", f"""
WITH sz AS (SELECT dir, CAST(sum(size) AS BIGINT) AS size, count(*) AS files FROM ({LAKE_ANC}) a GROUP BY dir),
sub AS (SELECT array_to_string(list_slice(string_split(dir, '/'), 1, i), '/') AS dir, count(*) AS dirs
        FROM sz, unnest(generate_series(1, len(string_split(dir, '/')) - 1)) AS t(i) GROUP BY 1)
SELECT sz.dir AS dir, sz.size AS size, sz.files AS files, coalesce(sub.dirs, 0) AS dirs,
       CAST(length(sz.dir) - length(replace(sz.dir, '/', '')) + 1 AS INTEGER) AS depth
FROM sz LEFT JOIN sub ON sz.dir = sub.dir""")
def a1_lake(spark, sf):
    """A1/A4 over one file per lineitem row (600k files at sf0.1)."""
    return inv.directory_rollup(b.lake_files(spark, sf))


@register("a3_lake_top_level_sizes", f"""
SELECT dir, size, {_human_sql('size')} AS size_text FROM (
  SELECT '/warehouse/' || string_split(path, '/')[3] AS dir, CAST(sum(size) AS BIGINT) AS size
  FROM ({LAKE}) w GROUP BY 1) x""")
def a3_lake(spark, sf):
    """``du -sh /warehouse/*/``."""
    return inv.top_level_sizes(b.lake_files(spark, sf), root="/warehouse")
