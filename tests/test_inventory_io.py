"""Inventory expressions, line protocol and stat records."""

from pyspark.sql import functions as F

from spindle.functions import paths as P
from spindle.operators import inventory as inv
from spindle.sources import line_protocol as LP
from spindle.sources import stat_records as ST

# Own records with the grammar's features: quoted values, bare and escaped spaces, commas, two kinds of fields.
POINTS = [
    'disk\\ use,host="node 1",mount="/srv/a\\ b",class=fast\\,ssd used=77i,label="x, y=z",full=f 1000000000000000001',
    'disk\\ use,host="node 2",mount=/srv/c used=12i,ratio=0.25 1000000000000000002',
]


def test_parse_points(spark):
    lines = spark.createDataFrame([(x,) for x in POINTS] + [("no fields here",), ("m a=1 x y",), (None,)], "value string")
    pts, rej = LP.read_line_protocol(lines)
    rows = {r["ts_ns"] % 10: r for r in pts.select(
        "measurement", "tags", "ts_ns", LP.field_value("fields", "used", "long").alias("used"),
        LP.field_value("fields", "label").alias("label"), LP.field_value("fields", "full", "boolean").alias("full"),
        LP.field_value("fields", "ratio", "double").alias("ratio")).collect()}
    assert len(rows) == 2 and rej.count() == 3
    assert rows[1]["measurement"] == "disk use" and rows[1]["tags"] == {"host": "node 1", "mount": "/srv/a b", "class": "fast,ssd"}
    assert (rows[1]["used"], rows[1]["label"], rows[1]["full"]) == (77, "x, y=z", False)
    assert (rows[2]["tags"]["mount"], rows[2]["used"], rows[2]["ratio"]) == ("/srv/c", 12, 0.25)


def test_dirty_lines_are_rejected_not_fatal(spark):
    lines = [("m,a=1,a=2 f=1i,f=2i 5",), ("m,a=1 f=1i 99999999999999999999",), ("nope\u0001b=1\u0001",), ("m,a=x\u0001y f=1i 6",),
             ("m,a=1 f=99999999999999999999i 7",)]
    pts, rej = LP.read_line_protocol(spark.createDataFrame(lines, "value string"))
    got = {r["ts_ns"]: (r["a"], r["f"]) for r in pts.select("ts_ns", F.col("tags")["a"].alias("a"), LP.field_value("fields", "f", "long").alias("f")).collect()}
    assert got == {5: ("2", 2), 6: ("x\u0001y", 1), 7: ("1", None)} and rej.count() == 2


def test_writer_takes_back_line_ends_and_leaves_out_rows_without_fields(spark):
    rows = [(1, "two\nlines\r", "a\\nb\nc", 1), (2, "plain", None, None)]
    df = spark.createDataFrame(rows, "id long, path string, note string, size long")
    fields = {"note": "note", "size": "size"}
    lines = LP.to_line_protocol(df, "m", ["path"], fields, "id")
    assert lines.count() == 1 and "\n" not in lines.first()["value"] and LP.without_fields(df, fields).first()["id"] == 2
    pts, rej = LP.read_line_protocol(lines)
    r = pts.select(F.col("tags")["path"].alias("path"), LP.field_value("fields", "note").alias("note")).first()
    assert (r["path"], r["note"]) == ("two\nlines\r", "a\\nb\nc") and rej.count() == 0


def test_line_protocol_round_trip_with_special_characters(spark):
    vals = [(1, "a b,c=d\\e\"f", 10, 1.5, "x\"y"), (2, "plain", None, None, "z")]
    df = spark.createDataFrame(vals, "id long, path string, size long, ratio double, note string")
    lines = LP.to_line_protocol(df, "meas ure", ["path"], {"size": "size", "ratio": "ratio", "note": "note"}, "id")
    pts, rej = LP.read_line_protocol(lines)
    assert rej.count() == 0
    got = {r["ts_ns"]: r for r in pts.select(
        "measurement", "ts_ns", F.col("tags")["path"].alias("path"), LP.field_value("fields", "size", "long").alias("size"),
        LP.field_value("fields", "ratio", "double").alias("ratio"), LP.field_value("fields", "note").alias("note")).collect()}
    assert got[1]["measurement"] == "meas ure"
    assert (got[1]["path"], got[1]["size"], got[1]["ratio"], got[1]["note"]) == ("a b,c=d\\e\"f", 10, 1.5, "x\"y")
    assert (got[2]["path"], got[2]["size"], got[2]["note"]) == ("plain", None, "z")


def test_path_expressions(spark):
    df = spark.createDataFrame([("/a/b/c.tar.gz", 493), ("/a/bc/", 2541), ("noext", 420)], "path string, mode int")
    r = df.select(P.depth("path").alias("d"), P.filetype("path").alias("t"), P.octal_mode("mode").alias("o"),
                  P.perm_digit("mode", "user").alias("u"), P.symbolic_mode("mode").alias("s"),
                  P.ancestors("path").alias("anc"), P.is_directory_path("path").alias("isdir")).collect()
    assert (r[0]["d"], r[0]["t"], r[0]["o"], r[0]["u"], r[0]["s"]) == (3, "gz", "755", 7, "-rwxr-xr-x")
    assert r[0]["anc"] == ["", "/a", "/a/b"] and r[0]["isdir"] is False
    assert (r[1]["o"], r[1]["u"], r[1]["isdir"]) == ("755", 7, True)  # setuid ignored (right-aligned digits)
    assert (r[2]["t"], r[2]["anc"]) == ("noext", [])


def test_directory_rollup_component_exact(spark):
    files = spark.createDataFrame([("a/b/x", 1, "regular file"), ("a/bc/y", 2, "regular file"), ("a/b/z/w", 4, "regular file")],
                                  "path string, size long, type string")
    r = {x["dir"]: (x["size"], x["files"], x["dirs"]) for x in inv.directory_rollup(files).collect()}
    assert r == {"a": (7, 3, 3), "a/b": (5, 2, 1), "a/bc": (2, 1, 0), "a/b/z": (4, 1, 0)}
    tot = inv.total_size(files).collect()[0]["total_size"]
    assert tot == r["a"][0]


def test_human_size(spark):
    df = spark.createDataFrame([(512,), (4096,), (1536,), (20 * 1024 * 1024,), (10 * 1024 ** 3 + 1,)], "s long")
    assert [r[0] for r in df.select(P.human_size("s")).collect()] == ["512", "4.0K", "1.5K", "20M", "11G"]


def test_write_access_states(spark):
    files = spark.createDataFrame([("f1", 1000, 100, 0o644), ("f2", 1001, 100, 0o664), ("f3", 1001, 101, 0o646)],
                                  "path string, uid int, gid int, mode int")
    users = spark.createDataFrame([("u0", 1000, 100)], "user string, uid int, gid int")
    req = spark.createDataFrame([("u0", "f1"), ("u0", "f2"), ("u0", "f3"), ("u0", "nope"), ("ghost", "f1")],
                                "user string, path string")
    got = {(r["user"], r["path"]): r["state"] for r in inv.write_access(req, files, users).collect()}
    assert got == {("u0", "f1"): "writable", ("u0", "f2"): "writable", ("u0", "f3"): "writable",
                   ("u0", "nope"): "path_not_found", ("ghost", "f1"): "user_not_found"}
    posix = {(r["path"]): r["state"] for r in inv.write_access(req, files, users, posix=True).collect()}
    assert posix["f3"] == "writable"


def test_numbered_distinct_dense(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "c", "a", None, "b", "d"]], "v string")
    got = [(r["n"], r["value"]) for r in inv.numbered_distinct(df, "v", partitions=3).orderBy("n").collect()]
    assert got == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]


def test_distinct_counts_by_column_sets(spark):
    df = spark.createDataFrame([(i % 4, i % 6, "odd" if i % 2 else "even") for i in range(24)], "a int, b int, c string")
    r = inv.distinct_counts(df, {"all": df.columns, "ab": ["a", "b"], "ac": ["a", "c"], "c": ["c"]}).first()
    assert (r["all"], r["ab"], r["ac"], r["c"]) == (12, 12, 4, 2)


def test_stat_records_colon_and_space(spark):
    lines = spark.createDataFrame([("640:/srv/x:y z/w:755:u:g:1500000000:1600000000:directory",), ("bad",),
                                   ("99999999999999999999:p:644:u:g:1:1:file",), ("7:a\u0001b:644:u:g:1:2:file",)], "value string")
    files, rej = ST.read_stat_records(lines)
    r = {x["size"]: x for x in files.collect()}
    assert (r[640]["path"], r[640]["mode"], r[640]["type"]) == ("/srv/x:y z/w", 0o755, "directory")
    assert r[7]["path"] == "a\u0001b" and len(r) == 2 and rej.count() == 2
    sp = spark.createDataFrame([("10 /x y/z -rw-r--r-- u g 2024-01-02 03:04:05.123456789 +0000 "
                                 "2024-01-02 03:04:06.000000000 +0000",)], "value string")
    f2, _ = ST.read_stat_records(sp, "space")
    r2 = f2.collect()[0]
    assert (r2["path"], r2["mode_symbolic"], r2["mtime"]) == ("/x y/z", "-rw-r--r--", 1704164645)
