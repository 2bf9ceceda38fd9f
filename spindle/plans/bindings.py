"""Test-table bindings: how the driver tables become the inputs of each operator.

Each binding reads whole tables (only the columns it needs, so the parquet scan
prunes) and derives the operator input with DataFrame expressions:

* FLOW               -- nation-to-nation trade-flow counts
* LINEAGE            -- region > nation > customer > order > order line > part (acyclic)
* EVENTS             -- transitions of event types per user, between enter and exit (cyclic)
* PART / PARTB       -- consecutive parts within an order; PARTB adds part > brand
* B-WEB              -- pages as a file inventory (path, size, synthetic stat)
* B-EV               -- events as a time series (ts, tag, value)
* B-EMB              -- embeddings as a vector store
* B-DOC              -- documents as a text corpus
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # The registered queries are defined in UTC (epoch <-> timestamp text);
    # time-zone-aware expressions take the zone when the plan is built.
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- graphs

def flow_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts per (supplier nation, customer nation) over the whole lineitem table."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    # orders/customer/supplier are dimension sides; AQE picks broadcast from
    # their measured size, lineitem is never broadcast.
    return (li.join(o, li.l_orderkey == o.o_orderkey)
              .join(c, F.col("o_custkey") == F.col("c_custkey"))
              .join(s, F.col("l_suppkey") == F.col("s_suppkey"))
              .groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst"))
              .agg(F.count(F.lit(1)).alias("n")))


def _node(kind: str, *cols: str):
    return F.concat(F.lit(kind), F.concat_ws("-", *[F.col(c).cast("string") for c in cols]))


def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of five tables as edges: one root-to-leaf path per order line."""
    return lineage_rows(spark, sf_dir).distinct()


def lineage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of :func:`lineage_edges` as the rows give them, repeated ones included."""
    def pairs(name, src, dst):
        t = table(spark, sf_dir, name)
        return t.select(_node(*src).alias("src"), _node(*dst).alias("dst"))

    line = ("l", "l_orderkey", "l_linenumber")
    return (pairs("nation", ("r", "n_regionkey"), ("n", "n_nationkey"))
         .unionByName(pairs("customer", ("n", "c_nationkey"), ("c", "c_custkey")))
         .unionByName(pairs("orders", ("c", "o_custkey"), ("o", "o_orderkey")))
         .unionByName(pairs("lineitem", ("o", "l_orderkey"), line))
         .unionByName(pairs("lineitem", line, ("p", "l_partkey"))))


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``enter > first type``, ``type > next type`` and ``last type > exit`` of every user."""
    from spindle.operators.ordering import lead_pairs
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    at = F.struct("ts", "event_id")
    ends = ev.groupBy("user_id").agg(F.min_by("event_type", at).alias("a"), F.max_by("event_type", at).alias("z"))
    return (lead_pairs(ev, ["user_id"], ["ts", "event_id"], "event_type").filter(F.col("src") != F.col("dst"))
            .unionByName(ends.select(F.lit("enter").alias("src"), F.col("a").alias("dst")))
            .unionByName(ends.select(F.col("z").alias("src"), F.lit("exit").alias("dst"))).distinct())


def part_brand_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PART with a leaf per brand, ids as text."""
    brands = table(spark, sf_dir, "part").select(_node("p", "p_partkey").alias("src"), F.col("p_brand").alias("dst"))
    return part_edges(spark, sf_dir).select(_node("p", "src").alias("src"), _node("p", "dst").alias("dst")).unionByName(brands)


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive distinct parts within an order (``lead`` over the line number).

    The lead is a join on the global position in the order (orderkey,
    linenumber, partkey), so one huge order is spread over many tasks instead
    of one window partition.
    """
    from spindle.operators.ordering import lead_pairs
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return (lead_pairs(li, ["l_orderkey"], ["l_linenumber", "l_partkey"], "l_partkey")
            .filter(F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
            .distinct())


# ---------------------------------------------------------------- inventory

# Fixed values of the synthetic stat columns: modes cycle through these six
# (octal 644, 755, 600, 664, 444, 4755), owner ids 1000..1004, group ids 100..102.
MODES = (420, 493, 384, 436, 292, 2541)
BASE_MTIME = 1700000000


def web_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages -> file records (path, size, type, mode, uid, gid, user, group, mtime, atime)."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    modes = F.array(*[F.lit(m) for m in MODES])
    uid = F.pmod(F.col("page_id"), F.lit(5)) + 1000
    gid = F.pmod(F.col("page_id"), F.lit(3)) + 100
    mtime = F.lit(BASE_MTIME) + F.col("page_id") * 3600
    return p.select(
        F.col("page_id").alias("file_id"),
        F.regexp_extract("url", r"^https?://([^?#]*)", 1).alias("path"),
        F.length("html").cast("long").alias("size"),
        F.lit("regular file").alias("type"),
        F.element_at(modes, (F.pmod(F.col("page_id"), F.lit(len(MODES))) + 1).cast("int")).alias("mode"),
        uid.cast("int").alias("uid"),
        gid.cast("int").alias("gid"),
        F.concat(F.lit("user"), uid.cast("string")).alias("user"),
        F.concat(F.lit("group"), gid.cast("string")).alias("group"),
        mtime.cast("long").alias("mtime"),
        (mtime + F.pmod(F.col("page_id") * 7919, F.lit(86400 * 30))).cast("long").alias("atime"),
    )


def web_files_sql() -> str:
    """DuckDB text of :func:`web_files` (used inside oracle queries)."""
    modes = ", ".join(str(m) for m in MODES)
    return f"""SELECT page_id AS file_id,
      regexp_extract(url, '^https?://([^?#]*)', 1) AS path,
      CAST(length(html) AS BIGINT) AS size,
      'regular file' AS type,
      [{modes}][(page_id % 6) + 1] AS mode,
      CAST(page_id % 5 + 1000 AS INTEGER) AS uid,
      CAST(page_id % 3 + 100 AS INTEGER) AS gid,
      'user' || CAST(page_id % 5 + 1000 AS VARCHAR) AS "user",
      'group' || CAST(page_id % 3 + 100 AS VARCHAR) AS "group",
      CAST({BASE_MTIME} + page_id * 3600 AS BIGINT) AS mtime,
      CAST({BASE_MTIME} + page_id * 3600 + (page_id * 7919) % (86400 * 30) AS BIGINT) AS atime
    FROM pages"""


FLOW_BASE_SQL = """SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY 1, 2"""


LINEAGE_SQL = """SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation
  UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders
  UNION SELECT 'o' || l_orderkey, 'l' || l_orderkey || '-' || l_linenumber FROM lineitem
  UNION SELECT 'l' || l_orderkey || '-' || l_linenumber, 'p' || l_partkey FROM lineitem"""

EVENT_SQL = """SELECT DISTINCT src, dst FROM (
  SELECT event_type AS src, lead(event_type, 1, 'exit') OVER u AS dst FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)
  UNION ALL
  SELECT CASE WHEN row_number() OVER u = 1 THEN 'enter' END, event_type FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)
) x WHERE src IS NOT NULL AND src <> dst"""

PART_SQL = """SELECT DISTINCT src, dst FROM (
  SELECT l_partkey AS src,
         lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst
  FROM lineitem) t WHERE dst IS NOT NULL AND src <> dst"""

PARTB_SQL = f"""SELECT 'p' || src AS src, 'p' || dst AS dst FROM ({PART_SQL}) q
  UNION SELECT 'p' || p_partkey, p_brand FROM part"""


# ---------------------------------------------------------------- time series, vectors

def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> (ts, tag, value) points."""
    return table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("tag"), "value")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def lake_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a data-lake listing: one file per line under
    ``/warehouse/<flag>/<status>/<year>/<month>/<order>-<line>.dat``, size = price."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus",
                                                 "l_shipdate", "l_extendedprice", "l_quantity")
    path = F.concat(F.lit("/warehouse/"), F.col("l_returnflag"), F.lit("/"), F.col("l_linestatus"), F.lit("/"),
                    F.year("l_shipdate").cast("string"), F.lit("/"), F.month("l_shipdate").cast("string"), F.lit("/"),
                    F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"), F.lit(".dat"))
    return li.select(path.alias("path"), F.floor("l_extendedprice").alias("size"),
                     F.lit("regular file").alias("type"),
                     F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("mtime"),
                     F.floor("l_quantity").alias("quantity"))


LAKE_SQL = """SELECT '/warehouse/' || l_returnflag || '/' || l_linestatus || '/' || CAST(year(l_shipdate) AS VARCHAR)
    || '/' || CAST(month(l_shipdate) AS VARCHAR) || '/' || CAST(l_orderkey AS VARCHAR) || '-'
    || CAST(l_linenumber AS VARCHAR) || '.dat' AS path,
  CAST(floor(l_extendedprice) AS BIGINT) AS size, 'regular file' AS type,
  CAST(floor(epoch(l_shipdate)) AS BIGINT) AS mtime, CAST(floor(l_quantity) AS BIGINT) AS quantity
FROM lineitem"""
