"""SQL-text table references (G35) and stitching per-script graphs.

A corpus job, not a per-script parser: ``regexp_extract_all`` over the text
column, ``explode``, and a union. Stitching keeps scripts and resources as
nodes (script -> resource for writes, resource -> script for reads), which is
linear in the references; the writer-to-reader dependency is the two-hop
path through the shared resource, never materialised as all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A name part: bare, or quoted (then it may hold any character but its quote).
PART = r'(?:[A-Za-z_][A-Za-z0-9_$]*|"[^"]+"|`[^`]+`|\'[^\']+\'|\[[^\]]+\])'
NAME = rf"{PART}(?:\.{PART})*"
# The table after FROM / JOIN is read, after INSERT INTO / UPDATE written;
# the database is what a URL has between its host and ``?``.
READ_PATTERN = rf"(?i)(?:^|[^A-Za-z0-9_])(?:from|join)[ \t\r\n]+({NAME})"
WRITE_PATTERN = rf"(?i)(?:^|[^A-Za-z0-9_])(?:insert[ \t\r\n]+into|update)[ \t\r\n]+({NAME})"
URL_DB_PATTERN = r"(?i)[a-z][a-z0-9+.-]*://[^/?# \t\r\n]+/([^?# \t\r\n]+)"


def sql_references(corpus: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, table, direction)`` for every table reference in every text, quotes removed."""
    t = F.col(text_col)

    def bare(name: Column) -> Column:
        return F.regexp_replace(name, "[\"`'\\[\\]]", "")

    reads = corpus.select(F.col(id_col).alias("id"),
                          F.explode(F.transform(F.regexp_extract_all(t, F.lit(READ_PATTERN), 1), bare)).alias("table"),
                          F.lit("read").alias("direction"))
    writes = corpus.select(F.col(id_col).alias("id"),
                           F.explode(F.transform(F.regexp_extract_all(t, F.lit(WRITE_PATTERN), 1), bare)).alias("table"),
                           F.lit("write").alias("direction"))
    return reads.unionByName(writes)


def database_from_url(url: str | Column) -> Column:
    u = F.col(url) if isinstance(url, str) else url
    return F.nullif(F.regexp_extract(u, URL_DB_PATTERN, 1), F.lit(""))


def stitch(refs: DataFrame, script: str = "id", resource: str = "table", direction: str = "direction") -> DataFrame:
    """One global graph ``(from, to, label)`` from per-script references:
    ``script -> resource`` labelled ``writes``, ``resource -> script`` labelled
    ``reads``; duplicates collapsed. Node ids are prefixed by kind so a script
    and a resource of the same name stay apart."""
    s = F.concat(F.lit("script:"), F.col(script).cast("string"))
    r = F.concat(F.lit("resource:"), F.col(resource).cast("string"))
    w = refs.filter(F.col(direction) == "write").select(s.alias("from"), r.alias("to"), F.lit("writes").alias("label"))
    rd = refs.filter(F.col(direction) == "read").select(r.alias("from"), s.alias("to"), F.lit("reads").alias("label"))
    return w.unionByName(rd).distinct()
