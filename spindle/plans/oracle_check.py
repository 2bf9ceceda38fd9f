"""Order-insensitive comparison of a Spark result with its DuckDB oracle
(row count, column names, value hash), as the correctness gate does it."""

from __future__ import annotations

import hashlib
import math

from spindle.plans.bindings import TABLES


def norm(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return f"{round(v, 4):.4f}"
    if isinstance(v, bool):
        return str(v).lower()
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


# Spark type name -> DuckDB type name of the same values
TYPE_NAMES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
              "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT", "date": "DATE",
              "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE"}


def compare(sdf, con, sql: str, check_types: bool = True) -> tuple[bool, str]:
    s_types = dict(sdf.dtypes)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_types = {d[0]: str(d[1]) for d in res.description}
    d_rows = res.fetchall()
    hs, ls = digest(s_cols, s_rows)
    hd, ld = digest(d_cols, d_rows)
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns {sorted(s_cols)} vs {sorted(d_cols)}"
    if check_types:
        diff = [(c, s_types[c], d_types.get(c)) for c in s_cols if TYPE_NAMES.get(s_types[c], s_types[c]) != d_types.get(c)]
        if diff:
            return False, f"types {diff}"
    if len(s_rows) != len(d_rows):
        return False, f"rows {len(s_rows)} vs {len(d_rows)}"
    if hs != hd:
        sd, dd = set(ls), set(ld)
        return False, f"values differ: spark-only {sorted(sd - dd)[:2]} duck-only {sorted(dd - sd)[:2]}"
    return True, f"{len(s_rows)} rows"
