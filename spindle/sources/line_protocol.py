"""Line-protocol ingest (S1) and export (S2) as column expressions.

A point is ``measurement[,tag=value...] field=value[,field=value...] [ts_ns]``.
Parsing is three anchored regular expressions per line (head / fields /
timestamp, then the tag and field lists with ``regexp_extract_all``); no Python
per row. Tag values may be quoted and hold bare spaces (the reference's own
writer produces such lines), quotes are stripped and ``\\x`` escapes undone.
Lines whose head does not match are returned as rejects.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns. Line: head, fields, optional integer timestamp.
LINE_PATTERN = r'^((?:\\.|"(?:\\.|[^"\\])*"|[^ "\\])+) ((?:"(?:\\.|[^"\\])*"|\\.|[^ "\\])+)(?: (-?\d+))?$'
# Measurement: up to the first unescaped comma.
MEASUREMENT_PATTERN = r"^((?:\\.|[^,\\])+)"
# One tag (or field) key=value, value quoted or escaped-bare.
TAG_PATTERN = r'([^,= ]+)=("(?:\\.|[^"\\])*"|(?:\\.|[^, \\])+)'
FIELD_PATTERN = r'([^,= ]+)=("(?:\\.|[^"\\])*"|[^,]+)'

# The same languages written for the JVM engine: atomic groups over character
# runs, so a line is matched without per-character backtracking state
# (about 5x faster on long lines). They accept exactly the strings above.
LINE_PATTERN_JVM = r'^((?>\\.|"(?>\\.|[^"\\]+)*"|[^ "\\]+)+) ((?>"(?>\\.|[^"\\]+)*"|\\.|[^ "\\]+)+)(?: (-?\d+))?$'
MEASUREMENT_PATTERN_JVM = r"^((?>\\.|[^,\\]+)+)"
TAG_PATTERN_JVM = r'[^,= ]+=(?>"(?>\\.|[^"\\]+)*"|(?>\\.|[^, \\]+)+)'
FIELD_PATTERN_JVM = r'[^,= ]+=(?>"(?>\\.|[^"\\]+)*"|[^,]+)'
_SEP = "\u0001"  # part separator of the one-pass split (a control character, never in line text)


def _unescape(v: Column) -> Column:
    """Undo ``\\x`` escapes, line ends included (the regex only runs on values holding a backslash)."""
    lines = v
    for letter, char in (("n", "\n"), ("r", "\r")):  # an escape if an even number of backslashes stands before it
        lines = F.regexp_replace(lines, rf"(?<!\\)((?:\\\\)*)\\{letter}", f"$1{char}")
    return F.when(v.contains("\\"), F.regexp_replace(lines, r"\\(.)", "$1")).otherwise(v)


def _last_of_key(items: str, key) -> Column:
    """Of ``key=value`` items that repeat a key, the last."""
    def stays(kv, i):
        later = F.slice(items, i + 2, F.size(items))
        return ~F.exists(later, lambda x: key(x) == key(kv))
    return F.filter(items, stays)


def _unquote(v: Column) -> Column:
    quoted = v.startswith('"') & v.endswith('"') & (F.length(v) >= 2)
    inner = F.when(quoted, F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    return _unescape(inner)


def _once(df: DataFrame, cols: list) -> DataFrame:
    """Projection that later projections cannot inline (a one-row ``inline``):
    each expensive expression in ``cols`` is evaluated once per row, however
    often its result is referenced afterwards."""
    return df.select(F.inline(F.array(F.struct(*cols))))


def _pairs(text: Column, pattern: str) -> Column:
    """``key=value`` items of a tag or field list in one regex pass; the key ends at the first '='."""
    return F.regexp_extract_all(text, F.lit(pattern), 0)


def parse_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Adds ``measurement``, ``tags`` (map), ``fields`` (map of raw text), ``ts_ns`` and ``ok``.

    One regex pass splits a line into head / fields / timestamp (a
    ``regexp_replace`` writing the three groups with a separator; a line that
    holds the separator itself is matched group by group), one pass finds the
    measurement, one pass lists the tag items and one the fields. Of a repeated
    tag or field key the last value counts. A line that does not match, has no
    field or a timestamp beyond 64 bits is not ``ok``; no line ends the job.
    """
    v = F.col(col)
    groups = F.array(*[F.regexp_extract(v, LINE_PATTERN_JVM, i) for i in (1, 2, 3)])
    parts = (F.when(~v.contains(_SEP), F.split(F.regexp_replace(v, LINE_PATTERN_JVM, f"$1{_SEP}$2{_SEP}$3"), _SEP))
              .when(v.rlike(LINE_PATTERN_JVM), groups))
    out = _once(lines, [*[F.col(c) for c in lines.columns], parts.alias("__p")])
    matched = F.coalesce(F.size("__p") == 3, F.lit(False))
    head = F.when(matched, F.col("__p")[0]).otherwise(F.lit(""))
    out = out.select(*lines.columns, head.alias("__head"),
                     F.when(matched, F.col("__p")[1]).alias("__fields"),
                     F.when(matched, F.col("__p")[2]).otherwise(F.lit("")).alias("__ts"))
    meas = F.regexp_extract("__head", MEASUREMENT_PATTERN_JVM, 1)
    tag_text = F.substring(F.col("__head"), F.length(meas) + 2, 1 << 30)
    tags = _pairs(tag_text, TAG_PATTERN_JVM)
    fields = _pairs(F.coalesce(F.col("__fields"), F.lit("")), FIELD_PATTERN_JVM)
    out = _once(out, [*[F.col(c) for c in lines.columns], F.col("__head"), F.col("__ts"), meas.alias("__meas"),
                      tags.alias("__tags"), fields.alias("__f")])

    def key(kv):
        return F.substring_index(kv, "=", 1)

    def val(kv):
        return F.substring(kv, F.length(key(kv)) + 2, 1 << 30)
    out = _once(out, [*[F.col(c) for c in lines.columns], F.col("__head"), F.col("__ts"), F.col("__meas"),
                      _last_of_key("__tags", lambda kv: _unescape(key(kv))).alias("__tags"), _last_of_key("__f", key).alias("__f")])
    ts = F.col("__ts").try_cast("long")
    return out.select(
        *lines.columns,
        ((F.col("__head") != "") & (F.size("__f") > 0) & ((F.col("__ts") == "") | ts.isNotNull())).alias("ok"),
        _unescape(F.col("__meas")).alias("measurement"),
        F.map_from_arrays(F.transform("__tags", lambda kv: _unescape(key(kv))),
                          F.transform("__tags", lambda kv: _unquote(val(kv)))).alias("tags"),
        F.map_from_arrays(F.transform("__f", key), F.transform("__f", val)).alias("fields"),
        ts.alias("ts_ns"),
    )


def read_line_protocol(lines: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Text lines -> (points(measurement, tags, fields, ts_ns), rejects(value))."""
    p = parse_lines(lines, col)
    points = p.filter("ok").select("measurement", "tags", "fields", "ts_ns")
    rejects = p.filter(~F.col("ok")).select(F.col(col).alias("value"))
    return points, rejects


def field_value(fields: str | Column, key: str, kind: str = "string") -> Column:
    """Typed view of one raw field (null where it does not fit): ``long`` (``123i``), ``double``, ``string`` (unquoted), ``boolean``."""
    f = F.col(fields) if isinstance(fields, str) else fields
    raw = f.getItem(key)
    if kind == "long":
        return F.regexp_replace(raw, "i$", "").try_cast("long")
    if kind == "double":
        return F.regexp_replace(raw, "i$", "").try_cast("double")
    if kind == "boolean":
        return F.lower(raw).isin("t", "true")
    return _unquote(raw)


def escape_tag(c: Column) -> Column:
    """Backslash, quote, comma, equals and space escaped (backslash first, so every
    value round-trips)."""
    out = F.regexp_replace(c.cast("string"), r"\\", r"\\\\")
    for ch in ('"', ",", "=", " "):
        out = F.regexp_replace(out, ch, "\\\\" + ch)
    return _line_ends(out)


def _line_ends(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def escape_field_string(c: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(c.cast("string"), r"\\", r"\\\\"), '"', '\\\\"')
    return F.concat(F.lit('"'), _line_ends(text), F.lit('"'))


def to_line_protocol(df: DataFrame, measurement: str, tags: Sequence[str] | Mapping[str, str],
                     fields: Mapping[str, str], ts_col: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One ``value`` text line per row.

    ``tags``: columns (or name -> column); ``fields``: name -> column; integer
    fields get the ``i`` suffix, strings are quoted, line ends escaped. Null
    tags/fields are left out; a row of nothing but null fields has no line
    (:func:`without_fields` gives these rows).
    ``keep``: columns carried next to the line.
    """
    tag_map = dict(tags) if isinstance(tags, Mapping) else {t: t for t in tags}
    types = dict(df.dtypes)
    tag_parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(escape_key(k) + "="), escape_tag(F.col(c))))
                 for k, c in tag_map.items()]
    field_parts = []
    for k, c in fields.items():
        t = types[c]
        if t in ("int", "bigint", "smallint", "tinyint"):
            val = F.concat(F.col(c).cast("string"), F.lit("i"))
        elif t in ("double", "float") or t.startswith("decimal"):
            val = F.col(c).cast("string")
        elif t == "boolean":
            val = F.when(F.col(c), "true").otherwise("false")
        else:
            val = escape_field_string(F.col(c))
        field_parts.append(F.when(F.col(c).isNotNull(), F.concat(F.lit(escape_key(k) + "="), val)))
    head = F.concat_ws(",", F.lit(escape_key(measurement)), *tag_parts)
    line = F.concat_ws(" ", head, F.concat_ws(",", *field_parts),
                       *([F.col(ts_col).cast("string")] if ts_col else []))
    return df.filter(F.coalesce(*[F.col(c).cast("string") for c in fields.values()]).isNotNull()).select(*keep, line.alias("value"))


def without_fields(df: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """The rows that :func:`to_line_protocol` cannot write: every field is null."""
    return df.filter(F.coalesce(*[F.col(c).cast("string") for c in fields.values()]).isNull())


def escape_key(k: str) -> str:
    return k.replace("\\", "\\\\").replace('"', '\\"').replace(",", "\\,").replace("=", "\\=").replace(" ", "\\ ")
