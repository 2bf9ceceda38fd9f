"""Data-quality rules, column reconciliation and masking.

All rules of one ``check`` call are evaluated in a single aggregate pass over
the frame (one scan, one tiny result), then unpivoted to
``(rule, pass_count, fail_count)`` rows. Membership against a value list is a
literal ``isin`` for short lists and a join against a value DataFrame
otherwise (broadcast chosen by AQE from its measured size).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """One quality rule.

    kind: ``not_null`` (cols), ``in_list`` (cols[0], values), ``pair_match``
    (cols paired with ``other``), ``cond_not_null`` (cols[0] under ``when``).
    pass/fail: not null/null; in/not in (null counts as not in); match/non-match
    (a null side is a non-match); not null/null among rows meeting ``when``.
    """
    name: str
    kind: str
    cols: tuple[str, ...]
    values: tuple = ()
    other: tuple[str, ...] = ()
    when: Column | None = field(default=None, compare=False)


def _rule_aggs(r: Rule) -> tuple[Column, Column]:
    if r.kind == "not_null":
        bad = sum((F.count_if(F.col(c).isNull()) for c in r.cols), F.lit(0))
        good = sum((F.count_if(F.col(c).isNotNull()) for c in r.cols), F.lit(0))
    elif r.kind == "in_list":
        inside = F.coalesce(F.col(r.cols[0]).isin(list(r.values)), F.lit(False))
        good, bad = F.count_if(inside), F.count_if(~inside)
    elif r.kind == "pair_match":
        eqs = [F.coalesce(F.col(a) == F.col(b), F.lit(False)) for a, b in zip(r.cols, r.other, strict=True)]
        good = sum((F.count_if(e) for e in eqs), F.lit(0))
        bad = sum((F.count_if(~e) for e in eqs), F.lit(0))
    elif r.kind == "cond_not_null":
        cond = F.coalesce(r.when, F.lit(False))
        good = F.count_if(cond & F.col(r.cols[0]).isNotNull())
        bad = F.count_if(cond & F.col(r.cols[0]).isNull())
    else:
        raise ValueError(f"unknown rule kind {r.kind}")
    return good.cast("long"), bad.cast("long")


def check(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Evaluate all rules in one pass -> (rule, pass_count, fail_count)."""
    aggs = []
    for i, r in enumerate(rules):
        g, b = _rule_aggs(r)
        aggs += [g.alias(f"p{i}"), b.alias(f"f{i}")]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"p{i}").alias("pass_count"),
                              F.col(f"f{i}").alias("fail_count")) for i, r in enumerate(rules)])
    return wide.select(F.inline(rows))


def family(df: DataFrame, prefix: str) -> tuple[str, ...]:
    return tuple(c for c in df.columns if c.startswith(prefix))


def fill_missing(df: DataFrame, prefix: str, value: str = "Not Applicable", treat_blank: bool = False) -> DataFrame:
    """Replace missing cells of the ``prefix`` column family; blanks too if asked."""
    cols = family(df, prefix)
    out = df
    for c in cols:
        cur = F.col(c).cast("string")
        missing = cur.isNull() | (F.trim(cur) == "") if treat_blank else cur.isNull()
        out = out.withColumn(c, F.when(missing, F.lit(value)).otherwise(cur))
    return out


def _member(df: DataFrame, col: str, values: Sequence | DataFrame, flag: str) -> DataFrame:
    """Adds boolean ``flag``: df[col] is in values (literal list or one-column DataFrame)."""
    if isinstance(values, DataFrame):
        vals = values.select(values.columns[0]).distinct().withColumnRenamed(values.columns[0], "__v") \
                     .withColumn(flag, F.lit(True))
        out = df.join(vals, F.col(col) == F.col("__v"), "left").drop("__v")
        return out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    return df.withColumn(flag, F.coalesce(F.col(col).isin(list(values)), F.lit(False)))


def flag_member(df: DataFrame, col: str, values: Sequence | DataFrame, out: str = "matched_or_not") -> DataFrame:
    """D6: 'Yes' / 'No' membership flag."""
    m = _member(df, col, values, "__m")
    return m.withColumn(out, F.when(F.col("__m"), "Yes").otherwise("No")).drop("__m")


def first_match(df: DataFrame, cols: Sequence[str], values: Sequence | DataFrame, out: str = "match_src") -> DataFrame:
    """Name of the first column whose value is in ``values``, else null."""
    m = df
    for i, c in enumerate(cols):
        m = _member(m, c, values, f"__m{i}")
    expr = F.lit(None).cast("string")
    for i, c in reversed(list(enumerate(cols))):
        expr = F.when(F.col(f"__m{i}"), F.lit(c)).otherwise(expr)
    return m.withColumn(out, expr).drop(*[f"__m{i}" for i in range(len(cols))])


def element_metadata(df: DataFrame, groups: Sequence[Mapping[str, str]]) -> DataFrame:
    """Rename each column group to one schema, union, distinct."""
    parts = [df.select(*[F.col(src).alias(dst) for src, dst in g.items()]) for g in groups]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def reconcile(df: DataFrame, cols: Sequence[str], values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Input values against the union of ``cols``.

    Returns (per_value(value, matched), summary(metric, n)) with metrics
    ``matches_<col>``, ``matched_inputs``, ``unmatched_inputs`` (absent when 0).
    Column matches follow the first-match rule of D7.
    """
    vname = values.columns[0]
    vals = values.select(F.col(vname).alias("value")).distinct()
    pool = None
    for c in cols:
        s = df.select(F.col(c).alias("value"))
        pool = s if pool is None else pool.unionByName(s)
    present = pool.distinct().withColumn("matched", F.lit(True))
    per_value = (vals.join(present, "value", "left")
                     .select("value", F.coalesce("matched", F.lit(False)).alias("matched")))
    flags = first_match(df.select(*cols), cols, values.select(vname))
    col_counts = flags.groupBy("match_src").agg(F.count(F.lit(1)).alias("n")).filter(F.col("match_src").isNotNull()) \
                      .select(F.concat(F.lit("matches_"), "match_src").alias("metric"), "n")
    input_counts = per_value.groupBy(F.when(F.col("matched"), "matched_inputs").otherwise("unmatched_inputs")
                                     .alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    return per_value, col_counts.unionByName(input_counts)


def first_row(df: DataFrame, part: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per group by an order (``row_number() = 1``; Catalyst turns
    the filter into a per-partition group limit before the shuffle)."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def lookup_first(df: DataFrame, details: DataFrame, key: str, order: str, keep: Sequence[str],
                 left_key: str | None = None) -> DataFrame:
    """Left join to details deduplicated to their first row per key (null if unknown)."""
    d = first_row(details, [key], [order]).select(key, *keep)
    lk = left_key or key
    if lk == key:
        return df.join(d, key, "left")
    return df.join(d, F.col(lk) == F.col(key), "left").drop(key)


def mask(df: DataFrame, methods: Mapping[str, str]) -> DataFrame:
    """Per column ``sha256`` / ``sha512`` fingerprints or reversible ``base64``."""
    out = df
    for c, how in methods.items():
        if how == "sha256":
            out = out.withColumn(f"{c}_sha256", F.sha2(F.col(c).cast("string"), 256))
        elif how == "sha512":
            out = out.withColumn(f"{c}_sha512", F.sha2(F.col(c).cast("string"), 512))
        elif how == "base64":
            out = out.withColumn(f"{c}_b64", F.base64(F.encode(F.col(c).cast("string"), "UTF-8")))
        else:
            raise ValueError(how)
    return out


def unmask_base64(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.decode(F.unbase64(c), "UTF-8")
