"""Mixing sources to target weights (operator 5).

Every row gets a 60-bit hash of its identifier. Sizes are summed by source and
hash bucket (4096 buckets a level). A source whose target is ``q`` whole times
its size plus a rest takes every row ``q`` times, and once more the rows whose
hash lies below a threshold. The threshold comes from the histogram: the bucket
in which the running sum crosses the rest is the boundary, only the boundary
bucket's rows get the next finer histogram, and so on down to single hashes.
Selection is then a filter on the hash; no row is sorted or ranked. Thresholds
nest: a larger budget takes a superset.

The driver holds one row per source (its totals and its threshold); that table,
and nothing else, is broadcast, as long as it has no more than ``FEW`` rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindle.llm.common import stash, whole_text

WORD = r"[^\x20\x09-\x0D]+"
BITS, LEVEL = 60, 12
EPOCHS = 3
CYCLE = (5, 2, 1)
FEW = 50_000             # sources whose rows (about 150 bytes each) are broadcast


def n_words(text: str | Column) -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def id_hash(c: str | Column) -> Column:
    """60 bits of the identifier's md5 (a null identifier hashes as ``null``)."""
    col = F.col(c) if isinstance(c, str) else c
    text = F.coalesce(col.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def cycled_weights(sources: Sequence[str | None]) -> dict[str | None, int]:
    """5, 2, 1, repeating, over the sources by code point, null last."""
    order = sorted((s for s in sources if s is not None)) + [None] * (None in sources)
    return {s: CYCLE[i % len(CYCLE)] for i, s in enumerate(order)}


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], epochs: int = EPOCHS) -> dict[str | None, float]:
    """Shares of the total size by weight; a target stops at ``epochs`` times its
    source's size and the excess is shared again by weight until none is above."""
    out: dict[str | None, float] = {}
    rest, weight = sum(sizes.values()), sum(weights[s] for s in sizes)
    # the source that reaches its cap at the smallest share comes first
    for s in sorted(sizes, key=lambda s: (sizes[s] / weights[s], s is None, s or "")):
        if weight and epochs * sizes[s] * weight <= rest * weights[s]:
            out[s] = float(epochs * sizes[s])
            rest, weight = rest - epochs * sizes[s], weight - weights[s]
        else:
            out[s] = rest * weights[s] / weight
    return out


def _sized(per_source: DataFrame, rows: int) -> DataFrame:
    """Broadcast up to ``FEW`` rows; beyond, Spark joins by shuffle and splits hot sources."""
    return F.broadcast(per_source) if rows <= FEW else per_source


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Callable[[Sequence[str | None]], dict[str | None, float]] = cycled_weights,
        carry: list[str] | None = None) -> DataFrame:
    """Per input row: ``__id, size, source_size, target, taken, copies`` and ``__row``.

    ``taken`` counts words with repeats: the row of a boundary hash is cut, so a
    source's sum is its target rounded down (rows that repeat one identifier
    share the cut in proportion). ``copies`` is the same in whole rows, the
    boundary row rounded. A null source is a source of its own, a null text has
    size 0; an empty table gives no rows.
    """
    spark = df.sparkSession
    row = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(0)
    thin = stash(df.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"),
                           n_words(text_col).alias("size"), id_hash(id_col).alias("__h"), row.alias("__row")), "mix")
    total = {r["__source"]: r["z"] for r in thin.groupBy("__source").agg(F.sum("size").alias("z")).collect()}
    target = targets(total, weights(list(total)))
    plan = {}
    for s, z in total.items():
        q = min(EPOCHS, int(target[s] // z)) if z else 0
        plan[s] = {"source_size": z, "target": target[s], "q": q, "rest": target[s] - q * z, "below": 0.0, "prefix": 0, "cell": z}
    open_ = [s for s in plan if plan[s]["rest"] > 0]
    for shift in range(BITS - LEVEL, -1, -LEVEL):
        if not open_:
            break
        state = spark.createDataFrame([(s, plan[s]["prefix"], plan[s]["rest"] - plan[s]["below"]) for s in open_],
                                      "s string, prefix long, budget double")
        h = thin.select("__source", "__h", "size").join(_sized(state, len(open_)), F.col("__source").eqNullSafe(F.col("s")))
        if shift < BITS - LEVEL:  # the boundary bucket alone
            h = h.filter(F.shiftright("__h", shift + LEVEL) == F.col("prefix"))
        hist = h.groupBy("s", F.shiftright("__h", shift).alias("b")).agg(
            F.sum("size").alias("z"), F.first("budget").alias("budget"),
            (F.min("__h") == F.max("__h")).alias("single"))
        w = Window.partitionBy("s").orderBy("b")  # at most 2^LEVEL rows a source
        cross = (hist.withColumn("below", F.sum("z").over(w) - F.col("z"))
                     .filter((F.col("below") <= F.col("budget")) & (F.col("below") + F.col("z") > F.col("budget")) & (F.col("z") > 0)))
        open_ = []
        for r in cross.collect():
            p = plan[r["s"]]
            p["below"] += r["below"]
            p["prefix"], p["cell"], p["shift"] = r["b"], r["z"], shift
            if not r["single"]:
                open_.append(r["s"])
    for p in plan.values():  # hash interval of the boundary; rest == 0 takes nothing once more
        shift = p.get("shift", BITS)
        p["lo"] = p["prefix"] << shift if p["rest"] > 0 else 0
        p["hi"] = ((p["prefix"] + 1) << shift) if p["rest"] > 0 else 0
    bounds = spark.createDataFrame(
        [(s, p["source_size"], p["target"], p["q"], p["lo"], p["hi"], p["rest"] - p["below"], float(p["cell"] or 1))
         for s, p in plan.items()],
        "s string, source_size long, target double, q long, lo long, hi long, part double, cell double")
    j = thin.join(_sized(bounds, len(plan)), F.col("__source").eqNullSafe(F.col("s")))
    once, edge = F.col("__h") < F.col("lo"), (F.col("__h") >= F.col("lo")) & (F.col("__h") < F.col("hi"))
    share = F.col("part") * (F.col("size") / F.col("cell"))
    return j.select(
        "__id", "__row", "size", "source_size", "target",
        (F.col("q") * F.col("size") + F.when(once, F.col("size")).when(edge, F.floor(share)).otherwise(F.lit(0))).cast("long").alias("taken"),
        (F.col("q") + F.when(once, F.lit(1)).when(edge & (F.col("part") / F.col("cell") >= 0.5), F.lit(1)).otherwise(F.lit(0))).cast("int").alias("copies"))


def mixed_sizes(df: DataFrame) -> DataFrame:
    return mix(df).select(F.col("__id").alias("doc_id"), "size", "source_size", "target", "taken")


def mixed_rows(df: DataFrame, **kw) -> DataFrame:
    """The input's rows and columns, each as often as the mix takes it."""
    m = mix(df, carry=df.columns, **kw)
    return (m.filter("copies > 0")
             .select("__row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy")).select("__row.*"))
