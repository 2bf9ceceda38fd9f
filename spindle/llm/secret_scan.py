"""Secret scan (operator 8, native): known forms plus a randomness test battery.

Known forms are matched by pattern. Beyond them, every token of 16 or more
encoding characters is tested for being random in its inferred encoding (hex,
base32, upper or lower base36, base62, either base64): chi-squared uniformity over the
alphabet, runs above and below the alphabet's middle, and lag-1 serial
correlation, each as a standard score. Their squared sum ``t`` is small for
random tokens and large for words.

Which ``t`` counts as random is decided per length class under false-discovery
control. The null law of ``t`` for a length and an encoding is that of words:
letters drawn by their frequency in text (the order of letters in real words
only adds to ``t``). The chance of a ``t`` as small under it is a token's
p-value, and the Benjamini-Hochberg bound over all tokens of the class picks
what counts as random, so no class needs words of its own in the corpus. Short
tokens, which words can imitate, get a tighter bound than long ones. Statistics
are counts by class, encoding and bin of ``t``; the driver reads that grid and
draws the law from a fixed seed, nothing else.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import stash, whole_text
from spindle.llm.spans import count_of, find_spans, joined, let, redact, tagged

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"              # maximal runs, so the length can stand in the pattern
TOKEN = r"[A-Za-z0-9+/_-]{16,}"
KINDS = ("assign", "access", "hex")
RATE = 0.05                         # false-discovery rate of each length class
CEILING = 16.27                     # 99.9 % quantile of t for random tokens (chi-squared, 3 degrees)
BINS, BIN = 66, 0.25                # grid of t
DRAWS = 50_000                      # words drawn for a null law
LONGEST = 64                        # their length at most: t of words grows with length, so p-values of longer tokens are bounds

# fixed values: alphabets by encoding
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "upper36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "url64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "any66": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}

#: Rank of each ASCII character in its encoding's alphabet (hex in either case), and the alphabets' sizes, as map literals.
_RANK = {e: [(a.find(chr(i).lower() if e == "hex" else chr(i))) for i in range(128)] for e, a in ALPHABETS.items()}


def _literals() -> tuple[Column, Column]:
    pairs = [(F.lit(e), F.array(*map(F.lit, r)), F.lit(float(len(ALPHABETS[e])))) for e, r in _RANK.items()]
    return (F.create_map(*[x for e, r, _ in pairs for x in (e, r)]), F.create_map(*[x for e, _, n in pairs for x in (e, n)]))


#: Letters a to z in 100,000 letters of English text.
LETTERS = (8167, 1492, 2782, 4253, 12702, 2228, 2015, 6094, 6966, 153, 772, 4025, 2406, 6749, 7507, 1929, 95, 5987, 6327, 9056, 2758, 978, 2360,
           150, 1974, 74)


def base_spans(text: Column) -> Column:
    assign = find_spans(text, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 12)
    access = find_spans(text, ACCESS, lambda m: F.length(m) >= 18)
    found = [tagged(s, k, i) for i, (k, s) in enumerate(zip(KINDS, (assign, access, find_spans(text, HEX)), strict=True))]
    return F.array_sort(F.concat(*found))


def battery(tokens: Column) -> Column:
    """Tokens (spans) with their encoding, ``t`` and the length class."""
    ranks, sizes = _literals()

    def encoding(s: Column) -> Column:
        return (F.when(s.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit("hex")).when(s.rlike("^[A-Z2-7]+$"), F.lit("base32"))
                 .when(s.rlike("^[A-Z0-9]+$"), F.lit("upper36")).when(s.rlike("^[a-z0-9]+$"), F.lit("lower36"))
                 .when(s.rlike("^[A-Za-z0-9]+$"), F.lit("base62")).when(s.rlike("^[A-Za-z0-9+/]+$"), F.lit("base64"))
                 .when(s.rlike("^[A-Za-z0-9_-]+$"), F.lit("url64")).otherwise(F.lit("any66")))

    def struct(c: Column, *keep: str, **new: Column) -> Column:
        return F.struct(*[c[k].alias(k) for k in keep], *[v.alias(k) for k, v in new.items()])

    def total(xs: Column, f) -> Column:
        return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + f(x))

    def pairs(xs: Column) -> Column:
        """Sum of the squared counts of the values, off the sorted array."""
        zero = F.struct(F.lit(-1).alias("v"), F.lit(0.0).alias("n"), F.lit(0.0).alias("sum"))
        return F.aggregate(F.array_sort(xs), zero, lambda a, v: let(F.when(a["v"] == v, a["n"]).otherwise(F.lit(0.0)), lambda n: F.struct(
            v.alias("v"), (n + 1).alias("n"), (a["sum"] + 2 * n + 1).alias("sum"))), lambda a: a["sum"])

    place = ("start", "end", "value", "e")
    high = lambda c, i: 2 * F.get(c["x"], i) >= c["k"]
    steps = [
        lambda c: struct(c, "start", "end", "value", e=encoding(c["value"])),
        lambda c: struct(c, *place, k=F.element_at(sizes, c["e"]), x=F.transform(
            F.split(c["value"], ""), lambda x: F.get(F.element_at(ranks, c["e"]), F.ascii(x)))),
        lambda c: struct(c, *place, "k", "x", n=F.size(c["x"]).cast("double"), m=total(c["x"], lambda v: v.cast("double")) / F.size(c["x"]),
                         hi=F.size(F.filter(c["x"], lambda v: 2 * v >= c["k"])).cast("double")),
        lambda c: struct(c, *place, "k", "n", "hi", chi=c["k"] / c["n"] * pairs(c["x"]) - c["n"],
                         runs=1 + total(F.sequence(F.lit(1), (c["n"] - 1).cast("int")), lambda i: (high(c, i) != high(c, i - 1)).cast("double")),
                         var=total(c["x"], lambda v: (v - c["m"]) * (v - c["m"])),
                         lag=total(F.sequence(F.lit(1), (c["n"] - 1).cast("int")),
                                   lambda i: (F.get(c["x"], i) - c["m"]) * (F.get(c["x"], i - 1) - c["m"]))),
        lambda c: struct(c, *place, "n", z1=_uniformity(c["chi"], c["k"] - 1), z2=_runs(c["runs"], c["hi"], c["n"]),
                         z3=F.when(c["var"] > 0, c["lag"] / c["var"] * F.sqrt(c["n"])).otherwise(F.lit(10.0))),
        lambda c: struct(c, *place, t=F.pow(F.greatest(c["z1"], F.lit(0.0)), F.lit(2.0)) + c["z2"] * c["z2"] + c["z3"] * c["z3"],
                         cls=F.floor(2 * F.log2(c["n"])).cast("int")),
    ]
    # Tokens of digits alone are decided without counting: numbers that people write are
    # uniform over the digits, too, so under their null law no p-value is small.
    tokens = F.filter(tokens, lambda c: c["value"].rlike("[A-Za-z]"))
    for s in steps:
        tokens = F.transform(tokens, s)
    return tokens


def _uniformity(chi: Column, df: Column) -> Column:
    """Standard score of a chi-squared value (Wilson-Hilferty)."""
    return (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - F.lit(2.0) / (9 * df))) / F.sqrt(F.lit(2.0) / (9 * df))


def _runs(runs: Column, hi: Column, n: Column) -> Column:
    """Standard score of the number of runs (Wald-Wolfowitz)."""
    both = 2 * hi * (n - hi)
    return F.when(both > 0, (runs - both / n - 1) / F.sqrt(F.greatest(both * (both - n) / (n * n * (n - 1)), F.lit(1e-9)))).otherwise(F.lit(10.0))


@lru_cache(maxsize=None)
def null_law(cls: int, encoding: str) -> np.ndarray:
    """Sorted ``t`` of drawn words of the class' smallest length in the encoding."""
    n = min(math.ceil(2 ** (cls / 2) - 1e-9), LONGEST)
    alphabet = ALPHABETS[encoding]
    upper = encoding in ("base32", "upper36")
    at = np.array([alphabet.find(chr((65 if upper else 97) + i)) for i in range(26)])
    weight = np.where(at >= 0, LETTERS, 0).astype(float)
    k = len(alphabet)
    x = at[np.random.default_rng(cls).choice(26, (DRAWS, n), p=weight / weight.sum())]
    counts = np.bincount((np.arange(DRAWS)[:, None] * k + x).ravel(), minlength=DRAWS * k).reshape(DRAWS, k).astype(float)
    chi, df = k / n * (counts ** 2).sum(1) - n, k - 1
    z1 = (np.cbrt(np.maximum(chi, 0) / df) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df))
    high = 2 * x >= k
    hi, runs = high.sum(1), 1 + (high[:, 1:] != high[:, :-1]).sum(1)
    both = 2.0 * hi * (n - hi)
    z2 = np.where(both > 0, (runs - both / n - 1) / np.sqrt(np.maximum(both * (both - n) / (n * n * (n - 1)), 1e-9)), 10.0)
    d = x - x.mean(1, keepdims=True)
    var, lag = (d * d).sum(1), (d[:, 1:] * d[:, :-1]).sum(1)
    z3 = np.where(var > 0, lag / np.where(var > 0, var, 1) * np.sqrt(n), 10.0)
    return np.sort(np.maximum(z1, 0) ** 2 + z2 ** 2 + z3 ** 2)


def thresholds(tokens: DataFrame, rate: float = RATE) -> dict[tuple[int, str], float]:
    """Largest accepted ``t`` by length class and encoding, by Benjamini-Hochberg over the
    p-values of the class' tokens (of a bin of ``t`` its upper end's)."""
    grid = (tokens.select(F.explode("tokens").alias("c")).select("c.*")
                  .groupBy("cls", "e", F.least(F.floor(F.col("t") / BIN), F.lit(BINS)).cast("int").alias("bin"))
                  .agg(F.count(F.lit(1)).alias("n")).collect())  # at most BINS + 1 bins for each encoding and class
    limits: dict[tuple[int, str], float] = {}
    for cls in sorted({r["cls"] for r in grid}):
        cells = []
        for r in grid:
            if r["cls"] == cls and r["bin"] < BINS:
                law = null_law(cls, r["e"])
                cells.append(((np.searchsorted(law, (r["bin"] + 1) * BIN, side="right") + 1) / (len(law) + 1), r["e"], r["bin"], r["n"]))
        total, cut = sum(r["n"] for r in grid if r["cls"] == cls), 0.0
        for p, *_ in sorted(cells):
            if p * total <= rate * sum(m for q, _, _, m in cells if q <= p):
                cut = p
        for p, e, i, _ in cells:
            if p <= cut:
                limits[cls, e] = max(limits.get((cls, e), 0.0), min(CEILING, (i + 1) * BIN))
    return limits


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry_text: bool = False) -> DataFrame:
    """One row per input row: ``doc_id``, ``base`` and ``spans`` (sorted span structs), and
    with ``carry_text`` the text.

    A null text is empty. Spans of kind ``random`` are the battery's; base spans
    always stay. An empty table gives no rows.
    """
    text = whole_text(text_col)
    cols = [F.col(id_col).alias("doc_id"), base_spans(text).alias("base"), battery(find_spans(text, TOKEN)).alias("tokens")]
    found = stash(df.select(*cols, *([text.alias("text")] if carry_text else [])), "secrets")
    limits = thresholds(found)
    none = F.array().cast(found.schema["base"].dataType)
    if limits:
        def random(c: Column) -> Column:
            cut = F.lit(-math.inf)
            for (k, e), t in sorted(limits.items()):
                cut = F.when((c["cls"] == k) & (c["e"] == e), F.lit(t)).otherwise(cut)
            return c["t"] <= cut
        none = tagged(F.filter("tokens", random), "random", len(KINDS))
    return found.withColumn("spans", F.array_sort(F.concat("base", none))).drop("tokens")


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = scan(df, id_col, text_col)
    return found.select(F.col("doc_id").alias(id_col), *[count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the text with every found secret replaced by its kind."""
    return scan(df, id_col, text_col, carry_text=True).select(
        F.col("doc_id").alias(id_col), redact(F.col("text"), F.col("spans")).alias(text_col))
