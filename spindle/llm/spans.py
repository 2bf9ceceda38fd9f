"""Match positions as column expressions: all non-overlapping matches of a pattern
with their code-point places, and span arrays as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"
CHUNK = 4096        # code points cut off a long text at once


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once (a lambda over a one-element array)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(numbers: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Inclusive prefix sums (or maxima, ...) of an array of integers from 0 on.

    Two levels of blocks of ``w`` (the cube root of the size): sums of blocks, of
    blocks of blocks, what stands before each, then the sums inside a block, so an
    array of ``n`` takes ``n * w / 2`` steps and nothing longer than itself is copied.
    """
    def total(a: Column, at: Column | int, n: Column) -> Column:
        return F.aggregate(F.slice(a, at + 1 if isinstance(at, Column) else F.lit(at + 1), n), F.lit(0), op)

    def of(a: Column) -> Column:
        w = F.greatest(F.ceil(F.cbrt(F.size(a))).cast("int"), F.lit(2))
        block = lambda i: F.floor(i / w).cast("int")
        sums = lambda x: F.transform(F.sequence(F.lit(0), block(F.size(x) - 1)), lambda j: total(x, j * w, w))
        return let(sums(a), lambda b1: let(sums(b1), lambda b2: let(
            F.transform(b2, lambda _, j: total(b2, 0, j)), lambda h2: let(
                F.transform(b1, lambda _, j: op(F.get(h2, block(j)), total(b1, block(j) * w, j % w))),
                lambda h1: F.transform(a, lambda _, i: op(F.get(h1, block(i)), total(a, block(i) * w, i % w + 1)))))))

    return let(numbers, lambda a: F.when(F.size(a) > 0, of(a)).otherwise(a))


def find_spans(text: Column, pattern: str, ok: Callable[[Column], Column] | None = None) -> Column:
    """``array<struct<start, end, value>>`` of the matches that ``ok`` accepts.

    The pieces between the matches (``split``) and the matches themselves give
    the places by running lengths; a text without a match is only tested.
    """
    none = F.array().cast(SPAN)

    def placed(hits: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        ends = running(F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h)), lambda p, q: p + q)
        return let(ends, lambda e: F.transform(hits, lambda h, i: F.struct(
            (F.get(e, i) - F.length(h)).alias("start"), F.get(e, i).alias("end"), h.alias("value"))))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    found = F.when(text.rlike(pattern), found).otherwise(none)
    return found if ok is None else F.filter(found, lambda s: ok(s["value"]))


def tagged(spans: Column, kind: str, rank: int) -> Column:
    """Spans as ``struct<start, rank, end, kind, value>``, which sort by start, then kind."""
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def replaced(text: Column, spans: Column, by: Callable[[Column, Column], Column]) -> Column:
    """The text with every span of the sorted ``spans`` replaced by ``by(span, length)``;
    spans that overlap are one, replaced as the first. Linear in the spans."""
    def cut(chunks: Column, width: Column, a: Column, b: Column) -> Column:
        """Code points ``a`` to ``b`` out of the chunks."""
        i, j = F.floor(a / width).cast("int"), F.floor(b / width).cast("int")
        return F.when(i == j, F.substring(F.get(chunks, i), a - i * width + 1, b - a)).otherwise(F.concat(
            F.substring(F.get(chunks, i), a - i * width + 1, width), F.array_join(F.slice(chunks, i + 2, j - i - 1), ""),
            F.coalesce(F.substring(F.get(chunks, j), F.lit(1), b - j * width), F.lit(""))))

    def pieces(s: Column, reach: Column, heads: Column, chunks: Column, size: Column) -> Column:
        width, n = size["width"], size["n"]
        end = lambda k: F.get(reach, F.coalesce(F.get(heads, k + 1), F.size(s)) - 1)
        before = F.transform(heads, lambda h, k: let(F.get(s, h), lambda x: F.concat(
            cut(chunks, width, F.when(k > 0, end(k - 1)).otherwise(F.lit(0)), x["start"]), by(x, end(k) - x["start"]))))
        return F.concat(F.array_join(before, ""), cut(chunks, width, end(F.size(heads) - 1), n))

    def run(s: Column) -> Column:
        # the length is counted once: it takes a pass over the text
        size = let(F.length(text), lambda n: F.struct(n.alias("n"), F.greatest(F.lit(CHUNK), F.ceil(F.sqrt(n)).cast("int")).alias("width")))
        chunks = lambda z: F.transform(F.sequence(F.lit(0), F.floor(z["n"] / z["width"]).cast("int")),
                                       lambda i: F.substring(text, i * z["width"] + 1, z["width"]))
        heads = lambda reach: F.filter(F.sequence(F.lit(0), F.size(s) - 1),
                                       lambda i: (i == 0) | (F.get(s, i)["start"] >= F.get(reach, i - 1)))
        return let(size, lambda z: let(chunks(z), lambda c: let(
            running(F.transform(s, lambda x: x["end"]), lambda p, q: F.greatest(p, q)), lambda reach: let(
                heads(reach), lambda h: pieces(s, reach, h, c, z)))))

    return F.when(F.size(spans) > 0, let(spans, run)).otherwise(text)


def bracketed(span: Column, length: Column) -> Column:
    return F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets."""
    return replaced(text, spans, bracketed)
