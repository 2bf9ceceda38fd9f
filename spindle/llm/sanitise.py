"""Personal data by pattern and by what reveals it (operator 10, native).

Protected entities are e-mail addresses, IP addresses, card and phone numbers.
Beyond them the corpus tells which terms give an entity away. In a document that
holds an entity ``c``, a term ``t`` discloses ``log(p(c|t) / p(c))`` of the
entity's information content ``log(1 / p(c))``, estimated from counts of whole
documents over the whole corpus. A document is no evidence against itself, so
the document at hand is left out of ``p(c|t)``, which is smoothed towards
``p(c)``: an entity or a term that stands in no other document discloses
nothing. Every occurrence, anywhere in the document, of a term that discloses at
least ``REMOVE`` of one of its entities is removed; one that discloses at least
``GENERALISE`` is generalised: a number keeps its leading half, another term
becomes the form it has (a name, a code, a word).

The bound ``p(c|t) <= (n_c - 1 + a p(c)) / (n_t - 1 + a)`` tells, before any pair
is made, which terms are too frequent to disclose ``c``; no other pair is left
out. Entities that stand in the same documents are one class, terms likewise,
and pairs are counted between classes, so a document of many entities, or many
copies of one, do not multiply them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import stash, whole_text
from spindle.llm.spans import bracketed, count_of, find_spans, joined, replaced, tagged

# Starts of runs only (or the end of the last match): the same matches, without a new try inside a run.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"[\p{L}\p{N}]{2,}+"
KINDS = ("email", "ip", "card", "phone")
PLAIN = "uncompressed"          # tables of many short rows: codecs' buffers outlast the tasks
SMOOTH = 1.0                    # documents of the prior in p(c|t)
REMOVE, GENERALISE = 0.9, 0.75


def _octets(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})$"))


def _luhn(m: Column) -> Column:
    digits = F.reverse(F.translate(m, " -", ""))

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, 1).cast("int") * (2 - i % 2)
        return acc + d - F.when(d > 9, F.lit(9)).otherwise(F.lit(0))

    ok = F.length(digits).between(12, 19)
    return ok & F.when(ok, F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def base_spans(text: Column) -> Column:
    found = (find_spans(text, EMAIL), find_spans(text, IP, _octets), find_spans(text, CARD, _luhn),
             find_spans(text, PHONE, lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)))
    return F.array_sort(F.concat(*[tagged(s, k, i) for i, (k, s) in enumerate(zip(KINDS, found, strict=True))]))


def _entity(b: Column) -> Column:
    return F.concat_ws(":", b["kind"], F.lower(b["value"]))


def _signature() -> list[Column]:
    """Which documents a group stands in, whatever their order: equal for equal sets."""
    return [F.bit_xor(F.xxhash64("row")).alias("h1"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("h2")]


def entity_classes(found: DataFrame) -> DataFrame:
    """Stored table ``row, c, n_c``: the classes of the entities of each document that stand
    in two documents or more."""
    own = found.filter(F.size("base") > 0).select("row", F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity"))
    shared = own.groupBy("entity").agg(F.count(F.lit(1)).alias("n_c"), *_signature()).filter("n_c > 1")
    return stash(own.join(shared, "entity").select("row", F.struct("h1", "h2").alias("c"), "n_c").distinct(), "pii-entities")


def occurrences(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Stored table ``row, term, start, end``: all terms of those documents outside the entities."""
    blank = replaced(F.col("text"), F.col("base"), lambda s, n: F.repeat(F.lit(" "), n))
    words = (found.join(rows, "row", "left_semi").select("row", blank.alias("text"))
                  .select("row", F.explode(find_spans(F.col("text"), TERM)).alias("w")))
    return stash(words.select("row", F.lower("w.value").alias("term"), "w.start", "w.end", "w.value"), "pii-terms", PLAIN)


def disclosing(df: DataFrame, classes: DataFrame, words: DataFrame, n: int, text_col: str = "text",
               least: float = GENERALISE, smooth: float = SMOOTH) -> DataFrame:
    """``row, term, share``: the terms of each document that disclose at least ``least``
    of an entity of it, and the largest share that they disclose."""
    p = F.col("n_c") / n
    # the most frequent term that can disclose so much of an entity of n_c documents
    most = (F.col("n_c") - 1 + smooth * p) / F.pow(p, F.lit(1 - least)) - smooth + 1 + 1e-9
    top = classes.agg(F.max(most)).first()[0]
    # counted before any join, so that frequent terms travel as one row a task
    counts = (df.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(whole_text(text_col)), F.lit(TERM), F.lit(0)))).alias("term"))
                .groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).filter((F.col("n_t") > 1) & (F.col("n_t") <= F.lit(top or 0.0))))
    own = stash(words.select("row", "term").distinct().join(counts, "term"), "pii-own", PLAIN)
    of = own.groupBy("term").agg(*_signature()).select("term", F.struct("h1", "h2").alias("t"))
    own = stash(own.join(of, "term"), "pii-classes", PLAIN)
    pairs = stash(classes.join(own.select("row", "t", "n_t").distinct(), "row").filter(F.col("n_t") <= most), "pii-pairs", PLAIN)
    given = (F.col("n_ct") - 1 + smooth * p) / (F.col("n_t") - 1 + smooth)
    joint = (pairs.groupBy("c", "t", "n_c", "n_t").agg(F.count(F.lit(1)).alias("n_ct")).filter((F.col("n_ct") > 1) & (F.col("n_c") < n))
                  .select("c", "t", "n_t", (F.log(given / p) / F.log(1 / p)).alias("share")).filter(F.col("share") >= least))
    told = pairs.join(joint, ["c", "t", "n_t"]).groupBy("row", "t", "n_t").agg(F.max("share").alias("share"))
    return own.join(told, ["row", "t", "n_t"]).select("row", "term", "share")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry_text: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, base, spans`` (sorted span structs; the method's
    have the kinds ``removed`` and ``generalised``).

    A null text is empty; an entity that stands in every document has no
    information to disclose. Rows that repeat an identifier, or an identifier and a
    text, are documents of their own. An empty table gives no rows.
    """
    text = whole_text(text_col)
    src = df.select(F.col(id_col).alias("doc_id"), text.alias("text"), base_spans(text).alias("base"))
    kept = F.col("text") if carry_text else F.when(F.size("base") > 0, F.col("text"))
    found = stash(src.select("doc_id", "base", kept.alias("text"), F.monotonically_increasing_id().alias("row")), "pii")
    classes = entity_classes(found)
    words = occurrences(found, classes.select("row").distinct())
    shares = disclosing(df, classes, words, found.count(), text_col)
    removed = F.col("share") >= REMOVE
    extra = words.join(shares, ["row", "term"]).groupBy("row").agg(F.collect_list(F.struct(
        "start", F.when(removed, F.lit(len(KINDS))).otherwise(F.lit(len(KINDS) + 1)).alias("rank"), "end",
        F.when(removed, F.lit("removed")).otherwise(F.lit("generalised")).alias("kind"), "value")).alias("extra"))  # of one text
    none = F.array().cast(found.schema["base"].dataType)
    return (found.join(extra, "row", "left")
                 .withColumn("spans", F.array_sort(F.concat("base", F.coalesce("extra", none)))).drop("row", "extra"))


def general(term: Column) -> Column:
    """The more general term: a number's leading half, else the form of the term."""
    half = F.ceil(F.length(term) / 2).cast("int")
    return (F.when(term.rlike(r"^[0-9]+$"), F.concat(F.substring(term, F.lit(1), half), F.repeat(F.lit("#"), F.length(term) - half)))
             .when(term.rlike(r"\p{N}"), F.lit("[CODE]")).when(term.rlike(r"^\p{Lu}"), F.lit("[NAME]")).otherwise(F.lit("[WORD]")))


def personal_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = scan(df, id_col, text_col)
    return found.select(F.col("doc_id").alias(id_col), *[count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def sanitised(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the text without entities and removed terms (their kind stands there)
    and with the more general term for those to generalise."""
    def by(span: Column, length: Column) -> Column:
        return F.when(span["kind"] == "generalised", general(span["value"])).otherwise(bracketed(span, length))

    return scan(df, id_col, text_col, carry_text=True).select(
        F.col("doc_id").alias(id_col), replaced(F.col("text"), F.col("spans"), by).alias(text_col))
