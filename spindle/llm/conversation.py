"""Conversation structure repair by a run-length dynamic program (operator 13).

A conversation's roles must read ``(s?(ua)+)?``. Rows may be kept, given
another role, deleted, or preceded by inserted empty turns, at a cost each; the
cheapest repair is wanted and of equally cheap ones that whose audit (the edits'
initials) is least in ASCII order.

Only a row's role initial and fault matter, so a conversation is a string over
nine symbols. Equal consecutive symbols are one run; a symbol's edits are a 4 x 4
matrix over the states of the pattern in min-plus algebra, and a run of ``n`` is
the matrix' ``n``-th power, put together from cached binary powers. Costs to go
come from the end, run by run; then the choices are unrolled from the start:
inside a run by halving it, so the costs to go of its middle come from a cached
power again.

Spark orders the rows by a range shuffle on (conversation, turn, ...), so a
conversation of any size is spread over ranges. A range solves the conversations
that lie inside it; for one that goes over its ends it gives the product of its
runs, at most two a range, from which the driver gets the costs to go at each
range's end. What the ranges did is put back to the rows by their place in the
order. The hash of a repaired conversation streams over its rows in order and
holds none of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import partitions, stash, tidy

# What an edit costs.
RENAME, DELETE, INSERT, CUT = 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
ROLES = {"u": "user", "a": "assistant"}
SYMBOLS = 9              # 0: must be deleted; 1 to 4: s, u, a, other; 5 to 8: the same, truncated
START, SYSTEM, USER, DONE = range(4)   # nothing yet; after s; after u; after a
FAR = np.int64(1) << 60
#: state -> {role initial: next state}
STEPS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": DONE}, DONE: {"u": USER}}


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product with a matrix or a vector; ``FAR`` is out of reach."""
    return np.minimum((a + b).min(1) if b.ndim == 1 else (a[:, :, None] + b).min(1), FAR)


def _inserts() -> np.ndarray:
    """Costs of going from state to state by inserted turns alone."""
    one = np.full((4, 4), FAR)
    for s, steps in STEPS.items():
        for r, t in steps.items():
            if r in ROLES:
                one[s, t] = INSERT
    out = np.where(np.eye(4, dtype=bool), 0, FAR)
    for _ in range(4):
        out = np.minimum(out, product(out, one))
    return out


INSERTS = _inserts()
STOP = product(INSERTS, np.array([0, FAR, FAR, 0]))   # costs to go behind the last row


def options(symbol: int, state: int) -> Iterator[tuple[str, int, int, str]]:
    """Edits of a row in a state: initial, cost, next state, new role's initial."""
    yield "D", DELETE, state, ""
    if symbol == 0:
        return
    own, cut = "sua-"[(symbol - 1) % 4], CUT if symbol > 4 else 0
    for r, t in STEPS[state].items():
        if r == own:
            yield "K", cut, t, r
        elif r in ROLES:
            yield "R", RENAME + cut, t, r


@lru_cache(maxsize=None)
def power(symbol: int, k: int) -> np.ndarray:
    """Matrix of ``2^k`` equal rows, inserted turns before them included."""
    if k:
        half = power(symbol, k - 1)
        return product(half, half)
    edit = np.full((4, 4), FAR)
    for s in STEPS:
        for _, cost, t, _ in options(symbol, s):
            edit[s, t] = min(edit[s, t], cost)
    return product(INSERTS, edit)


def advance(symbol: int, n: int, costs: np.ndarray) -> np.ndarray:
    """``costs`` (a vector, or a matrix) carried over a run of ``n``, by its binary powers."""
    k = 0
    while n >> k:
        if n >> k & 1:
            costs = product(power(symbol, k), costs)
        k += 1
    return costs


def runs(symbols: np.ndarray) -> list[tuple[int, int]]:
    """Equal consecutive symbols as (symbol, length)."""
    if not len(symbols):
        return []
    at = np.flatnonzero(np.diff(symbols)) + 1
    edges = np.concatenate([[0], at, [len(symbols)]])
    return [(int(symbols[a]), int(b - a)) for a, b in zip(edges, edges[1:])]


def whole(symbols: np.ndarray) -> np.ndarray:
    """Matrix of a string of rows."""
    out = np.where(np.eye(4, dtype=bool), 0, FAR)
    for symbol, n in reversed(runs(symbols)):
        out = advance(symbol, n, out)
    return out


@lru_cache(maxsize=100_000)
def _choose(symbol: int, state: int, after: bytes) -> tuple[str, str, int]:
    """The least cheapest choice at one row: audit, roles put out, next state. Only the
    differences of the costs to go ``after`` the row matter, so few cases come up."""
    after = np.frombuffer(after, np.int64)
    before = product(power(symbol, 0), after)
    audit, roles, total = "", "", int(before[state])
    while True:
        choices = [(e, cost, t, r, int(after[t])) for e, cost, t, r in options(symbol, state)]
        choices += [("I", INSERT, t, r, int(before[t])) for r, t in STEPS[state].items() if r in ROLES]
        initial, cost, state, r, total = min(x for x in choices if x[1] + x[4] == total)
        audit, roles = audit + initial, roles + r
        if initial != "I":
            return audit, roles, state


def unroll(symbols: np.ndarray, state: int, after: np.ndarray) -> tuple[list[tuple[str, str]], int]:
    """Per row its audit (inserts before it, then its own edit) and the roles put out, and
    the state behind the last row. ``after``: costs to go there."""
    out: list[tuple[str, str]] = []
    todo: list[tuple[int, int, np.ndarray]] = []  # runs, the next one last
    for symbol, n in reversed(runs(symbols)):
        todo.append((symbol, n, after))
        after = advance(symbol, n, after)
    while todo:
        symbol, n, behind = todo.pop()
        if n > 1:  # halve the run: the costs to go of its middle come from powers
            half = 1 << (n - 1).bit_length() - 1
            todo.append((symbol, half, behind))
            todo.append((symbol, n - half, advance(symbol, half, behind)))
            continue
        audit, roles, state = _choose(symbol, state, (behind - behind.min()).tobytes())
        out.append((audit, roles))
    return out, state


def last_inserts(state: int) -> str:
    """Roles inserted behind the last row."""
    out = ""
    while state not in (START, DONE):
        (r, state), = ((r, t) for r, t in STEPS[state].items() if r in ROLES)
        out += r
    return out


def damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text`` of the rows after damage; a null role or text (and, in the
    hash, a null identifier or turn) is one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank(conv_col), blank(turn_col)).cast("binary")) % 20
    src = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), blank(role_col).alias("role"),
                    blank(text_col).alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return src.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
                      F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again")).drop("again")


def ordered(rows: DataFrame) -> DataFrame:
    """Stored table of the rows with their place ``at`` in the order of conversation, turn
    (nulls first), role and text, and their first ``fault``."""
    n = partitions(rows.sparkSession)
    by = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    placed = (rows.repartitionByRange(n, *by, F.substring("text", 1, 32)).sortWithinPartitions(*by, "text")
                  .withColumn("at", F.monotonically_increasing_id()))  # its upper bits are the range
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    placed = stash(placed.withColumn("blank", last == "").withColumn("cut", ~last.isin(*ENDS)).withColumn("digest", F.md5(F.col("text").cast("binary"))), "conversation-rows")
    # equal rows are counted before the shuffle; the join back is on the unique place
    first = placed.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    fault = F.when(F.col("blank"), F.lit("blank")).when(F.col("new").isNull(), F.lit("duplicate")).when(F.col("cut"), F.lit("truncated"))
    return placed.join(first, "at", "left").select("at", "conv_id", "turn", "role", "text", fault.alias("fault"))


def symbol(role: Column, fault: Column) -> Column:
    initial = F.substring(role, 1, 1)
    kind = F.when(initial == "s", F.lit(1)).when(initial == "u", F.lit(2)).when(initial == "a", F.lit(3)).otherwise(F.lit(4))
    return F.when(fault.isin("blank", "duplicate"), F.lit(0)).when(fault == "truncated", kind + 4).otherwise(kind)


def _segments(t: pa.Table) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
    """A range's conversations in order: identifier, places, symbols."""
    t = t.sort_by("at")
    conv, at, symbols = t["conv_id"].to_pylist(), t["at"].to_numpy(), t["symbol"].to_numpy()
    begin = 0
    for i in range(1, len(conv) + 1):
        if i == len(conv) or conv[i] != conv[begin]:
            yield conv[begin], at[begin:i], symbols[begin:i]
            begin = i


def edits(rows: DataFrame) -> DataFrame:
    """``conv_id, at, audit, roles, behind``: each row's audit, the roles it puts out, and
    those inserted behind a conversation's last row."""
    thin = stash(rows.select("at", F.shiftright("at", 33).alias("range"), "conv_id", symbol(F.col("role"), F.col("fault")).alias("symbol")), "conversation-symbols")
    by_range = thin.groupBy("range")

    def ends(found: list) -> list[tuple[int, bool, bool]]:
        return [(i, i == 0, i == len(found) - 1) for i in sorted({0, len(found) - 1})]

    def shape(own: int, at: list, found: list, **more) -> pa.Table:
        return pa.table({"range": pa.array([own] * len(at), pa.int64()), "first": pa.array([f for _, f, _ in at], pa.bool_()), "last": pa.array([z for _, _, z in at], pa.bool_()),
                         "conv": pa.array([repr(found[i][0]) for i, _, _ in at], pa.string()),
                         **{k: pa.array(v, pa.list_(pa.int64())) for k, v in more.items()}})

    def matrices(t: pa.Table) -> pa.Table:
        """Of a range's first and last conversation."""
        found = list(_segments(t))
        at = ends(found)
        return shape(t["range"][0].as_py(), at, found, matrix=[whole(found[i][2]).reshape(-1).tolist() for i, _, _ in at])

    # two rows a range at most
    parts = by_range.applyInArrow(matrices, "range long, first boolean, last boolean, conv string, matrix array<long>").collect()
    groups = _across(parts)
    behind = {}  # (range, which end): costs to go at the end of the part
    for g in groups:
        after = [STOP]
        for r in reversed(g[1:]):
            after.append(product(np.asarray(r["matrix"], np.int64).reshape(4, 4), after[-1]))
        for r, costs in zip(g, reversed(after)):
            behind.update({(r["range"], end): costs for end in ("first", "last") if r[end]})

    def exits(t: pa.Table) -> pa.Table:
        """Of a part that goes over a range's end: the state it ends in, by the state it begins in."""
        own, found = t["range"][0].as_py(), list(_segments(t))
        at = [x for x in ends(found) if _of(behind, own, x) is not None]
        return shape(own, at, found, state=[[unroll(found[x[0]][2], s, _of(behind, own, x))[1] for s in STEPS] for x in at])

    into = {}  # (range, which end): the state in which the part begins
    if groups:
        told = by_range.applyInArrow(exits, "range long, first boolean, last boolean, conv string, state array<long>").collect()
        told = {(r["range"], r["first"], r["last"]): r["state"] for r in told}
        for g in groups:
            state = START
            for r in g:
                into.update({(r["range"], end): state for end in ("first", "last") if r[end]})
                state = told[r["range"], r["first"], r["last"]][state]
    over = {(r["range"], r["first"], r["last"]) for g in groups for r in g[:-1]}  # parts that another one follows

    def solve(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        own, found = t["range"][0].as_py(), list(_segments(t))
        audit, roles, last = [], [], []
        for i, (_, _, symbols) in enumerate(found):
            x = (i, i == 0, i == len(found) - 1)
            after, state = _of(behind, own, x), _of(into, own, x)
            choice, state = unroll(symbols, START if state is None else state, STOP if after is None else after)
            audit.extend(a for a, _ in choice)
            roles.extend(r for _, r in choice)
            last.extend([""] * (len(choice) - 1) + ["" if (own, *x[1:]) in over else last_inserts(state)])
        return t.select(["conv_id", "at"]).append_column("audit", pa.array(audit, pa.string())).append_column(
            "roles", pa.array(roles, pa.string())).append_column("behind", pa.array(last, pa.string()))

    return by_range.applyInArrow(solve, f"conv_id {dict(thin.dtypes)['conv_id']}, at long, audit string, roles string, behind string")


def _of(table: dict, own: int, end: tuple[int, bool, bool]):
    """The entry of a range's conversation that is its first or its last one."""
    _, first, last = end
    return table.get((own, "first")) if first and (own, "first") in table else table.get((own, "last")) if last else None


def _across(parts: list) -> list[list]:
    """The parts, in order, of each conversation that goes over a range's end."""
    groups: list[list] = []
    for r in sorted(parts, key=lambda r: (r["range"], r["last"])):
        before = groups[-1][-1] if groups else None
        if before and before["last"] and r["first"] and before["conv"] == r["conv"] and before["range"] != r["range"]:
            groups[-1].append(r)
        else:
            groups.append([r])
    return [g for g in groups if len(g) > 1]


def stream(df: DataFrame, rows: DataFrame, changes: DataFrame, conv_col: str) -> DataFrame:
    """For each original conversation a first record, then its edits and rows in order:
    ``conv_id, at, kind`` (0, 1, 2) and the columns of each, sorted in partitions."""
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    own = [none("turn", "long"), *[none(c, "string") for c in ("role", "text", "fault")]]
    new = [none(c, "string") for c in ("audit", "roles", "behind")]
    seeds = df.select(F.col(conv_col).alias("conv_id")).distinct().select("conv_id", none("at", "long"), F.lit(0).alias("kind"), *own, *new)
    both = seeds.unionByName(changes.select("conv_id", "at", F.lit(1).alias("kind"), *own, "audit", "roles", "behind")).unionByName(
        rows.select("conv_id", "at", F.lit(2).alias("kind"), "turn", "role", "text", "fault", *new))
    return both.repartition(partitions(df.sparkSession), "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("at").asc_nulls_first(), "kind")


def lines(role: str, text: str, audit: str, roles: str, behind: str) -> list[str]:
    """What a row becomes: inserted turns before it, itself unless deleted, those behind it."""
    own = audit[-1] != "D"
    out = [f"{ROLES[r]}:" for r in (roles[:-1] if own else roles)]
    if own:
        out.append(f"{role if audit[-1] == 'K' else ROLES[roles[-1]]}:{text}")
    return out + [f"{ROLES[r]}:" for r in behind]


class Report:
    """Counts of one conversation, its audit and the running hash of its repaired lines."""

    def __init__(self, conv):
        self.conv, self.audit, self.hash, self.began = conv, [], hashlib.sha256(), False
        self.n = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.low = self.high = self.before = None
        self.turns = 0

    def add(self, turn, role: str, text: str, fault: str | None, audit: str, roles: str, behind: str) -> None:
        if turn is not None and turn != self.high:  # turns ascend
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if fault:
            self.n[fault] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.n["illegal"] += 1
        self.before = role[:1]
        audit += "I" * len(behind)
        own = audit[len(audit) - len(behind) - 1]
        self.n["cost"] += (INSERT * audit.count("I") + DELETE * audit.count("D") + RENAME * audit.count("R")
                           + CUT * (fault == "truncated" and own != "D"))
        self.audit.append(audit)
        for line in lines(role, text, audit[:len(audit) - len(behind)], roles, behind):
            self.hash.update((("\n" if self.began else "") + line).encode())
            self.began = True

    def row(self) -> dict:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return {"conv_id": self.conv, "gaps": gaps, **self.n, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per original conversation (a null one is one): ``conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256`` of the damaged rows.

    Rows of one turn go by role, then text; a repeated row follows its like. A
    conversation without rows after damage has zeros, an empty audit and the hash of
    the empty string. An empty table gives no rows.
    """
    rows = ordered(damaged(df, conv_col, turn_col, role_col, text_col))
    kind = dict(df.dtypes)[conv_col]
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    names = ["conv_id", *counts, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, edit, done = None, None, []
        for b in batches:
            of = b.schema.field("conv_id").type
            flush = lambda: pa.RecordBatch.from_pylist(done, pa.schema(
                [("conv_id", of), *[(c, pa.int64()) for c in counts], ("audit", pa.string()), ("repaired_sha256", pa.string())]))
            cols = [b[c].to_pylist() for c in ("kind", "conv_id", "turn", "role", "fault", "audit", "roles", "behind")]
            for k, text in enumerate(b["text"]):
                what, conv, turn, role, fault, audit, roles, behind = (c[k] for c in cols)
                if what == 0:
                    if now:
                        done.append(now.row())
                    now = Report(conv)
                elif what == 1:
                    edit = audit, roles, behind
                else:
                    now.add(turn, role, text.as_py(), fault, *edit)
            if len(done) >= 4096:
                yield flush()
                done = []
        if now:
            done.append(now.row())
        if done:
            yield flush()

    out = ", ".join(f"{c} long" if c in counts else f"{c} {kind if c == 'conv_id' else 'string'}" for c in names)
    return stream(df, rows, edits(rows), conv_col).mapInArrow(tidy(run), out).withColumnRenamed("conv_id", conv_col)


def repaired(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, at, part, role, text`` of the repaired conversations as they are (no damage
    is done first): their turns in order of ``at`` and ``part``."""
    src = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                    F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"))
    rows = ordered(src)
    j = rows.join(edits(rows).drop("conv_id"), "at")
    own = F.substring("audit", -1, 1)
    word = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    empty = lambda c: F.transform(F.filter(F.split(c, ""), lambda r: r != ""), lambda r: turn(F.element_at(word, r), F.lit("")))
    before = F.when(own == "D", F.col("roles")).otherwise(F.expr("left(roles, length(roles) - 1)"))
    mine = F.when(own == "K", F.array(turn(F.col("role"), F.col("text")))).when(
        own == "R", F.array(turn(F.element_at(word, F.substring("roles", -1, 1)), F.col("text")))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    return j.select("conv_id", "at", F.posexplode(F.concat(empty(before), mine, empty(F.col("behind")))).alias("part", "x")).select(
        F.col("conv_id").alias(conv_col), "at", "part", "x.role", "x.text")
