"""Repair of the turn structure of conversations: equal shapes are solved once, and their edits replayed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, work_folder

#: ASCII white space, for trimming and for "holds anything else".
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_VISIBLE = r"[^\x20\x09-\x0D]"
#: Cost of each edit; a truncated row that stays costs FLAWED more.
DELETE, REROLE, INSERT, FLAWED = 2, 1, 5, 5
#: What a conversation has come to: nothing yet, a system row, a user row, an assistant row. Where a user or assistant row leads.
_NEW, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
#: Cost of ending there: a user row lacks its answer, a system row a whole exchange.
_END = (0, 2 * INSERT, INSERT, 0)
#: Rows of a shape that one recursion goes through.
_BLOCK = 64


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, turn, role, text, n): each with what a hash of `conv:turn` does to it, and how often it then stands there.

    Of 20 hash values 0 drops the row (n = 0), 1 empties its text, 2 removes its sentence ends, 3 doubles it (n = 2), 4 makes it
    a user row. Nulls in role, text and the hashed key count as one space; a null turn stays null. Rows of equal conv and turn share a fate.
    """
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said(conv), F.lit(":"), said(turn))) % 20
    return rows.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"),
        F.when(kind == 4, "user").otherwise(said(role)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(said(text), ".!?", "")).otherwise(said(text)).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("n"),
    )


def plain(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, turn, role, text, n) as they are, nulls in role and text as one space."""
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), said(role).alias("role"), said(text).alias("text"), F.lit(1).alias("n"))


def _place(rows: DataFrame) -> DataFrame:
    """With `h`, which stands for the text; (conv, turn, role, h) is the order of rows, nulls first. Dropped rows only name their conversation."""
    there = F.col("n") > 0
    return rows.withColumn("h", F.when(there, F.unhex(F.sha2("text", 256)))).withColumn("role", F.when(there, F.col("role")))


def _shape() -> Column:
    """A row's letter: x must go; else s, u, a, or o for other roles, in capitals if truncated."""
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    return F.when(F.col("blank") | F.col("again"), "x").when(F.col("open"), F.upper(initial)).otherwise(initial)


_PIECE = (
    "conv {conv}, turn {turn}, role string, h binary, last_turn {turn}, first_initial string, last_initial string, shape string, "
    "low {turn}, high {turn}, n_turns long, blank long, duplicate long, truncated long, illegal long"
)
_LEGAL = ("su", "ua", "au")


class _Piece:
    """What one task has seen of one conversation: successive rows of it."""

    def __init__(self, conv, turn, role, h):
        self.conv, self.turn, self.role, self.h, self.last_turn = conv, turn, role, h, None
        self.first_initial = self.last_initial = self.low = self.high = None
        self.shape, self.n_turns, self.blank, self.duplicate, self.truncated, self.illegal = bytearray(), 0, 0, 0, 0, 0

    def add(self, turn, role: str | None, n: int, blank: bool, again: bool, cut: bool, letter: str) -> None:
        if not n:
            return
        if turn is not None:
            self.n_turns += turn != self.last_turn
            self.low = turn if self.low is None else self.low
            self.high = self.last_turn = turn
        initial = role[:1]
        if self.last_initial is None:
            self.first_initial = initial
        else:
            self.illegal += self.last_initial + initial not in _LEGAL
        self.illegal += n - 1
        self.last_initial = initial
        self.blank += n if blank else 0
        self.duplicate += 0 if blank else n - 1 + again
        self.truncated += not blank and not again and cut
        self.shape += (letter + "x" * (n - 1)).encode()

    def row(self) -> list:
        return [
            self.conv, self.turn, self.role, self.h, self.last_turn, self.first_initial, self.last_initial, self.shape.decode(),
            self.low, self.high, self.n_turns, self.blank, self.duplicate, self.truncated, self.illegal,
        ]


def _table(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _kinds(rows: DataFrame) -> tuple[str, str]:
    kind = dict(rows.dtypes)
    return kind["conv"], kind["turn"]


def shapes(rows: DataFrame) -> DataFrame:
    """One row for each conversation of (conv, turn, role, text, n): its shape as a string of a letter a row, and the counts of its faults.

    A row's first fault counts: blank (nothing but ASCII white space), duplicate (an earlier row of the conversation has its role and
    text), truncated (its last visible character is no sentence end). gaps: turns that are missing between the lowest and the highest;
    illegal: neighbours whose roles can't follow each other. Rows go by turn, nulls first; ties by role and a hash of the text.
    Equal rows are counted before they move, and texts stay behind as hashes. A conversation may hold any share of all rows: they are
    ordered by range, so that several tasks read its pieces, and one letter a row comes together.
    """
    seen = F.rtrim("text", F.lit(_SPACE))
    at = _place(rows)
    each = at.groupBy("conv", "turn", "role", "h").agg(
        F.sum("n").alias("n"), F.first(~F.col("text").rlike(_VISIBLE)).alias("blank"), F.first(~F.substring(seen, -1, 1).isin(".", "!", "?")).alias("open")
    )
    # The first place of each text in its conversation; min of a struct takes nulls as least.
    firsts = each.filter("h IS NOT NULL").groupBy("conv", "role", "h").agg(F.min(F.struct("turn")).alias("first"))
    same = each["conv"].eqNullSafe(firsts["conv"]) & (each["role"] == firsts["role"]) & (each["h"] == firsts["h"])
    told = each.join(firsts, same, "left").select(each["*"], (~F.struct(each["turn"]).eqNullSafe(F.col("first"))).alias("again"))
    told = told.withColumn("letter", F.when(F.col("n") > 0, _shape())).select("conv", "turn", "role", "h", "n", "blank", "again", "open", "letter")
    kind = _PIECE.format(conv=_kinds(rows)[0], turn=_kinds(rows)[1])
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "h")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, out, schema = None, [], None
        for b in batches:
            if schema is None:
                types = {f.name: f.type for f in b.schema}
                named = {"conv": types["conv"], "role": types["role"], "h": types["h"], "first_initial": pa.string(), "last_initial": pa.string(), "shape": pa.string()}
                named |= dict.fromkeys(("turn", "last_turn", "low", "high"), types["turn"])
                schema = pa.schema([(x.split()[0], named.get(x.split()[0], pa.int64())) for x in _PIECE.split(", ")])
            for conv, turn, role, h, *rest in zip(*(c.to_pylist() for c in b.columns)):
                if piece is None or piece.conv != conv:
                    if piece is not None:
                        out.append(piece.row())
                    piece = _Piece(conv, turn, role, h)
                piece.add(turn, role, *rest)
            if len(out) >= 5000:
                yield _table(out, schema)
                out = []
        if piece is not None:
            yield _table([*out, piece.row()], schema)

    pieces = told.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, kind)
    # Pieces of a conversation: as many as tasks at most. Seams: a turn on both sides counts once; the roles on both sides are neighbours.
    with_rows = "filter(p, x -> x.shape <> '')"
    with_turns = "filter(p, x -> x.low IS NOT NULL)"
    seams = lambda of, test: f"size(filter(sequence(1, size({of}) - 1), i -> {test}))"
    whole = pieces.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(*[c for c in pieces.columns if c != "conv"]))).alias("p"))
    whole = whole.select("conv", F.expr(with_rows).alias("p"), F.expr(with_turns).alias("t"))
    one = lambda of, test: f"IF(size({of}) > 1, {seams(of, test)}, 0)"
    total = lambda of, name: f"aggregate({of}, 0L, (s, x) -> s + x.{name})"
    turns = f"{total('t', 'n_turns')} - {one('t', 't[i].low = t[i - 1].last_turn')}"
    return whole.selectExpr(
        "conv", "array_join(transform(p, x -> x.shape), '') AS shape",
        f"IF(size(t) = 0, 0L, CAST(t[size(t) - 1].high - t[0].low + 1 AS BIGINT) - ({turns})) AS gaps",
        *(f"{total('p', c)} AS {c}" for c in ("blank", "duplicate", "truncated")),
        total("p", "illegal") + " + " + one("p", "NOT concat(p[i - 1].last_initial, p[i].first_initial) IN ('su', 'ua', 'au')") + " AS illegal",
    )


def _moves(letter: str, state: int) -> Iterator[tuple[str, int, int]]:
    """What may be done with a row of a letter: edit, its cost, the next state. In the order of the edits' initials."""
    yield "D", DELETE, state
    if letter == "x":
        return
    more, role = FLAWED * letter.isupper(), letter.lower()
    fits = {"s": state == _NEW, "u": state != _USER, "a": state == _USER}.get(role, False)
    if fits:
        yield "K", more, _SYSTEM if role == "s" else _NEXT[state]
    yield "R", REROLE + more, _NEXT[state]


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    """The least costs if rows may be inserted first; two are enough, as a third leads where the first did."""
    once = [min(c, INSERT + costs[_NEXT[s]]) for s, c in enumerate(costs)]
    return tuple(min(c, INSERT + once[_NEXT[s]]) for s, c in enumerate(once))


@lru_cache(maxsize=200_000)
def _costs(shape: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Least cost from each state over the rows of a short shape, and then what `after` says."""
    if not shape:
        return after
    rest = _costs(shape[1:], after)
    return _with_inserts([min(cost + rest[to] for _, cost, to in _moves(shape[0], s)) for s in range(4)])


@lru_cache(maxsize=200_000)
def _edits(shape: str, after: tuple[int, ...], state: int) -> tuple[str, int]:
    """The least edits of least cost from a state, and the state that they lead to."""
    if not shape:
        return "", state
    here, rest = _costs(shape, after)[state], _costs(shape[1:], after)
    ways = [(e, cost + rest[to], shape[1:], to) for e, cost, to in _moves(shape[0], state)]
    ways.append(("I", INSERT + _costs(shape, after)[_NEXT[state]], shape, _NEXT[state]))
    edit, _, left, to = min(w for w in ways if w[1] == here)
    more, end = _edits(left, after, to)
    return edit + more, end


def solve(shape: str) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of a shape; ties go to the least audit.

    Long shapes are taken in blocks from their end; the costs behind a block differ by a few inserts at most, so blocks that
    recur anywhere in any shape are solved once for each of few cases.
    """
    after, total, blocks = _END, 0, []
    for at in range((len(shape) - 1) // _BLOCK * _BLOCK, -1, -_BLOCK):
        block = shape[at : at + _BLOCK]
        least = min(after)
        after, total = tuple(c - least for c in after), total + least
        blocks.append((block, after))
        after = _costs(block, after)
    state, out = _NEW, []
    for block, behind in reversed(blocks):
        edits, state = _edits(block, behind, state)
        out.append(edits)
    while state not in (_NEW, _ASSISTANT):
        out.append("I")
        state = _NEXT[state]
    return total + after[_NEW], "".join(out)


def audit_conversations(rows: DataFrame) -> DataFrame:
    """shapes(rows), with the cost and the audit of the cheapest repair: an initial of Keep, Delete, Rerole or Insert an edit.

    A repaired conversation is empty, or user and assistant rows by turns, maybe after a system row. Blank and duplicate rows must go.
    Each distinct shape is solved once and joined back. A conversation without rows costs nothing.
    """
    told = stored(shapes(rows), work_folder(rows.sparkSession), "shapes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            solved = [solve(s) for s in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c for c, _ in solved], pa.int64()), pa.array([a for _, a in solved], pa.string())], ["shape", "cost", "audit"])

    return told.join(told.select("shape").distinct().mapInArrow(run, "shape string, cost long, audit string"), "shape")


def _replayed(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    """From sorted rows, each conversation's audit row first: ("begin", audit row), then ("row", role, text) for each row of the repair."""
    audit, at, state, i = "", 0, _NEW, {n: k for k, n in enumerate(names)}

    def edits(until_row: bool) -> Iterator[tuple[str, int]]:
        nonlocal at, state
        while at < len(audit):
            edit, at = audit[at], at + 1
            if edit in "IR":
                state = _NEXT[state]
            yield edit, state
            if edit != "I" and until_row:
                return

    word = {_USER: "user", _ASSISTANT: "assistant"}
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[i["first"]] == 0:
                for _, s in edits(False):
                    yield "row", word[s], ""
                audit, at, state = row[i["audit"]], 0, _NEW
                yield "begin", row
                continue
            role, text = row[i["role"]], row[i["text"]]
            for _ in range(row[i["n"]]):
                for edit, s in edits(True):
                    if edit == "K":
                        state = _SYSTEM if state == _NEW and role[:1] == "s" else _NEXT[state]
                        yield "row", role, text
                    elif edit != "D":
                        yield "row", word[s], text if edit == "R" else ""
    for _, s in edits(False):
        yield "row", word[s], ""


def _beside(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The rows that stay in order behind the audit of their conversation: nothing of a conversation has to fit into memory but its audit."""
    both = audits.withColumn("first", F.lit(0)).unionByName(_place(rows.filter("n > 0")).withColumn("first", F.lit(1)), allowMissingColumns=True)
    order = [F.col(c).asc_nulls_first() for c in ("conv", "first", "turn", "role", "h")]
    return both.repartition("conv").sortWithinPartitions(*order).drop("h")


def repaired_rows(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired conversations, replayed from their audits: (conv, position from 0, role, text)."""
    both = _beside(rows, audits.select("conv", "audit"))
    names = both.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, at, out, schema = None, 0, [], None

        def typed(source):
            nonlocal schema
            for b in source:
                if schema is None:
                    schema = pa.schema([("conv", b.schema.field("conv").type), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])
                yield b

        for kind, *x in _replayed(typed(batches), names):
            if kind == "begin":
                conv, at = x[0][names.index("conv")], 0
            else:
                out.append([conv, at, *x])
                at += 1
            if len(out) >= 1000:
                yield _table(out, schema)
                out = []
        if out:
            yield _table(out, schema)

    return both.mapInArrow(run, f"conv {_kinds(rows)[0]}, position long, role string, text string")


def repair_digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The rows of audits with `repaired_sha256`: of the repaired rows as `role:text`, newline-joined; without any, of nothing."""
    both, kept = _beside(rows, audits), audits.columns
    names, kind = both.columns, dict(both.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out, digest, empty = None, [], None, True

        def typed(source):
            nonlocal schema
            for b in source:
                if schema is None:
                    schema = pa.schema([*(b.schema.field(c) for c in kept), ("repaired_sha256", pa.string())])
                yield b

        for what, *x in _replayed(typed(batches), names):
            if what == "begin":
                if out:
                    out[-1][-1] = digest.hexdigest()
                if len(out) >= 1000:
                    yield _table(out, schema)
                    out = []
                out.append([*(x[0][names.index(c)] for c in kept), None])
                digest, empty = hashlib.sha256(), True
            else:
                digest.update((b"" if empty else b"\n") + f"{x[0]}:{x[1]}".encode("utf-8", "surrogatepass"))
                empty = False
        if out:
            out[-1][-1] = digest.hexdigest()
            yield _table(out, schema)

    return both.mapInArrow(run, ", ".join(f"`{c}` {kind[c]}" for c in kept) + ", repaired_sha256 string")


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row for each conversation of rows (conv, turn, role, text, n), as `damaged` or `plain` give them.

    Returns conv, gaps, blank, duplicate, truncated, illegal, cost (longs), audit and repaired_sha256. Null conv is a conversation of its
    own. A conversation whose rows all have n = 0 has zeros, an empty audit and the hash of nothing; an empty table gives an empty result.
    """
    audits = audit_conversations(rows).select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return repair_digests(rows, audits)
