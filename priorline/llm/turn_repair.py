"""Repair of conversation structure by weighted parsing over spans of turns.

A sound conversation's role initials follow ``(s?(ua)+)?``: a small automaton. Its grammar in Chomsky normal form has one
nonterminal for each pair of states, [p,q], with the rules [p,q] -> [p,r] [r,q], and terminals for one turn that is kept,
given another role, or deleted. A cell of the chart holds, for a span of turns and a nonterminal, the cheapest edits as
(cost, audit), audit being the initials of the edits; at equal cost the least in ASCII. Cells of single turns and of the
empty span are closed under insertions. Two audits of one cell at the same cost are never one the beginning of the other
(they would differ by insertions only, which cost), so the least audit of a span is made of least audits of its parts.

Spans up to a block's length are combined from all their splits, bottom-up by length; as each nonterminal names the
states at both its ends, longer spans need one split only and are combined from blocks, doubling in length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorline.session import stored

#: By nonterminal; the entry of one that derives nothing is None.
Cell = list[tuple[int, str] | None]

START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {"s": [(START, SYSTEM)], "u": [(START, USER), (SYSTEM, USER), (ASSISTANT, USER)], "a": [(USER, ASSISTANT)]}
ENDS = (START, ASSISTANT)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLOCK = 8
ROLES = {"u": "user", "a": "assistant"}
#: Turn classes: an initial in lower case, in upper case if its text is cut off; one sign for turns that must go.
MUST_GO, OTHER = "-", "x"


STATES = 4
RULES = [(STATES * p + r, STATES * r + q, STATES * p + q) for p in range(STATES) for r in range(STATES) for q in range(STATES)]


def pair(p: int, q: int) -> int:
    """Number of the nonterminal [p,q]."""
    return STATES * p + q


def combine(out: Cell, left: Cell, right: Cell, rules: list[tuple[int, int, int]] = RULES) -> Cell:
    """Apply all rules [p,q] -> [p,r] [r,q] to two neighbouring spans and keep what is cheaper than in ``out``."""
    for a, b, c in rules:
        x, y = left[a], right[b]
        if x is not None and y is not None:
            now, cost = out[c], x[0] + y[0]
            if now is None or cost < now[0] or cost == now[0] and x[1] + y[1] < now[1]:
                out[c] = (cost, x[1] + y[1])
    return out


def nothing() -> Cell:
    return [None] * STATES**2


def _closure() -> Cell:
    """The empty span: no edit, or users and assistants inserted until nothing gets cheaper."""
    cell, one = nothing(), nothing()
    for p in range(STATES):
        cell[pair(p, p)] = (0, "")
    for step in STEPS["u"] + STEPS["a"]:
        one[pair(*step)] = (INSERT, "I")
    while (now := combine(cell.copy(), cell, one)) != cell:
        cell = now
    return cell


EMPTY = _closure()


@lru_cache(maxsize=64)
def turn(kind: str) -> Cell:
    """One turn: kept, given a role or deleted, with insertions before and after."""
    cell = nothing()
    for p in range(STATES):
        cell[pair(p, p)] = (DELETE, "D")
    if kind != MUST_GO:
        extra = TRUNCATED if kind.isupper() else 0
        for step in STEPS["u"] + STEPS["a"]:
            cell[pair(*step)] = (REROLE + extra, "R")
        for step in STEPS.get(kind.lower(), []):
            cell[pair(*step)] = (KEEP + extra, "K")
    return combine(nothing(), combine(nothing(), EMPTY, cell), EMPTY)


#: The rules whose parts derive anything.
USED = [rule for rule in RULES if all(any(turn(k)[part] for k in "sua") for part in rule[:2])]


@lru_cache(maxsize=1 << 14)
def block(kinds: str) -> Cell:
    """Chart of a block of turns, from all splits of all its spans, by length."""
    n = len(kinds)
    chart = {(i, i + 1): turn(kinds[i]) for i in range(n)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            j, cell = i + size, nothing()
            for k in range(i + 1, j):
                combine(cell, chart[i, k], chart[k, j], USED)
            chart[i, j] = cell
    return chart[0, n] if n else EMPTY


class Spans:
    """Blocks of a growing row of turns, neighbours of one length joined: few cells are held at any time."""

    def __init__(self) -> None:
        self.cells: list[tuple[int, Cell]] = []
        self.open: list[str] = []

    def add(self, kind: str) -> None:
        self.open.append(kind)
        if len(self.open) == BLOCK:
            self._close()

    def _close(self) -> None:
        size, cell = 1, block("".join(self.open))
        self.open = []
        while self.cells and self.cells[-1][0] == size:
            size, cell = 2 * size, combine(nothing(), self.cells.pop()[1], cell, USED)
        self.cells.append((size, cell))

    def cheapest(self) -> tuple[int, str]:
        cell = block("".join(self.open))
        for _, before in reversed(self.cells):
            cell = combine(nothing(), before, cell, USED)
        return min(v for q in ENDS if (v := cell[pair(START, q)]))


def repair(kinds: str) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of turns of these classes."""
    spans = Spans()
    for kind in kinds:
        spans.add(kind)
    return spans.cheapest()


SIGNS = "[^\\x20\\x09-\\x0D]"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``copies`` (0, 1 or 2): the given faults, set by CRC-32 of ``conv_id:turn`` by 20.

    0 drops the row, 1 empties its text, 2 takes the ends of sentences out of it, 3 repeats it, 4 makes it a user's.
    Null roles and texts, and null ids and turns within the hashed text, count as one space.
    """
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    plain = rows.select(
        "conv_id",
        "turn",
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")),
        (F.crc32(name) % 20).alias("fault"),
    )
    fault = F.col("fault")
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return plain.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


def _digest(*columns: str) -> Column:
    """Role and text as one key of 32 bytes; the role's length keeps the two apart."""
    return F.unhex(F.sha2(F.encode(F.concat_ws(":", F.length("role").cast("string"), *columns), "utf-8"), 256))


def _turns(rows: DataFrame) -> DataFrame:
    """Equal turns as one small row each, with the number of copies and whether an equal role and text came before.

    Counted before they are shuffled, so one turn repeated without end is one row from each task.
    """
    last = F.regexp_extract("text", f"({SIGNS})[\\x20\\x09-\\x0D]*\\z", 1)
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise(OTHER)
    small = rows.select(
        "conv_id",
        "turn",
        "role",
        _digest("role", "text").alias("key"),
        initial.alias("initial"),
        F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated").alias("fault"),
        F.when(last.isin(".", "!", "?"), letter).otherwise(F.upper(letter)).alias("kind"),
        "copies",
    )
    names = ["conv_id", "turn", "role", "key", "initial", "fault", "kind"]
    turns = stored(small.groupBy(*names).agg(F.sum("copies").alias("copies")), "turns")
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = turns.filter("copies > 0").groupBy("conv_id", "key").agg(F.min(order).alias("first"))
    first = first.withColumnsRenamed({"conv_id": "conv", "key": "their"})
    meets = turns["conv_id"].eqNullSafe(first["conv"]) & (turns["key"] == first["their"])
    return turns.join(first, meets, "left").select(*names, "copies", F.col("turn").eqNullSafe(F.col("first.turn")).alias("new"))


_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def summaries(rows: DataFrame) -> DataFrame:
    """Per conversation: gaps, faults, illegal neighbours, and cost and audit of the cheapest repair.

    ``rows`` has conv_id, turn, role, text and copies. Conversations come to a task sorted by turn and are read turn by
    turn: what a task holds is a conversation's audit, one letter a turn.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    turns = _turns(rows).repartition("conv_id").sortWithinPartitions(*_order("conv_id", "turn", "role", "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Summary | None = None
        for batch in batches:
            done = []
            for conv, *values in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv != conv:
                    done += [now.row()] if now else []
                    now = Summary(conv)
                now.add(*values)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types(batch))], names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(now.row(), types(batch))], names)

    names = ["conv_id", *(p.split()[0] for p in _SUMMARY.split(", "))]

    def types(batch: pa.RecordBatch) -> list[pa.DataType]:
        return [batch.schema.field(0).type] + [pa.int64()] * 6 + [pa.string()]

    wanted = turns.select("conv_id", F.col("turn").cast("long"), "initial", "fault", "kind", "copies", "new")
    return wanted.mapInArrow(run, f"conv_id {kind}, {_SUMMARY}")


def _order(*names: str) -> list[Column]:
    return [F.asc_nulls_first(n) for n in names]


class Summary:
    """Counts and spans of one conversation, fed in order of its turns."""

    def __init__(self, conv) -> None:
        self.conv, self.spans = conv, Spans()
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.least: int | None = None
        self.most: int | None = None
        self.before: str | None = None

    def add(self, number: int | None, initial: str, fault: str | None, kind: str, copies: int, new: bool) -> None:
        if not copies:
            return
        if number is not None and number != self.most:
            self.most = number
            self.least = self.most if self.least is None else self.least
            self.distinct += 1
        for copy in range(copies):
            if self.before is not None and self.before + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = initial
            if fault == "blank":
                self.blank += 1
                self.spans.add(MUST_GO)
            elif copy or not new:
                self.duplicate += 1
                self.spans.add(MUST_GO)
            else:
                self.truncated += fault == "truncated"
                self.spans.add(kind)

    def row(self) -> tuple:
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.distinct
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.spans.cheapest())


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place, role, text; each conversation in one partition, in order.

    Each audit comes before its conversation's turns, which follow one by one: a task never holds a whole conversation.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    turn_kind = rows.schema["turn"].dataType.simpleString()
    each = rows.withColumn("_copy", F.explode(F.slice(F.array(F.lit(1), F.lit(2)), F.lit(1), F.col("copies"))))
    turns = each.select("conv_id", F.lit(1).alias("_part"), "turn", "role", _digest("role", "text").alias("_key"), "text")
    none = F.lit(None)
    heads = found.select(
        "conv_id", F.lit(0).alias("_part"), none.cast(turn_kind).alias("turn"), none.cast("string").alias("role"),
        none.cast("binary").alias("_key"), F.col("audit").alias("text"),
    )
    both = heads.unionByName(turns).repartition("conv_id").sortWithinPartitions(*_order("conv_id", "_part", "turn", "role", "_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            out: list[tuple] = []
            for conv, part, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if part == 0:
                    state = Editor(conv, text)
                    out += state.inserted()
                else:
                    out += state.apply(role, text)
            if out:
                types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["conv_id", "place", "role", "text"])

    return both.select("conv_id", "_part", "role", "text").mapInArrow(run, f"conv_id {kind}, place long, role string, text string")


class Editor:
    """Applies an audit to a conversation's turns, one at a time."""

    def __init__(self, conv, audit: str) -> None:
        self.conv, self.audit, self.at, self.place, self.last = conv, audit, 0, 0, ""

    def _out(self, role: str, text: str) -> tuple:
        self.last = role[:1]
        self.place += 1
        return (self.conv, self.place - 1, role, text)

    def _next(self) -> str:
        return ROLES["a" if self.last == "u" else "u"]

    def inserted(self) -> list[tuple]:
        out = []
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            out.append(self._out(self._next(), ""))
        return out

    def apply(self, role: str, text: str) -> list[tuple]:
        edit = self.audit[self.at]
        self.at += 1
        own = [] if edit == "D" else [self._out(role if edit == "K" else self._next(), text)]
        return own + self.inserted()


def _digests(turns: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines, read in the order ``repaired`` leaves them in."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        conv_type = None
        for batch in batches:
            done = []
            conv_type = batch.schema.field(0).type
            for conv, place, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if place == 0:
                    done += [(state[0], state[1].hexdigest())] if state else []
                    state = (conv, hashlib.sha256())
                state[1].update((("\n" if place else "") + role + ":" + text).encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (conv_type, pa.string()))], ["conv", "digest"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([state[0]], conv_type), pa.array([state[1].hexdigest()])], ["conv", "digest"])

    return turns.mapInArrow(run, f"conv {kind}, digest string")


def structure(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per conversation the summary, and the repaired turns of all of them, for rows with conv_id, turn, role, text, copies.

    Rows are taken by turn, null turns first, then by role and by a digest of role and text; a conversation of which
    every row has no copy has a summary of zeros and no turns. A null conv_id is a conversation of its own. Null roles
    and texts must be filled before. An empty table gives empty results; other columns play no part. A long
    conversation is one task's work, as its audit and digest are one value, but is never held as a whole.
    """
    found = stored(summaries(conversations), "conversation-audits")
    return found, repaired(conversations, found)


def repair_digests(conversations: DataFrame) -> DataFrame:
    """Every conversation after the given damage: faults, cost and audit of its repair, and a digest of the repaired turns."""
    found, turns = structure(damaged(conversations))
    digests = _digests(turns)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return found.join(digests, found["conv_id"].eqNullSafe(digests["conv"]), "left").select(
        *found.columns, F.coalesce("digest", none).alias("repaired_sha256")
    )
