"""The cheapest repair of broken conversations, as the least string of edits, for conversations of any length.

A repair walks a small automaton of roles (an optional system turn, then user and assistant in turn, the
assistant last) over the rows of a conversation: Keep, Rerole, Delete, Insert.  Rows and states make a
graph; forward and backward minimum costs tell the *tight* arcs, those on some cheapest path, and a
frontier of nodes that walks along tight arcs only, taking the least letter at every step, spells the
least cheapest edit string.

Rows are dealt by ranges of (conversation, turn), so a conversation is a run inside one part, or spans the
borders of parts.  Runs inside a part are repaired where they stand.  A conversation at a border is cut at
the borders: each segment gives its matrix of costs from state to state, the matrices are combined along the
conversation (a row a segment), which gives every segment its forward costs at the start and backward costs
at the end, and the segments are walked at once, from every state in which a cheapest path may enter.  Since a
state allows one next role, a prefix of the edit string leaves one node, so segments link by their end states.
A conversation that holds a third of all rows is thus worked on by as many tasks as it fills parts; only its
hash, which has no other way, is a stream of its turns through one task.

Cases: null roles, texts and, in the damage, ids and turns stand for one space; null turns come first and have
no part in gaps; rows of one turn follow each other by role, then text; a null conv_id is a conversation of its
own; a conversation without rows has zeros and empty strings; gaps beyond 64 bits are the largest long; no
conversations give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import chain, groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize, require_columns, small_batches

#: Rows a part, about, and the most parts; longer conversations than SEGMENT rows are worked on in segments.
PART_ROWS, MOST_PARTS, PART_BITS, SEGMENT = 50_000, 4096, 40, 1 << 15
DELETE, INSERT, REROLE, UNFINISHED = 4, 3, 3, 3
_SPACES, _ENDS = " \t\n\v\f\r", ".!?"
#: States: nothing yet, after the system turn, after a user's, after an assistant's turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, ACCEPTED = range(4), (START, ASSISTANT)
FOLLOWER = (USER, USER, ASSISTANT, USER)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
NEVER = 1 << 60
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
MOST = (1 << 63) - 1


def fault_of(text: str, seen: bool) -> str | None:
    """A row's first fault; seen: its role and text came earlier."""
    body = text.rstrip(_SPACES)
    if not body:
        return BLANK
    return DUPLICATE if seen else None if body[-1] in _ENDS else TRUNCATED


def row_arcs(state: int, initial: str, fault: str | None) -> list[tuple[str, int, int]]:
    """Edits of one row from a state: letter, next state, cost."""
    arcs = [("D", state, DELETE)]
    if fault not in (BLANK, DUPLICATE):
        extra = UNFINISHED if fault else 0
        to = FOLLOWER[state]
        if initial == "s" and state == START:
            arcs.append(("K", SYSTEM, extra))
        if initial == ROLE_OF[to][0]:
            arcs.append(("K", to, extra))
        arcs.append(("R", to, REROLE + extra))
    return arcs


#: All arcs of a kind of row, by state.
ARCS = {(i, f): [row_arcs(q, i, f) for q in STATES] for i in ("s", "u", "a", "") for f in (None, BLANK, DUPLICATE, TRUNCATED)}


def arcs_of(role: str, fault: str | None) -> list:
    initial = role[:1]
    return ARCS[initial if initial in ("s", "u", "a") else "", fault]


def inserted(costs: list[int]) -> list[int]:
    """Forward costs at one place, inserts there included."""
    c = list(costs)
    c[USER] = min(c[USER], INSERT + min(c[START], c[SYSTEM], c[ASSISTANT]))
    c[ASSISTANT] = min(c[ASSISTANT], INSERT + c[USER])
    return c


def insertable(costs: list[int]) -> list[int]:
    """Backward costs at one place, inserts there included."""
    c = list(costs)
    c[USER], c[ASSISTANT] = min(c[USER], INSERT + c[ASSISTANT]), min(c[ASSISTANT], INSERT + c[USER])
    c[START], c[SYSTEM] = (min(c[q], INSERT + c[USER]) for q in (START, SYSTEM))
    return c


def forward(rows: list, costs: list[int]) -> list[list[int]]:
    """Least costs from the entry to every state before each row and after the last."""
    out = [inserted(costs)]
    for by_state in rows:
        new, old = [NEVER] * 4, out[-1]
        for q in STATES:
            for _, to, cost in by_state[q]:
                if old[q] + cost < new[to]:
                    new[to] = old[q] + cost
        out.append(inserted(new))
    return out


def backward(rows: list, costs: list[int]) -> list[list[int]]:
    """Least costs from every state before each row and after the last to the exit."""
    out = [insertable(costs)]
    for by_state in reversed(rows):
        later = out[-1]
        out.append(insertable([min(cost + later[to] for _, to, cost in by_state[q]) for q in STATES]))
    return out[::-1]


AT_START = [0, NEVER, NEVER, NEVER]
AT_END = [0 if q in ACCEPTED else NEVER for q in STATES]


def walk(rows: list, ahead: list[list[int]], back: list[list[int]], total: int, state: int, last: bool) -> tuple[str, int]:
    """The least edit string along tight arcs from a state before the first row, and the state after the last one.

    Inserts behind the last row belong to what follows; of the last segment to itself.
    """
    letters, frontier = [], {(0, state)}
    while True:
        if any(at == len(rows) and (not last or q in ACCEPTED and ahead[at][q] == total) for at, q in frontier):
            break
        best, new = "Z", set()
        for at, q in frontier:
            arcs = [("I", at, FOLLOWER[q], INSERT)]
            if at < len(rows):
                arcs += [(letter, at + 1, to, cost) for letter, to, cost in rows[at][q]]
            for letter, to_at, to, cost in arcs:
                if letter <= best and ahead[at][q] + cost + back[to_at][to] == total:
                    best, new = letter, ({(to_at, to)} if letter < best else new | {(to_at, to)})
        letters.append(best)
        frontier = new
    (_, state), = frontier
    return "".join(letters), state


def edits(letters: str, rows: Iterable[tuple[str, str]], state: int) -> Iterator[tuple[str, str]]:
    """Turns (role, text) that the edit string makes of rows, from a state on."""
    rest = iter(rows)
    for letter in letters:
        role, text = ("", "") if letter == "I" else next(rest)
        if letter in "IR":
            role = ROLE_OF[FOLLOWER[state]]
        if letter != "D":
            state = SYSTEM if letter == "K" and role[0] == "s" else FOLLOWER[state]
            yield role, text


@dataclass
class Tally:
    """Counts over rows in order, and what is needed to count on."""

    turns: int = 0
    first: int | None = None
    last: int | None = None
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0))
    initials: tuple[str, str] | None = None

    def add(self, turn: int | None, role: str, fault: str | None) -> None:
        self.extend(Tally(int(turn is not None), turn, turn, {fault: 1} if fault else {}, (role[:1], role[:1])))

    def extend(self, other: Tally) -> None:
        """The rows of other follow."""
        for k, n in other.counts.items():
            self.counts[k] += n
        if other.turns:
            self.turns += other.turns - (self.last == other.first)
            self.first, self.last = other.first if self.first is None else self.first, other.last
        if self.initials and other.initials:
            self.counts["illegal"] += self.initials[1] + other.initials[0] not in LEGAL
        if other.initials:
            self.initials = (self.initials or other.initials)[0], other.initials[1]

    def report(self, cost: int) -> dict[str, int]:
        return {"gaps": min(self.last - self.first + 1 - self.turns, MOST) if self.turns else 0, **self.counts, "cost": cost}


def repair_whole(rows: list[tuple[int | None, str, str]]) -> tuple[dict[str, int], str, list[tuple[str, str]]]:
    """Counts and cost, edit string and repaired turns of one conversation: (turn, role, text) in order."""
    tally, seen, kinds = Tally(), set(), []
    for turn, role, text in rows:
        key = hashlib.blake2b(f"{len(role)} {role}{text}".encode(), digest_size=16).digest()
        fault = fault_of(text, key in seen)
        seen.add(key)
        tally.add(turn, role, fault)
        kinds.append(arcs_of(role, fault))
    ahead, back = forward(kinds, AT_START), backward(kinds, AT_END)
    total = back[0][START]
    letters, _ = walk(kinds, ahead, back, total, START, last=True)
    return tally.report(total), letters, list(edits(letters, ((r, t) for _, r, t in rows), START))


def turns_hash(turns: Iterable[tuple[str, str]]) -> str:
    h = hashlib.sha256()
    for i, (role, text) in enumerate(turns):
        h.update(f"{chr(10) if i else ''}{role}:{text}".encode())
    return h.hexdigest()


def damage(conversations: DataFrame) -> DataFrame:
    """conversations -> conv_id, turn, role, text, dropped: rows broken by their checksum; a dropped row keeps only its conv_id."""
    require_columns(conversations, ["conv_id", "turn", "role", "text"])
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")), F.lit(20)).cast("int")
    broken = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    again = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    gone = F.col("kind") == 0
    return broken.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(~gone, role).alias("role"), F.when(~gone, text).alias("text"), gone.alias("dropped"), again.alias("again")).drop("again")


_REPORT = [*COUNTS, "audit", "repaired_sha256"]
_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
#: Columns of a row that is passed on, then of a report; a row of the table has one half.
_PASSED = {"at": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string(), "dropped": pa.bool_(), "digest": pa.binary(), "fault": pa.string()}
_DONE = dict.fromkeys(COUNTS, pa.int64()) | {"audit": pa.string(), "repaired_sha256": pa.string(), "turns": pa.list_(_TURN)}
_SQL = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean", pa.binary(): "binary", pa.list_(_TURN): "array<struct<role: string, text: string>>"}
Rows = Iterable[pa.RecordBatch]


def _columns(kinds: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{c} {_SQL[k]}" for c, k in kinds.items())


def _batches(rows: Iterable[tuple], names: list[str], kinds: list[pa.DataType], size: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


def _read(batches: Rows) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _inside(batches: Rows, key: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a part -> reports of the short conversations inside it; rows of its first, its last and of long ones as they are."""

    def passed(run: Iterable[tuple]) -> Iterator[tuple]:
        for conv, part, turn, role, text, dropped, digest, count in run:
            fault = None if dropped else fault_of(text, False)
            yield conv, (part << PART_BITS) + count, turn, role, text, dropped, digest, fault, *[None] * len(_DONE)

    def done(run: list[tuple]) -> tuple:
        counts, audit, turns = repair_whole([(turn, role, text) for _, _, turn, role, text, dropped, _, _ in run if not dropped])
        return run[0][0], *[None] * len(_PASSED), *(counts[c] for c in COUNTS), audit, turns_hash(turns), [{"role": r, "text": t} for r, t in turns]

    def found() -> Iterator[tuple]:
        numbered = ((*r, i) for i, r in enumerate(_read(batches)))
        held: list[tuple] | None = None
        for n, (_, run) in enumerate(groupby(numbered, key=lambda r: r[0])):
            if held:
                yield done(held)
            held = [] if n == 0 else list(islice(run, SEGMENT))
            if n == 0 or len(held) == SEGMENT:
                yield from passed(chain(held, run))
                held = []
        if held:
            yield from passed(held)

    yield from _batches(found(), ["conv_id", *_PASSED, *_DONE], [key, *_PASSED.values(), *_DONE.values()])


def _by_segment(df: DataFrame) -> DataFrame:
    """Rows of one segment in one task, in order."""
    return df.repartition("segment").sortWithinPartitions("segment", "at")


_LISTS = {"matrix": "array<long>", "tally": "array<long>", "initials": "array<string>"}


def _segments(batches: Rows, key: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Marked rows of a conversation in a segment -> matrix of costs and tally."""

    def found() -> Iterator[tuple]:
        for (segment, conv), run in groupby(_read(batches), key=lambda r: (r[0], r[2])):
            tally, kinds = Tally(), []
            for _, _, _, turn, initial, dropped, fault in run:
                if not dropped:
                    tally.add(turn, initial, fault)
                    kinds.append(arcs_of(initial, fault))
            matrix = [c for q in STATES for c in forward(kinds, [0 if p == q else NEVER for p in STATES])[-1]]
            yield conv, segment, matrix, [tally.turns, tally.first, tally.last, *tally.counts.values()], list(tally.initials or [])

    yield from _batches(found(), ["conv_id", "segment", *_LISTS], [key, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())])


def _combine(batches: Rows, key: pa.DataType) -> Iterator[pa.RecordBatch]:
    """All segments of a conversation -> costs at their borders; the last one has the conversation's counts."""

    def found() -> Iterator[tuple]:
        for conv, segments in _read(batches):
            segments.sort(key=lambda s: s["segment"])
            tally, entries = Tally(), [AT_START]
            for s in segments:
                turns, first, last, *counts = s["tally"]
                tally.extend(Tally(turns, first, last, dict(zip(tally.counts, counts, strict=True)), tuple(s["initials"]) or None))
                entries.append([min(entries[-1][q] + s["matrix"][4 * q + to] for q in STATES) for to in STATES])
            exits = [AT_END]
            for s in reversed(segments):
                exits.append([min(s["matrix"][4 * q + to] + exits[-1][to] for to in STATES) for q in STATES])
            report = tally.report(exits[-1][START])
            for s, ahead, back in zip(segments, entries, exits[-2::-1], strict=False):
                last = s is segments[-1]
                yield conv, s["segment"], [min(c, NEVER) for c in ahead], [min(c, NEVER) for c in back], report["cost"], last, *(report[c] if last else None for c in COUNTS)

    yield from _batches(found(), ["conv_id", "segment", "ahead", "back", "total", "last", *COUNTS], [key, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.bool_(), *[pa.int64()] * len(COUNTS)])


_PATHS = pa.list_(pa.struct([("state", pa.int32()), ("letters", pa.string()), ("to", pa.int32())]))


def _walk(batches: Rows, key: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Marked rows of a conversation in a segment with the costs at its borders -> the least edit string from each state of a cheapest path."""

    def found() -> Iterator[tuple]:
        for (segment, conv), run in groupby(_read(batches), key=lambda r: (r[0], r[2])):
            kinds = []
            for _, _, _, initial, dropped, fault, *borders in run:
                if not dropped:
                    kinds.append(arcs_of(initial, fault))
                entry, exit_, total, last = borders
            ahead, back = forward(kinds, entry), backward(kinds, exit_)
            paths = [(q, *walk(kinds, ahead, back, total, q, last)) for q in STATES if ahead[0][q] + back[0][q] == total]
            yield conv, segment, [dict(zip(("state", "letters", "to"), p, strict=True)) for p in paths]

    yield from _batches(found(), ["conv_id", "segment", "paths"], [key, pa.int64(), _PATHS], 16)


def _link(batches: Rows, key: pa.DataType) -> Iterator[pa.RecordBatch]:
    """All segments of a conversation with their paths -> the one path of each, and its first state."""

    def found() -> Iterator[tuple]:
        for conv, segments in _read(batches):
            state = START
            for s in sorted(segments, key=lambda s: s["segment"]):
                path = next(p for p in s["paths"] if p["state"] == state)
                yield conv, s["segment"], state, path["letters"]
                state = path["to"]

    yield from _batches(found(), ["conv_id", "segment", "state", "letters"], [key, pa.int64(), pa.int32(), pa.string()], 16)


def _apply(batches: Rows, key: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Paths, then rows, of a segment -> repaired turns in order."""

    def found() -> Iterator[tuple]:
        for segment, rows in groupby(_read(batches), key=lambda r: r[0]):
            paths: dict = {}
            kept: dict[object, list] = {}
            for _, _, conv, role, text, state, letters in rows:
                if letters is not None:
                    paths[conv] = state, letters
                elif role is not None:
                    kept.setdefault(conv, []).append((role, text))
            for conv, (state, letters) in paths.items():
                for i, turn in enumerate(edits(letters, kept.get(conv, []), state)):
                    yield conv, segment, i, *turn

    yield from _batches(found(), ["conv_id", "segment", "place", "role", "text"], [key, pa.int64(), pa.int64(), pa.string(), pa.string()])


def _hash(batches: Rows, key: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Turns in order -> hash of each conversation; one turn at a time is held."""
    runs = groupby(_read(batches), key=lambda r: r[0])
    yield from _batches(((conv, turns_hash((r[3], r[4]) for r in run)) for conv, run in runs), ["conv_id", "repaired_sha256"], [key, pa.string()])


def _at_borders(passed: DataFrame, mapped) -> tuple[DataFrame, DataFrame]:
    """Reports and turns of the conversations whose rows were passed on."""
    kind = passed.schema["conv_id"].dataType.simpleString()
    segment = F.shiftright("at", SEGMENT.bit_length() - 1).alias("segment")
    firsts = passed.where("NOT dropped AND coalesce(fault, '') <> 'blank'").groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = F.when((F.col("fault") == BLANK) | F.col("dropped") | F.col("first").isNotNull(), F.col("fault")).otherwise(DUPLICATE)
    marked = passed.drop("text").join(firsts, "at", "left").select(segment, "at", "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "dropped", fault.alias("fault"))
    marked = materialize(marked, "marked")
    per_segment = mapped(_by_segment(marked), _segments, f"conv_id {kind}, segment long, " + ", ".join(f"{c} {k}" for c, k in _LISTS.items()))
    listed = per_segment.groupBy("conv_id").agg(F.collect_list(F.struct("segment", *_LISTS)).alias("segments"))  # a row a segment
    borders = mapped(listed, _combine, f"conv_id {kind}, segment long, ahead array<long>, back array<long>, total long, last boolean, " + ", ".join(f"{c} long" for c in COUNTS))
    borders = materialize(borders, "borders")
    b, m = borders.alias("b"), marked.alias("m")
    known = m.join(b, (F.col("m.segment") == F.col("b.segment")) & F.col("m.conv_id").eqNullSafe(F.col("b.conv_id")))
    known = known.select("m.segment", "m.at", "m.conv_id", "initial", "dropped", "fault", "ahead", "back", "total", "last")
    paths = mapped(_by_segment(known), _walk, f"conv_id {kind}, segment long, paths array<struct<state: int, letters: string, to: int>>")
    linked = mapped(paths.groupBy("conv_id").agg(F.collect_list(F.struct("segment", "paths")).alias("segments")), _link, f"conv_id {kind}, segment long, state int, letters string")
    linked = materialize(linked, "paths")
    none = F.lit(None)
    rows = passed.where("NOT dropped").select(segment, "at", "conv_id", "role", "text", none.cast("int").alias("state"), none.cast("string").alias("letters"))
    heads = linked.select("segment", F.lit(-1).cast("long").alias("at"), "conv_id", none.cast("string").alias("role"), none.cast("string").alias("text"), "state", "letters")
    turns = mapped(_by_segment(rows.union(heads)), _apply, f"conv_id {kind}, segment long, place long, role string, text string")
    turns = materialize(turns, "turns")
    hashes = mapped(turns.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "place"), _hash, f"conv_id {kind}, repaired_sha256 string")
    audits = linked.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("segment", "letters"))).alias("s")).select("conv_id", F.array_join("s.letters", "").alias("audit"))
    r, a, h = borders.where("last").alias("r"), audits.alias("a"), hashes.alias("h")
    same = lambda x, y: F.col(f"{x}.conv_id").eqNullSafe(F.col(f"{y}.conv_id"))
    reports = r.join(a, same("r", "a")).join(h, same("r", "h"), "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return reports.select("r.conv_id", *COUNTS, "audit", F.coalesce("repaired_sha256", nothing).alias("repaired_sha256")), turns


def repair_conversations(rows: DataFrame, part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """conv_id, turn, role, text -> reports and repaired turns.

    Reports: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.  Turns: conv_id,
    segment, place, role, text, to be read in this order.  Where rows have a column `dropped` (see damage), those
    rows only say that the conversation exists.
    """
    require_columns(rows, ["conv_id", "turn", "role", "text"])
    spark = rows.sparkSession
    small_batches(spark)
    dropped = F.coalesce("dropped", F.lit(False)) if "dropped" in rows.columns else F.lit(False)
    said = lambda c: F.coalesce(c, F.lit(" "))
    role, text = (F.when(~dropped, said(c)) for c in ("role", "text"))
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), dropped.alias("dropped"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    # Equal rows of different input parts differ in salt, so that no number of them has to share a part.
    salted = plain.withColumn("salt", F.spark_partition_id())
    parts = max(1, min(MOST_PARTS, -(-rows.count() // part_rows)))
    keys = ["conv_id", "turn", "role", "digest", "salt"]
    dealt = salted.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("conv_id", F.spark_partition_id().alias("part"), "turn", "role", "text", "dropped", "digest")

    kind = dealt.schema["conv_id"].dataType
    key = to_arrow_type(kind)
    mapped = lambda df, f, columns: df.mapInArrow(partial(f, key=key), columns)
    table = materialize(mapped(dealt, _inside, f"conv_id {kind.simpleString()}, {_columns(_PASSED)}, {_columns(_DONE)}"), "conversations")
    reports, turns = _at_borders(table.where("at IS NOT NULL").select("conv_id", *_PASSED), mapped)
    inner = table.where("at IS NULL")
    told = inner.select("conv_id", F.lit(None).cast("long").alias("segment"), F.posexplode("turns").alias("place", "t")).select("conv_id", "segment", F.col("place").cast("long").alias("place"), "t.role", "t.text")
    return inner.select("conv_id", *_REPORT).union(reports), told.union(turns)


def damage_and_repair(conversations: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Reports of all conversations after the damage."""
    return repair_conversations(damage(conversations), part_rows)[0]


#: Costs from the end backwards, then the least edit string forwards, one row and one letter at a time.
ORACLE_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT),
      lambda c, x: list_reduce([xor(c, x)] || range(8), lambda d, i: xor(d >> 1, 3988292384 * (d & 1))), 4294967295)) % 20 AS kind
  FROM conversations),
broken AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS again
  FROM keyed WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), again) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) > 1 AS seen,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body
  FROM broken),
marked AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS c, body = '' OR seen AS must,
    CASE WHEN body = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id),
convs AS (
  SELECT DISTINCT k.conv_id, coalesce(c.n, 0) AS n, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal
  FROM keyed k LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM k.conv_id),
steps AS (SELECT *, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END + CASE WHEN must THEN 1000000000 ELSE 0 END AS x FROM marked),
rest AS (
  SELECT conv_id, n AS i, [0, 6, 3, 0]::BIGINT[] AS b FROM convs
  UNION ALL
  SELECT conv_id, i, [least(s, 3 + u), least(y, 3 + u), least(u, 3 + a), least(a, 3 + u)] FROM (
    SELECT r.conv_id, r.i - 1 AS i,
      least(4 + b[1], CASE WHEN c = 's' THEN x + b[2] WHEN c = 'u' THEN x + b[3] END, 3 + x + b[3]) AS s,
      least(4 + b[2], CASE WHEN c = 'u' THEN x + b[3] END, 3 + x + b[3]) AS y,
      least(4 + b[3], CASE WHEN c = 'a' THEN x + b[4] END, 3 + x + b[4]) AS u,
      least(4 + b[4], CASE WHEN c = 'u' THEN x + b[3] END, 3 + x + b[3]) AS a
    FROM rest r JOIN steps t ON t.conv_id IS NOT DISTINCT FROM r.conv_id AND t.i = r.i)),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, 1 AS q, '' AS audit, []::VARCHAR[] AS said FROM convs
  UNION ALL
  SELECT conv_id, CASE letter WHEN 'I' THEN i ELSE i + 1 END,
    CASE WHEN letter = 'D' THEN q WHEN letter = 'K' AND c = 's' THEN 2 ELSE follower END,
    audit || letter,
    CASE letter WHEN 'D' THEN said WHEN 'K' THEN list_append(said, role || ':' || text)
      ELSE list_append(said, CASE follower WHEN 3 THEN 'user:' ELSE 'assistant:' END || CASE letter WHEN 'I' THEN '' ELSE text END) END
  FROM (
    SELECT w.*, t.c, t.role, t.text, CASE w.q WHEN 3 THEN 4 ELSE 3 END AS follower,
      CASE WHEN 4 + later.b[w.q] = here.b[w.q] THEN 'D'
        WHEN 3 + here.b[CASE w.q WHEN 3 THEN 4 ELSE 3 END] = here.b[w.q] THEN 'I'
        WHEN t.c = 's' AND w.q = 1 AND t.x + later.b[2] = here.b[1] THEN 'K'
        WHEN t.c = CASE w.q WHEN 3 THEN 'a' ELSE 'u' END AND t.x + later.b[CASE w.q WHEN 3 THEN 4 ELSE 3 END] = here.b[w.q] THEN 'K'
        ELSE 'R' END AS letter
    FROM walk w JOIN rest here ON here.conv_id IS NOT DISTINCT FROM w.conv_id AND here.i = w.i
      LEFT JOIN rest later ON later.conv_id IS NOT DISTINCT FROM w.conv_id AND later.i = w.i + 1
      LEFT JOIN steps t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1
    WHERE NOT (later.i IS NULL AND w.q IN (1, 4))))
SELECT c.conv_id, gaps, blank, duplicate, truncated, illegal, r.b[1] AS cost, w.audit, sha256(coalesce(array_to_string(w.said, chr(10)), '')) AS repaired_sha256
FROM convs c JOIN rest r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.i = 0
  JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n AND w.q IN (1, 4)
"""
