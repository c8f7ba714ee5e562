"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate, found by cost layers of grammar states.

For each increasing cost there is, at every turn, a bitset of the grammar states from which the rest can be repaired at exactly that cost. The
first layer in which the start accepts gives the cost, and a walk along the bits gives the least audit. A block of turns is solved for all
entries and exits at once, so that a conversation of any length is cut into chunks that meet by their costs alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CRC, CRC_TABLE, stored

#: Grammar states: nothing yet, a system turn, a user turn, an assistant turn. Only these accept: nothing, and an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state behind a further user or assistant turn; only one of the two may follow.
STEP = (USER, USER, ASSISTANT, USER)
#: Cost and edits from each state to an accepting one, after all turns.
END_COST, END_AUDIT = (0, 4, 2, 0), ("", "II", "I", "")
#: Fixed values of the contract: costs of edits, of an undeleted truncated turn.
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: Whatever the rest is, the cheapest exit of a block is at most this much worse than any other exit, so dearer ones are no part of a cheapest repair.
SLACK = 5
FAR = 1 << 40
#: Turns that are solved at once, and turns of a chunk, the largest part of a conversation that a task holds.
BLOCK, CHUNK = 32, 8192
_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
_INITIALS = "sua"
_NONE, _BLANK, _REPEATED, _CUT = range(4)
_ROLES = {USER: "user", ASSISTANT: "assistant"}


def _pre(x: int) -> int:
    """States from which one further turn leads into the states of ``x``. Four bitsets, one for each exit, lie side by side in a number."""
    return ((x >> USER) & 0x1111) * 0b1011 | ((x >> ASSISTANT) & 0x1111) * 0b0100


def _kept(x: int, initial: int) -> int:
    """States from which a turn with this initial leads into the states of ``x``."""
    if initial == 0:
        return (x >> SYSTEM) & 0x1111
    if initial == 1:
        return ((x >> USER) & 0x1111) * 0b1011
    return ((x >> ASSISTANT) & 0x1111) * 0b0100 if initial == 2 else 0


class Block(NamedTuple):
    """cost and rank by entry * 4 + exit. rank orders the exits of an entry by their least audit."""

    cost: list[int]
    rank: list[int]
    audit: list[str]


def layers(codes: bytes) -> list[list[int]]:
    """layers[c][i]: for each exit, the states before turn i from which turns i and later lead to that exit at cost c. A code is initial + 4 * fault. Layers end where no further one can matter."""
    n, found, out = len(codes), [FAR] * 4, []
    none = [0] * (n + 1)
    cost = 0
    while cost <= max(found) + SLACK:
        two, three = out[cost - INSERT] if cost >= INSERT else none, out[cost - DELETE] if cost >= DELETE else none
        row = [0] * (n + 1)
        if not cost:
            row[n] = 0x8421
        out.append(row)
        for i in range(n - 1, -1, -1):
            fault, initial = codes[i] >> 2, codes[i] & 3
            x = three[i + 1] | _pre(two[i])
            if fault in (_NONE, _CUT):
                more = CUT_OFF if fault == _CUT else 0
                if cost >= more:
                    x |= _kept(out[cost - more][i + 1], initial)
                if cost >= REROLE + more:
                    x |= _pre(out[cost - REROLE - more][i + 1])
            row[i] = x
        for p in range(4):
            if found[p] == FAR and row[0] >> p & 0x1111:
                found[p] = cost
        cost += 1
    return out


def _trace(codes: bytes, by_cost: list[list[int]], state: int, exit_: int, cost: int) -> str:
    """The ASCII-least edits from a state to an exit at exactly this cost."""
    i, out, last = 0, [], len(codes)
    shift = 4 * exit_

    def there(c: int, at: int, to: int) -> bool:
        return c >= 0 and bool(by_cost[c][at] >> (shift + to) & 1)

    while i < last:
        fault, initial = codes[i] >> 2, codes[i] & 3
        more = CUT_OFF if fault == _CUT else 0
        follows = (SYSTEM if state == START else -1, -1 if state == USER else USER, ASSISTANT if state == USER else -1, -1)[initial]
        if there(cost - DELETE, i + 1, state):
            letter, cost, i = "D", cost - DELETE, i + 1
        elif there(cost - INSERT, i, STEP[state]):
            letter, cost, state = "I", cost - INSERT, STEP[state]
        elif fault in (_NONE, _CUT) and follows >= 0 and there(cost - more, i + 1, follows):
            letter, cost, state, i = "K", cost - more, follows, i + 1
        else:
            letter, cost, state, i = "R", cost - REROLE - more, STEP[state], i + 1
        out.append(letter)
    return "".join(out)


def solve(codes: bytes) -> Block:
    """Costs, ranks and least audits of a block, for every entry and exit. Edits in front of a turn belong to its block, those behind the last turn do not."""
    by_cost = layers(codes)
    cost, audit = [FAR] * 16, [""] * 16
    for c, row in enumerate(by_cost):
        for p in range(4):
            for q in range(4):
                if row[0] >> (4 * q + p) & 1 and cost[4 * p + q] == FAR:
                    cost[4 * p + q] = c
                    audit[4 * p + q] = _trace(codes, by_cost, p, q, c)
    return Block(cost, _ranked(cost, audit), audit)


def _ranked(cost: list[int], key: list) -> list[int]:
    """For each entry, the place of each exit in the order of keys."""
    rank = [0] * 16
    for p in range(4):
        for place, q in enumerate(sorted((q for q in range(4) if cost[4 * p + q] < FAR), key=lambda q: key[4 * p + q])):
            rank[4 * p + q] = place
    return rank


def joined(parts: Iterable[tuple[list[int], list[int]]]) -> tuple[list[int], list[int]]:
    """(cost, rank) of neighbouring parts taken as one. No audit is a beginning of another one of the same entry, so ranks decide in order."""
    cost, rank = [0 if p == q else FAR for p in range(4) for q in range(4)], [0] * 16
    for c2, r2 in parts:
        best, key = [FAR] * 16, [(0, 0)] * 16
        for p in range(4):
            for r in range(4):
                found = min((cost[4 * p + q] + c2[4 * q + r], rank[4 * p + q], r2[4 * q + r]) for q in range(4))
                if found[0] < FAR:
                    best[4 * p + r], key[4 * p + r] = found[0], found[1:]
        cost, rank = best, _ranked(best, key)
    return cost, rank


def route(parts: list[tuple[list[int], list[int]]], state: int, end: Iterable[int]) -> list[int]:
    """States at the borders of the parts, first to last, on the cheapest way with the least audit. ``end`` is the cost behind each last state."""
    rest = [list(end)]
    for cost, _ in reversed(parts):
        rest.append([min(cost[4 * p + q] + rest[-1][q] for q in range(4)) for p in range(4)])
    out = [state]
    for k, (cost, rank) in enumerate(parts):
        after = rest[len(parts) - 1 - k]
        p = out[-1]
        out.append(min(range(4), key=lambda q: (cost[4 * p + q] + after[q], rank[4 * p + q])))
    return out


def _blocks(codes: bytes) -> list[Block]:
    return [solve(codes[at : at + BLOCK]) for at in range(0, len(codes), BLOCK)]


def chunk_audit(codes: bytes, state: int, exit_: int) -> str:
    """The least edits of a chunk between two known states."""
    blocks = _blocks(codes)
    states = route([b[:2] for b in blocks], state, [0 if q == exit_ else FAR for q in range(4)])
    return "".join(b.audit[4 * p + q] for b, p, q in zip(blocks, states, states[1:], strict=False))


# --- Columns -----------------------------------------------------------------------------------------------------


def initial_of(role: Column) -> Column:
    """0, 1, 2 for system, user, assistant; 3 for any other initial."""
    at = F.instr(F.lit(_INITIALS), F.substring(role, 1, 1))
    return F.when((F.length(role) == 0) | (at == 0), 3).otherwise(at - 1)


def bare(text: Column) -> Column:
    """The text without blanks at its end."""
    return F.rtrim(text, F.lit(_BLANKS))


def damaged(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with planted faults, by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes it the user's. Nulls are one space, but an order or an id may be null."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    own = turns.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), (F.crc32(F.concat(space(id_col), F.lit(":"), space(turn_col)).cast("binary")) % 20).alias("fault")
    )
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    out = own.where("fault <> 0").select("conv_id", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), "fault")
    return out.withColumn("again", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("fault", "again")


def _keyed(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, and a digest of role and text by which equal ones are told."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"))


def _codes(keyed: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, code) in no order, equal rows as one. A text that was there at an earlier turn is repeated; equal rows of one turn are told where they are read."""
    stripped = bare(F.col("text"))
    fault = F.when(stripped == "", _BLANK).when(F.right(stripped, F.lit(1)).isin(".", "!", "?"), _NONE).otherwise(_CUT)
    slim = keyed.select("conv_id", "turn", "digest", initial_of(F.col("role")).alias("initial"), fault.alias("fault"))
    slim = slim.groupBy("conv_id", "turn", "digest").agg(F.max("initial").alias("initial"), F.max("fault").alias("fault"))
    order = F.struct(F.col("turn").isNotNull().alias("told"), F.col("turn").alias("turn"))
    first = slim.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("c", "d", F.col("first.turn").alias("t"))
    met = slim.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    again = F.col("d").isNotNull() & ~F.col("turn").eqNullSafe(F.col("t")) & (F.col("fault") != _BLANK)
    return met.select("conv_id", "turn", "digest", (F.col("initial") + 4 * F.when(again, _REPEATED).otherwise(F.col("fault"))).cast("int").alias("code"))


# --- Tasks -------------------------------------------------------------------------------------------------------


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batched(rows: Iterable[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if len(held) >= size or weight > 4_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """From sorted (conv_id, turn, digest, code): one row for each chunk of a conversation, with its first turn and digest, codes and summary. The order of chunks is that of their numbers."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 40
    key, codes = None, bytearray()
    for conv, turn, digest, code in _rows(batches):
        if key is not None and (conv != key[0] or len(codes) == CHUNK):
            yield number, *key, bytes(codes), *joined(b[:2] for b in _blocks(bytes(codes)))
            key, number = None, number + 1
            codes.clear()
        key = key or (conv, turn, digest)
        codes.append(code)
    if key is not None:
        yield number, *key, bytes(codes), *joined(b[:2] for b in _blocks(bytes(codes)))


def _routed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """From (conv_id, chunk, cost, rank) sorted: (chunk, entry, exit). A conversation's summaries are held, one of some 300 bytes for CHUNK turns."""
    conv, held = None, []

    def done() -> Iterator[tuple]:
        states = route([h[1:] for h in held], START, END_COST)
        for k, (chunk, *_) in enumerate(held):
            yield chunk, states[k], states[k + 1]

    for c, chunk, cost, rank in _rows(batches):
        if held and c != conv:
            yield from done()
            held = []
        conv = c
        held.append((chunk, cost, rank))
    if held:
        yield from done()


def _followed(batches: Iterator[pa.RecordBatch], report: bool) -> Iterator[tuple]:
    """From one conversation after the other, each with a row for itself, then chunks in front of their turns: its report, or its repaired turns. Only a chunk and, for reports, the audit are held."""
    conv, open_ = None, False
    codes, edits, at, chunk_at = b"", "", 0, 0
    count = [0, 0, 0]
    audit: list[str] = []
    hasher, lines, state, before, initial = hashlib.sha256(), 0, START, None, -1
    low = high = None
    distinct = illegal = cost = place = 0

    def made(letter: str, role: str, text: str) -> list[tuple]:
        nonlocal lines, place
        if report:
            hasher.update((("\n" if lines else "") + f"{role}:{text}").encode())
        lines += 1
        place += 1
        return [] if report else [(conv, place - 1, letter, role, text)]

    def inserted() -> list[tuple]:
        nonlocal state, cost
        state, cost = STEP[state], cost + INSERT
        audit.append("I")
        return made("I", _ROLES[state], "")

    def closed() -> list[tuple]:
        out = []
        for _ in END_AUDIT[state]:
            out += inserted()
        if report:
            out = [(conv, (high - low + 1 - distinct) if distinct else 0, *count, illegal, cost, "".join(audit), hasher.hexdigest())]
        return out

    for c, kind, turn, digest, role, text, own_codes, entry, leaves in _rows(batches):
        if not open_ or c != conv:
            if open_:
                yield from closed()
            conv, open_ = c, True
            codes, edits, at, chunk_at = b"", "", 0, 0
            count, audit = [0, 0, 0], []
            hasher, lines, state, before, initial = hashlib.sha256(), 0, START, None, -1
            low = high = None
            distinct = illegal = cost = place = 0
        if kind == 0:
            continue
        if kind == 1:
            codes, edits, at, chunk_at = own_codes, chunk_audit(own_codes, entry, leaves), 0, 0
            continue
        now = (_INITIALS + " ").find(role[:1] or " ")
        illegal += before is not None and (initial, now) not in ((0, 1), (1, 2), (2, 1))
        initial = now
        if turn is not None:
            distinct += before is None or before[0] != turn
            low, high = turn if low is None else low, turn
        if (turn, digest) == before:
            # An equal row of the same turn: repeated, or blank as the first one.
            count[0 if codes[chunk_at - 1] >> 2 == _BLANK else 1] += 1
            audit.append("D")
            cost += DELETE
            continue
        before = (turn, digest)
        fault = codes[chunk_at] >> 2
        if fault:
            count[fault - 1] += 1
        chunk_at += 1
        while edits[at] == "I":
            at += 1
            yield from inserted()
        letter, at = edits[at], at + 1
        audit.append(letter)
        if letter == "D":
            cost += DELETE
            continue
        cost += CUT_OFF if fault == _CUT else 0
        if letter == "R":
            state, cost = STEP[state], cost + REROLE
            role = _ROLES[state]
        else:
            state = (SYSTEM, USER, ASSISTANT)[now]
        yield from made(letter, role, text)
    if open_:
        yield from closed()


def _solved(turns: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Rows that _followed reads: conversations, chunks and turns, hashed by conversation and sorted."""
    keyed = _keyed(turns)
    id_type, turn_type = keyed.schema["conv_id"].dataType, keyed.schema["turn"].dataType
    ordered = _codes(keyed).repartitionByRange("conv_id", "turn", "digest").sortWithinPartitions("conv_id", "turn", "digest")
    sixteen = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField(n, t) for n, t in (("chunk", T.LongType()), ("conv_id", id_type), ("turn", turn_type), ("digest", T.BinaryType()), ("codes", T.BinaryType()), ("cost", sixteen), ("rank", sixteen))])
    chunks = stored(ordered.mapInArrow(_arrow(_chunked, schema), schema))
    spec = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("entry", T.IntegerType()), T.StructField("leaves", T.IntegerType())])
    states = chunks.select("conv_id", "chunk", "cost", "rank").repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(_arrow(_routed, spec), spec)
    null = lambda t, n: F.lit(None).cast(t).alias(n)  # noqa: E731
    told = chunks.join(states, "chunk").select("conv_id", F.lit(1).alias("kind"), "turn", "digest", null("string", "role"), null("string", "text"), "codes", "entry", "leaves")
    own = keyed.select("conv_id", F.lit(2).alias("kind"), "turn", "digest", "role", "text", null("binary", "codes"), null("int", "entry"), null("int", "leaves"))
    names = (keyed if ids is None else ids).select("conv_id").distinct()
    heads = names.select("conv_id", F.lit(0).alias("kind"), null(turn_type, "turn"), null("binary", "digest"), null("string", "role"), null("string", "text"), null("binary", "codes"), null("int", "entry"), null("int", "leaves"))
    # A null digest, which only conversations have, comes first.
    return heads.unionByName(told).unionByName(own).repartition("conv_id").sortWithinPartitions("conv_id", F.col("kind") != 0, "turn", "digest", "kind")


def _arrow(rows, schema: T.StructType, *more):
    """``rows`` as a function of Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema

    made = to_arrow_schema(schema)
    return lambda batches: _batched(rows(batches, *more), made)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of each conversation(conv_id, turn, role, text) after the cheapest edits; deleted ones are left out.

    Rows go by turn, nulls first, and ties of a turn by a digest of role and text. A turn is blank, repeated (role and text seen earlier in its
    conversation), or truncated (no ``[.!?]`` at its end). Blank and repeated ones are deleted (3); others are kept (0), given another role
    (2) or deleted (3); empty turns may be inserted (2); a truncated turn that stays costs 1 more. Of edits of equal cost the ASCII-least are taken.

    Null roles and texts are one space, so such a text is blank, and such a role has to be changed. Rows of null ids are one conversation. Repeated rows
    are repeated turns; long texts are whole; an empty table gives an empty result; other columns are ignored.

    Turns are sorted by ranges of conversation and turn, so that a conversation with a third of all rows lies in many tasks, and solved in chunks; summaries of
    chunks, one for CHUNK turns, meet by conversation. The repaired turns of one conversation come from one task that streams them: it holds one chunk.
    """
    schema = T.StructType([T.StructField("conv_id", turns.schema["conv_id"].dataType), T.StructField("place", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("edit", "role", "text")]])
    return _solved(turns, None).mapInArrow(_arrow(_followed, schema, False), schema)


def repair_report(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row for each conversation of ``turns``, and of ``ids(conv_id)`` if given: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    gaps: turns missing between the least and the greatest. illegal: neighbours whose roles do not alternate. audit: initials of the edits in order. The hash is of
    the repaired ``role:text`` lines; it is one sequence of bytes a conversation and so one task's work, which streams. A conversation without rows has zeros, an empty audit and the hash of nothing.
    Nulls, repeats, long texts, ties, empty tables and other columns: as in ``repaired_turns``.
    """
    numbers = [T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    schema = T.StructType([T.StructField("conv_id", turns.schema["conv_id"].dataType), *numbers, T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    return _solved(turns, ids).mapInArrow(_arrow(_followed, schema, True), schema)


#: DuckDB over ``conversations``: states of the roles are carried from turn to turn with their least cost and least audit. Up to two inserted turns may come before each edit.
ORACLE_SQL = rf"""
with recursive {CRC_TABLE},
own as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {CRC.format("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as fault from conversations, crc_table),
hurt as (
  select conv_id, turn, case when fault = 4 then 'user' else role end as role, case fault when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
         unnest(case when fault = 3 then [0, 1] else [0] end) as again from own where fault <> 0),
placed as (
  select conv_id, turn, role, text, rtrim(text, E' 	

') as bare, role || ':' || text as line,
         row_number() over (partition by conv_id order by turn nulls first, unhex(sha256(length(role) || ':' || role || text))) as i from hurt),
faulty as (
  select *, substring(role, 1, 1) as initial, case when bare = '' then 1 when row_number() over (partition by conv_id, role, text order by i) > 1 then 2 when right(bare, 1) not in ('.', '!', '?') then 3 else 0 end as fault from placed),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated,
         count(*) filter (met is not null and met || initial not in ('su', 'ua', 'au')) as illegal, max(i) as n
  from (select *, lag(initial) over (partition by conv_id order by i) as met from faulty) group by conv_id),
step(p, q, letter) as (values ('', 'u', 'I'), ('s', 'u', 'I'), ('u', 'a', 'I'), ('a', 'u', 'I')),
before as (
  select p, p as q, '' as audit, 0 as cost, '' as made from (values ('', 1), ('s', 1), ('u', 1), ('a', 1)) v(p, x)
  union all select p, q, 'I', 2, case q when 'u' then 'user:' else 'assistant:' end from step
  union all select a.p, b.q, 'II', 4, case a.q when 'u' then E'user:
assistant:' else E'assistant:
user:' end from step a join step b on a.q = b.p),
moves as (
  select before.p, initial, fault, before.audit || edit as audit, before.cost + case edit when 'D' then 3 when 'R' then 2 else 0 end + case when fault = 3 and edit <> 'D' then 1 else 0 end as cost, made,
         edit, case edit when 'D' then before.q when 'R' then case when before.q = 'u' then 'a' else 'u' end else initial end as q
  from before, (values ('s'), ('u'), ('a'), ('x')) i(initial), range(4) f(fault), (values ('D'), ('R'), ('K')) e(edit)
  where (edit = 'D' or fault in (0, 3)) and (edit <> 'K' or before.q || initial in ('s', 'u', 'su', 'ua', 'au'))),
walk(conv_id, i, q, cost, audit, lines) as (
  select conv_id, 0::bigint, '', 0, '', []::varchar[] from (select distinct conv_id from faulty)
  union all
  select w.conv_id, w.i + 1, m.q, min(w.cost + m.cost), arg_min(w.audit || m.audit, (w.cost + m.cost, w.audit || m.audit)),
         arg_min(w.lines || case when made = '' then []::varchar[] else [made] end || case edit when 'K' then [line] when 'R' then [case m.q when 'u' then 'user:' else 'assistant:' end || f.text] else []::varchar[] end, (w.cost + m.cost, w.audit || m.audit))
  from walk w join faulty f on f.conv_id is not distinct from w.conv_id and f.i = w.i + 1
       join moves m on m.p = w.q and m.fault = f.fault and m.initial = case when f.initial in ('s', 'u', 'a') then f.initial else 'x' end
  group by w.conv_id, w.i, m.q),
ends as (
  select w.conv_id, w.cost + case q when 's' then 4 when 'u' then 2 else 0 end as cost, w.audit || case q when 's' then 'II' when 'u' then 'I' else '' end as audit,
         lines || case q when 's' then ['user:', 'assistant:'] when 'u' then ['assistant:'] else []::varchar[] end as lines
  from walk w join counts c on c.conv_id is not distinct from w.conv_id and c.n = w.i),
best as (select conv_id, min(cost) as cost, arg_min(audit, (cost, audit)) as audit, arg_min(lines, (cost, audit)) as lines from ends group by conv_id)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
       coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, sha256(coalesce(array_to_string(lines, E'
'), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counts c on c.conv_id is not distinct from o.conv_id left join best b on b.conv_id is not distinct from o.conv_id
"""
