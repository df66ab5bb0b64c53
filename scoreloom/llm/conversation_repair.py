"""Conversation structure repair by a square-root checkpointed dynamic program.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles. Four states
tell how far a reading is: nothing yet, a system turn, a user turn, a whole pair.
Backward, the cost of the cheapest repair of all later turns is a vector of four
numbers. A stretch of n turns stores this vector only every √n turns; walking
forward, each block's vectors are made again from its checkpoint, and at every turn
the first of Delete, Insert, Keep and Rerole that costs no more than the best is
taken, which spells the least string of edits.

Turns are ordered by ranges of (conversation, turn), so a conversation of any
length is many stretches, one a task. A stretch that does not hold a whole
conversation sends the matrix of its costs from state to state; a conversation's
few matrices give each stretch the vector behind it, each stretch is walked from
every state, and the states where the stretches meet choose among the walks.

Defined results: turns are ordered by turn (nulls first), then role, then text;
rows alike in all of these are interchangeable; a null conversation id is a
conversation; null roles and texts are taken as ``NULL_AS``; blank or repeated
turns are deleted; roles that begin otherwise are reroled or deleted; texts of any
length are not cut; other columns, whatever their names, are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.shared import materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NULL_AS = " "
#: Faults of a turn; the first that holds counts.
FINE, BLANK, DUPLICATE, CUT = range(4)
FAULTS = ("", "blank", "duplicate", "truncated")
#: Initials that a code may have; any other is the last.
INITIALS = "sua"
#: Where an inserted or reroled turn leads from each state, and what it is.
AFTER, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}
FAR = 1 << 60
#: The cost vector behind the last turn: pairs left open are completed by insertion.
END = (0, 2 * INSERT, INSERT, 0)


def edits(code: int, state: int) -> list[tuple[str, int, int]]:
    """``(letter, cost, next state)`` of what may be done with a turn, by letter. A code is 4 x fault + initial."""
    fault, initial = code >> 2, (*INITIALS, "")[code & 3]
    found = [("D", DELETE, state)]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT else 0
        if (initial, state) in KEPT:
            found.append(("K", KEEP + more, KEPT[initial, state]))
        found.append(("R", REROLE + more, AFTER[state]))
    return found


EDITS = [[edits(code, state) for state in range(4)] for code in range(16)]


def _with_inserts(v: list[int]) -> tuple[int, ...]:
    for _ in range(2):
        v = [min(v[s], INSERT + v[AFTER[s]]) for s in range(4)]
    return tuple(v)


def before(code: int, v: tuple[int, ...]) -> tuple[int, ...]:
    """The cost vector before a turn, from the one behind it."""
    low = min(v)
    # Differences are few, whatever the costs; what cannot be reached stays so.
    return tuple(min(FAR, x + low) for x in _before(code, tuple(FAR if x >= FAR // 2 else x - low for x in v)))


@cache
def _before(code: int, v: tuple[int, ...]) -> tuple[int, ...]:
    return _with_inserts([min(cost + v[to] for _, cost, to in EDITS[code][s]) for s in range(4)])


def matrix(codes: bytes) -> list[int]:
    """The cheapest way through ``codes`` from each state to each other, by rows."""
    columns = []
    for to in range(4):
        v = tuple(0 if s == to else FAR for s in range(4))
        for code in reversed(codes):
            v = before(code, v)
        columns.append(v)
    return [columns[to][s] for s in range(4) for to in range(4)]


def walk(codes: bytes, end: tuple[int, ...], state: int, last: bool) -> tuple[bytes, int]:
    """The least string of cheapest edits through ``codes`` from ``state``, and the state behind them; ``last``: nothing follows."""
    n = len(codes)
    width = max(1, isqrt(n))
    checkpoints, v = {}, end
    for i in range(n - 1, -1, -1):
        if (i + 1) % width == 0 or i == n - 1:
            checkpoints[i // width] = v
        v = before(codes[i], v)
    out = bytearray()
    for block in range(-(-n // width)):
        low, high = block * width, min(n, (block + 1) * width)
        vectors = [checkpoints[block]]
        for i in range(high - 1, low - 1, -1):
            vectors.append(before(codes[i], vectors[-1]))
        vectors.reverse()
        for i in range(low, high):
            now, then = vectors[i - low], vectors[i - low + 1]
            while True:
                delete, *rest = EDITS[codes[i]][state]
                if delete[1] + then[state] == now[state]:
                    letter, to = "D", state
                elif INSERT + now[AFTER[state]] == now[state]:
                    out += b"I"
                    state = AFTER[state]
                    continue
                else:
                    letter, to = next((a, t) for a, cost, t in rest if cost + then[t] == now[state])
                out += letter.encode()
                state = to
                break
    while last and END[state]:
        out += b"I"
        state = AFTER[state]
    return bytes(out), state


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turn, role, text)`` with faults that the checksum of ``conv_id:turn`` decides: dropped, emptied, unpunctuated, repeated and user turns."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NULL_AS))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), plain(role_col).alias("role"), plain(text_col).alias("text"))
    kind = F.crc32(F.encode(F.concat_ws(":", plain("conv_id"), plain("turn")), "UTF-8")) % 20
    rows = rows.withColumn("kind", kind).where(F.col("kind") != 0)
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times)).drop("col")


def _code(first: Column) -> Column:
    text = F.regexp_extract("text", "([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$", 1)
    fault = F.when(text == "", BLANK).when(~first, DUPLICATE).when(~text.isin(".", "!", "?"), CUT).otherwise(FINE)
    initial = F.substring("role", 1, 1)
    place = F.lit(len(INITIALS))
    for i, c in enumerate(INITIALS):
        place = F.when(initial == c, i).otherwise(place)
    return (fault * 4 + place).cast("int")


def _ordered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``place``, which rises along conversations and turns; the partition is its upper bits. Rows of one conversation may lie in several partitions."""
    # The start of the text parts rows of equal turn; what is alike so far is ordered inside its task.
    dealt = rows.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 32))
    placed = dealt.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text").withColumn("place", F.monotonically_increasing_id())
    return materialize(placed, "turns")


def _part() -> Column:
    return F.shiftright("place", 33).alias("part")


_SEGMENT = "part long, conv_id long, place long, codes binary, costs array<long>"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The codes of each conversation in a part, in order; the first and the last of a part, which may go on elsewhere, with their matrices."""
    done, now, codes = [], None, bytearray()

    def end(edge: bool) -> None:
        part, conv, place, first = now
        done.append({"part": part, "conv_id": conv, "place": place, "codes": bytes(codes), "costs": matrix(codes) if edge or first else None})

    def written() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pylist(done, pa.schema([("part", pa.int64()), ("conv_id", pa.int64()), ("place", pa.int64()), ("codes", pa.binary()), ("costs", pa.list_(pa.int64()))]))
        done.clear()
        return out

    for batch in batches:
        for part, conv, place, code in zip(*(batch.column(c).to_pylist() for c in ("part", "conv_id", "place", "code")), strict=True):
            if now is None or now[:2] != (part, conv):
                if now:
                    end(now[0] != part)
                now = (part, conv, place, now is None or now[0] != part)
                codes.clear()
            codes.append(code)
        if len(done) >= 10_000:
            yield written()
    if now:
        end(True)
        yield written()


def _ends(pdf: pd.DataFrame) -> pd.DataFrame:
    """The cost vector behind each stretch of a conversation: its matrices from the last to the first."""
    pdf = pdf.sort_values("place")
    v, out = END, []
    for costs in pdf["costs"][::-1]:
        out.append(list(v))
        m = np.reshape(np.array(costs, dtype=np.int64), (4, 4))
        v = tuple(int(x) for x in np.minimum(m + np.array(v), FAR).min(axis=1))
    n = len(pdf)
    return pd.DataFrame({"place": pdf["place"], "end": out[::-1], "first": [True] + [False] * (n - 1), "last": [False] * (n - 1) + [True]})


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            whole = row["end"] is None
            starts = range(1 if whole or row["first"] else 4)
            ways = [walk(row["codes"], END if whole else tuple(row["end"]), s, whole or row["last"]) for s in starts]
            out.append({"part": row["part"], "conv_id": row["conv_id"], "place": row["place"], "codes": row["codes"], "walks": [w for w, _ in ways], "exits": [s for _, s in ways], "whole": whole})
        yield pa.RecordBatch.from_pylist(out, _WALKED)


_WALKED = pa.schema([("part", pa.int64()), ("conv_id", pa.int64()), ("place", pa.int64()), ("codes", pa.binary()), ("walks", pa.list_(pa.binary())), ("exits", pa.list_(pa.int32())), ("whole", pa.bool_())])


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state in which each stretch of a conversation begins."""
    pdf, state, out = pdf.sort_values("place"), 0, []
    for exits in pdf["exits"]:
        out.append(state)
        state = int(exits[min(state, len(exits) - 1)])
    return pd.DataFrame({"place": pdf["place"], "start": out})


_LOG = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("step", pa.int32()), ("edit", pa.string()), ("turn", pa.int64()), ("was", pa.string()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string()), ("cost", pa.int64())])


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each stretch's edits, then its turns: one row an edit."""
    letters, codes, at, turn_no, state, size = b"", b"", 0, 0, 0, 0
    out = []

    def written() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _LOG, strict=True)], schema=_LOG)
        out.clear()
        return rows

    def inserts(conv: int, place: int, step: int) -> None:
        nonlocal at, state
        while letters[at : at + 1] == b"I":
            out.append((conv, place, step, "I", None, None, ROLE[state], "", None, INSERT))
            state, at, step = AFTER[state], at + 1, step + 1

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "turn", "role", "text", "codes", "letters", "start")), strict=True):
            conv, place, turn, role, text, own, found, start = row
            if own is not None:
                letters, codes, at, turn_no, state = found, own, 0, 0, start
                continue
            # Inserted turns before this one have steps below 0, those behind the last one above.
            ahead = len(letters) - at - len(letters[at:].lstrip(b"I")) if letters[at : at + 1] == b"I" else 0
            inserts(conv, place, -ahead)
            letter, code = chr(letters[at]), codes[turn_no]
            cost, to = next((c, t) for a, c, t in EDITS[code][state] if a == letter)
            out.append((conv, place, 0, letter, turn, role, None if letter == "D" else ROLE[state] if letter == "R" else role, None if letter == "D" else text, FAULTS[code >> 2], cost))
            state, at, turn_no = to, at + 1, turn_no + 1
            if turn_no == len(codes):
                inserts(conv, place, 1)
            size += len(text)
            if size >= 4 << 20 or len(out) >= 10_000:
                yield written()
                size = 0
    if out:
        yield written()


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row an edit: ``(conv_id, place, step, edit, turn, was, role, text, fault, cost)``.

    ``place`` and ``step`` order the edits; ``was`` is the role before, ``role`` and
    ``text`` what stands afterwards (null if deleted).
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NULL_AS))
    rows = _ordered(turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), plain(role_col).alias("role"), plain(text_col).alias("text")))
    # The first turn that says a thing in its role; a digest stands for the text, and partial minima for common texts.
    firsts = rows.groupBy("conv_id", "role", F.sha2(F.col("text").cast("binary"), 256)).agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    seen = rows.select("conv_id", "place", _code(F.lit(True)).alias("own"))
    coded = seen.join(firsts, "place", "left").select(_part(), "conv_id", "place", F.when(F.col("first").isNull() & (F.shiftright("own", 2) != BLANK), F.lit(DUPLICATE * 4) + F.col("own") % 4).otherwise(F.col("own")).alias("code"))
    segments = materialize(coded.repartition("part").sortWithinPartitions("part", "place").mapInArrow(_segments, _SEGMENT), "segments")
    edges = segments.where(F.col("costs").isNotNull())
    ends = edges.select("conv_id", "place", "costs").groupBy("conv_id").applyInPandas(_ends, "place long, end array<long>, first boolean, last boolean")
    walked = materialize(segments.drop("costs").join(ends, "place", "left").mapInArrow(_walks, "part long, conv_id long, place long, codes binary, walks array<binary>, exits array<int>, whole boolean"), "walks")
    starts = walked.where(~F.col("whole")).select("conv_id", "place", "exits").groupBy("conv_id").applyInPandas(_meet, "place long, start int")
    chosen = walked.join(starts, "place", "left").withColumn("start", F.coalesce("start", F.lit(0)))
    nothing = lambda name, kind: F.lit(None).cast(kind).alias(name)
    heads = chosen.select("part", "conv_id", "place", nothing("turn", "long"), nothing("role", "string"), nothing("text", "string"), "codes", F.get("walks", F.col("start")).alias("letters"), "start")
    bodies = rows.select(_part(), "conv_id", "place", "turn", "role", "text", nothing("codes", "binary"), nothing("letters", "binary"), nothing("start", "int"))
    dealt = heads.union(bodies).repartition("part").sortWithinPartitions("part", "place", F.col("codes").isNull())
    return dealt.mapInArrow(_applied, "conv_id long, place long, step int, edit string, turn long, was string, role string, text string, fault string, cost long")


_DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_digest(log: DataFrame, conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row for each conversation of ``conversations``. SHA-256 is sequential, so a conversation's edits pass one task, in order and constant memory but for the audit."""
    names = [c.split()[0] for c in _DIGEST.split(", ")]
    legal = {"su", "ua", "au"}

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now = [], None

        def end() -> None:
            low, high, distinct = now["turns"]
            gaps = 0 if low is None else high - low + 1 - distinct
            done.append((now["conv"], gaps, *(now[f] for f in FAULTS[1:]), now["illegal"], now["cost"], now["audit"].decode(), now["sha"].hexdigest()))

        def written() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names)
            done.clear()
            return out

        for batch in batches:
            for conv, edit, turn, was, role, text, fault, cost in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edit", "turn", "was", "role", "text", "fault", "cost")), strict=True):
                if now is None or now["conv"] != conv:
                    if now:
                        end()
                    now = {"conv": conv, "turns": (None, None, 0), "illegal": 0, "cost": 0, "audit": bytearray(), "sha": hashlib.sha256(), "begun": False, "was": None} | dict.fromkeys(FAULTS, 0)
                if edit is None:
                    continue
                now["audit"] += edit.encode()
                now["cost"] += cost
                if edit != "I":
                    now[fault] += 1
                    now["illegal"] += now["was"] is not None and now["was"] + was[:1] not in legal
                    now["was"] = was[:1]
                    if turn is not None:
                        low, high, distinct = now["turns"]
                        now["turns"] = (turn if low is None else low, turn, distinct + (turn != high))
                if edit != "D":
                    now["sha"].update((("\n" if now["begun"] else "") + f"{role}:{text}").encode())
                    now["begun"] = True
            if len(done) >= 10_000:
                yield written()
        if now:
            end()
            yield written()

    # A row without an edit for each conversation, also for those of which nothing is left.
    every = conversations.select(F.col(conv_col).cast("long").alias("conv_id")).distinct()
    heads = every.select("conv_id", *(F.lit(None).cast(f.dataType).alias(f.name) for f in log.schema.fields[1:]))
    rows = heads.union(log).repartition("conv_id").sortWithinPartitions("conv_id", F.col("place").asc_nulls_first(), "step")
    return rows.mapInArrow(digest, _DIGEST)
