"""Conversation structure repair: the cheapest edits that give each conversation the role order `(s?(ua)+)?`, by a time-major tensor programme.

Two passes, each over rows sorted by conversation. The first shuffles no text, only marks of about 40 bytes a row: it gathers whole conversations, buckets them by
length, and moves over a bucket's turns with one NumPy step for all of its conversations, from the last turn to the first, storing the costs of
each turn and state; then it traces all edits forward, one vectorised step an edit. The second streams the texts past each conversation's edits
and hashes the repaired text as it goes, so a task holds marks of one conversation and one text at a time, however long a conversation is. One hash over a conversation's whole
text is what the result asks for, so a conversation's rows end in one task.

Edits: Keep 0, Rerole to user or assistant 1, Delete 2 (blank and duplicate rows must go), Insert an empty user or assistant 5; a truncated row that stays adds 5.
States are what the last kept role was: none, s, u, a. Of equally cheap edits the ASCII-least string counts.

Cases: nulls in text, role and ids are one space (a null conv_id is a conversation, null turns come first); rows of the same turn go by role and digest; repeated rows are
duplicates; a conversation without rows has empty edits; an empty table has no rows; blank texts of any length are found by trimming; other columns are not read.
Rows are the same if two 64-bit hashes of their role and text are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
#: Rows that are gathered before their conversations are repaired, and cells of one tensor.
CHUNK_ROWS, CELLS = 1 << 17, 1 << 21
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
_FAR = np.int32(1 << 29)
#: The next state of the role cycle from each state: u after none, s and a, a after u.
_NEXT = np.array([2, 2, 3, 2])
#: The state after keeping a role of code 0 (other), 1 (s), 2 (u), 3 (a) in each state; -1 is none.
_KEPT = np.array([[-1, 1, 2, -1], [-1, -1, 2, -1], [-1, -1, -1, 3], [-1, -1, 2, -1]])
MARKS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("gone", pa.bool_()), ("role", pa.int8()), ("blank", pa.bool_()), ("cut", pa.bool_()), ("d1", pa.int64()), ("d2", pa.int64())])
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
EDITS = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string())])
RESULT = pa.schema([*EDITS, ("repaired_sha256", pa.string())])
EDITS_DDL = f"conv_id long, {', '.join(f'{c} long' for c in COUNTS)}, audit string"


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with the damage that the CRC-32 of `conv_id:turn` mod 20 names, and gone: 0 the row goes, 1 its text is emptied, 2 loses
    its `[.!?]`, 3 it stands twice, 4 its role is user."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    out = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.when(kind == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return out.withColumn("times", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("times")


def marked(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, gone) with the marks of MARKS; the text stays."""
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    code: Column = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in (("s", 1), ("u", 2), ("a", 3)) for x in kv]), F.left("role", F.lit(1))), F.lit(0))
    d = rows.withColumn("d1", F.xxhash64("role", "text")).withColumn("d2", F.xxhash64("text", F.lit(7), "role"))
    return d.withColumn("code", code.cast("byte")).withColumn("blank", end == "").withColumn("cut", ~F.right(end, F.lit(1)).isin(".", "!", "?"))


def backward(role: np.ndarray, must: np.ndarray, cut: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Cheapest costs [turn, conversation, state] to the end, from before each turn; role codes, must-go and truncated marks are [turn, conversation]."""
    turns, n = role.shape
    cost = np.empty((turns + 1, n, 4), np.int32)
    cost[turns] = [0, 2 * INSERT, INSERT, 0]
    for t in range(turns - 1, -1, -1):
        after = cost[t + 1]
        stay = cut[t] * np.int32(TRUNCATED)
        best = after[:, _NEXT] + (stay + np.int32(REROLE))[:, None]
        kept = _KEPT[:, role[t]].T
        keep = np.where(kept >= 0, np.take_along_axis(after, np.maximum(kept, 0), 1) + stay[:, None], _FAR)
        best = np.where(must[t][:, None], _FAR, np.minimum(best, keep))
        best = np.minimum(best, after + np.int32(DELETE))
        one = best[:, _NEXT] + np.int32(INSERT)
        two = one[:, _NEXT] + np.int32(INSERT)
        best = np.minimum(best, np.minimum(one, two))
        cost[t] = np.where((t < length)[:, None], best, after)
    return cost


def trace(cost: np.ndarray, role: np.ndarray, must: np.ndarray, cut: np.ndarray, length: np.ndarray) -> list[str]:
    """The ASCII-least cheapest edits of each conversation, one vectorised step an edit."""
    n = cost.shape[1]
    at, state, live, steps = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n), []
    while len(live):
        t, s = at[live], state[live]
        now, inside = cost[t, live, s], t < length[live]
        t1 = np.minimum(t + 1, cost.shape[0] - 1)
        row = np.minimum(t, max(0, cost.shape[0] - 2))
        code = role[row, live] if len(role) else np.zeros(len(live), np.int8)
        stay = (cut[row, live] if len(cut) else np.zeros(len(live), bool)) * TRUNCATED
        free = inside & ~(must[row, live] if len(must) else np.zeros(len(live), bool))
        kept = _KEPT[s, code]
        delete = inside & (cost[t1, live, s] + DELETE == now)
        insert = ~delete & (cost[t, live, _NEXT[s]] + INSERT == now)
        keep = ~delete & ~insert & free & (kept >= 0) & (cost[t1, live, np.maximum(kept, 0)] + stay == now)
        rerole = ~delete & ~insert & ~keep & free
        op = np.zeros(n, np.uint8)
        op[live] = np.select([delete, insert, keep, rerole], [ord("D"), ord("I"), ord("K"), ord("R")], 0)
        steps.append(op)
        state[live] = np.select([delete, keep, insert | rerole], [s, kept, _NEXT[s]], s)
        at[live] = t + (delete | keep | rerole)
        live = live[op[live] > 0]
    grid = np.stack(steps, 1) if steps else np.zeros((n, 1), np.uint8)
    return [row[row > 0].tobytes().decode() for row in grid]


def repair(length: np.ndarray, role: np.ndarray, must: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """(cost, edits) of conversations whose rows' marks stand end to end; buckets of like length share a tensor of at most CELLS cells or one conversation."""
    first = np.concatenate([[0], np.cumsum(length)])
    order = np.argsort(length, kind="stable")
    cost, edits, begin = np.zeros(len(length), np.int64), np.full(len(length), "", object), 0
    while begin < len(order):
        shortest, end = length[order[begin]], begin + 1
        while end < len(order) and length[order[end]] <= max(8, 2 * shortest) and (end - begin + 1) * (length[order[end]] + 1) <= CELLS:
            end += 1
        own = order[begin:end]
        size, turns = length[own], int(length[own].max())
        cells = np.minimum(first[own] + np.arange(turns)[:, None], len(role) - 1 if len(role) else 0)
        r, m, c = (x[cells] if len(x) else np.zeros((turns, len(own)), x.dtype) for x in (role, must, cut))
        table = backward(r, m, c, size)
        cost[own] = table[0, :, 0]
        edits[own] = trace(table, r, m, c, size)
        begin = end
    return cost, edits.tolist()


def repaired_rows(rows: pa.Table) -> pa.RecordBatch:
    """EDITS of whole conversations, of rows of MARKS sorted by conversation and turn."""
    ids = rows.column("conv_id").combine_chunks()
    known, value = np.asarray(ids.is_valid()), ids.fill_null(0).to_numpy(zero_copy_only=False)
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (known[1:] != known[:-1])])
    conv, starts = np.cumsum(new) - 1, np.flatnonzero(new)
    n = len(starts)
    here = ~rows.column("gone").to_numpy()
    turns = rows.column("turn").combine_chunks()
    c, role, blank, cut, d1, d2, turn, counted = (x[here] for x in (conv, *[rows.column(k).to_numpy() for k in ("role", "blank", "cut", "d1", "d2")], turns.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(turns.is_valid())))
    order = np.lexsort((np.arange(len(c)), d2, d1, c))
    again = np.zeros(len(c), bool)
    again[order[1:]] = (c[order[1:]] == c[order[:-1]]) & (d1[order[1:]] == d1[order[:-1]]) & (d2[order[1:]] == d2[order[:-1]])
    again &= ~blank
    cut = cut & ~blank & ~again
    sums = lambda mask: np.bincount(c[mask], minlength=n)
    pair = np.stack([role[:-1], role[1:]]) if len(c) else np.zeros((2, 0), np.int8)
    good = ((pair[0] == 1) & (pair[1] == 2)) | ((pair[0] == 2) & (pair[1] == 3)) | ((pair[0] == 3) & (pair[1] == 2))
    illegal = np.bincount(c[1:][(c[1:] == c[:-1]) & ~good], minlength=n)
    cn, tn = c[counted], turn[counted]
    edge = np.concatenate([[True], (cn[1:] != cn[:-1]) | (tn[1:] != tn[:-1])])[: len(cn)]
    gaps = -np.bincount(cn[edge], minlength=n)
    head = np.concatenate([[True], cn[1:] != cn[:-1]])[: len(cn)]
    tail = np.concatenate([cn[1:] != cn[:-1], [True]])[-len(cn) :] if len(cn) else head
    gaps[cn[head]] += tn[tail] - tn[head] + 1
    cost, audit = repair(np.bincount(c, minlength=n), role, blank | again, cut)
    columns = [ids.take(pa.array(starts)), *[pa.array(x, pa.int64()) for x in (gaps, sums(blank), sums(again), sums(cut), illegal, cost)], pa.array(audit, pa.string())]
    return pa.RecordBatch.from_arrays(columns, schema=EDITS)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations of a sorted stream, CHUNK_ROWS rows or one conversation at a time."""
    held: list[pa.RecordBatch] = []
    size, due = 0, CHUNK_ROWS
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size < due:
            continue
        rows = pa.Table.from_batches(held)
        ids = rows.column("conv_id").combine_chunks()
        known, value = np.asarray(ids.is_valid()), ids.fill_null(0).to_numpy(zero_copy_only=False)
        last = int(np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (known[1:] != known[:-1])]))[-1])
        if last:
            yield repaired_rows(rows.slice(0, last))
        held = rows.slice(last).to_batches()
        size -= last
        due = max(CHUNK_ROWS, 2 * size)
    if size:
        yield repaired_rows(pa.Table.from_batches(held))


def plan_edits(rows: DataFrame) -> DataFrame:
    """EDITS of every conversation of marked() rows; no text is shuffled."""
    slim = rows.select("conv_id", "turn", "gone", F.col("code").alias("role"), "blank", "cut", "d1", "d2", F.col("role").alias("__hs_role"))
    return slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "__hs_role", "d1", "d2").drop("__hs_role").mapInArrow(_edits, EDITS_DDL)


class _Writer:
    """The hash of a conversation's repaired text, row by row."""

    def __init__(self, head: dict):
        self.head, self.ops, self.at, self.hash, self.last, self.any = head, head["audit"], 0, hashlib.sha256(), "", False

    def put(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any, self.last = True, role[:1]

    def made(self) -> str:
        return "assistant" if self.last == "u" else "user"

    def inserts(self) -> None:
        while self.ops[self.at : self.at + 1] == "I":
            self.put(self.made(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        op = self.ops[self.at]
        self.at += 1
        if op != "D":
            self.put(role if op == "K" else self.made(), text)

    def done(self) -> dict:
        self.inserts()
        return self.head | {"repaired_sha256": self.hash.hexdigest()}


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """RESULT of a stream in which each conversation's edits stand before its rows."""
    writer = None
    for batch in batches:
        out, heads = [], batch.select(RESULT.names[:-1])
        for i, (kind, role, text) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("kind", "role", "text")))):
            if kind == 0:
                if writer:
                    out.append(writer.done())
                writer = _Writer(heads.slice(i, 1).to_pylist()[0])
            else:
                writer.row(role, text)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=RESULT)
    if writer:
        yield pa.RecordBatch.from_pylist([writer.done()], schema=RESULT)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation of rows (conv_id, turn, role, text, gone);
    rows that are gone count for nothing but their conversation's name."""
    full = marked(rows)
    edits = plan_edits(full).withColumn("kind", F.lit(0))
    texts = full.where("not gone").select("conv_id", "turn", "role", "d1", "d2", "text", F.lit(1).alias("kind"))
    both = edits.unionByName(texts, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "d1", "d2")
    return both.select(*RESULT.names[:-1], "kind", "role", "text").mapInArrow(_hashed, f"{EDITS_DDL}, repaired_sha256 string")
