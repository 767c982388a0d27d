"""Static range asymmetric numeral system over token ids: independent blocks, whose lanes are interleaved in one stream of words.

A block deals its ids to LANES lanes in turn. All lanes share one frequency table; a lane's state is 64 bits, from which 32-bit words go to
the block's stream when it grows too large, in the order in which decoding takes them back. Every STEPS steps the states of all lanes and the place in the stream are kept:
decoding can begin at any of these checkpoints, and decode() takes all segments of all blocks it is given as rows of one NumPy array.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

#: Bits of the frequencies' sum, lanes of a block, steps between checkpoints, cells of one array.
BITS, LANES, STEPS, CELLS = 20, 64, 256, 1 << 22
LOW = np.uint64(1 << 31)
MAGIC = b"HSRANS1\0"
_HEAD = struct.Struct("<8sQIIIII")
_SUM = struct.Struct("<I")


class Corrupt(ValueError):
    """Bytes that are not what was written."""


class Table:
    """Frequencies of ids that sum to 2 ** BITS, and what encoding and decoding look up. counts: how often each id comes; those that never come cannot be encoded."""

    def __init__(self, frequencies: np.ndarray):
        self.frequencies = frequencies.astype(np.uint64)
        self.begins = np.concatenate([[0], np.cumsum(frequencies)[:-1]]).astype(np.uint64)
        self._slots: np.ndarray | None = None

    @classmethod
    def of(cls, counts: np.ndarray) -> Table:
        """Shares of 2 ** BITS, at least 1 for each id that comes: rounded down, and what is missing or too much goes to the most frequent ids in turn."""
        counts = counts.astype(np.float64)
        seen = np.flatnonzero(counts)
        if len(seen) > 1 << (BITS - 1):
            raise ValueError(f"{len(seen)} ids are too many for frequencies of {BITS} bits")
        out = np.zeros(max(1, len(counts)), np.int64)
        if not len(seen):
            out[0] = 1 << BITS
            return cls(out)
        out[seen] = np.maximum(1, counts[seen] * ((1 << BITS) / counts.sum()))
        order = seen[np.lexsort((seen, -counts[seen]))]
        left = (1 << BITS) - int(out.sum())
        if left > 0:
            out[order[0]] += left
        while left < 0:
            large = order[out[order] > 1]
            take = np.minimum(out[large] - 1, np.maximum(1, (out[large] * (-left / max(1, int(out[large].sum())))).astype(np.int64)))
            take = np.where(np.cumsum(take) <= -left, take, 0)
            if not take.any():
                take[0] = min(-left, int(out[large[0]]) - 1)
            out[large] -= take
            left += int(take.sum())
        return cls(out)

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            kind = np.uint16 if len(self.frequencies) <= 1 << 16 else np.uint32
            self._slots = np.repeat(np.arange(len(self.frequencies), dtype=kind), self.frequencies.astype(np.int64))
        return self._slots

    def to_bytes(self) -> bytes:
        body = self.frequencies.astype("<u4").tobytes()
        return MAGIC + struct.pack("<II", len(self.frequencies), zlib.crc32(body)) + body

    @classmethod
    def from_bytes(cls, raw: bytes) -> Table:
        n, crc = struct.unpack_from("<II", raw, 8)
        if raw[:8] != MAGIC or len(raw) != 16 + 4 * n or zlib.crc32(raw[16:]) != crc:
            raise Corrupt("the frequency table is damaged")
        return cls(np.frombuffer(raw, "<u4", offset=16))


def groups(sizes: list[int]) -> Iterator[list[int]]:
    """Indices of arrays of like sizes, so many that they make one array of CELLS cells at most, or one of them."""
    order, begin = sorted(range(len(sizes)), key=sizes.__getitem__), 0
    while begin < len(order):
        end = begin + 1
        while end < len(order) and sizes[order[end]] <= 2 * max(LANES, sizes[order[begin]]) and (end - begin + 1) * sizes[order[end]] <= CELLS:
            end += 1
        yield order[begin:end]
        begin = end


def encode(blocks: list[np.ndarray], table: Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(words, states [checkpoint, lane], word places of the checkpoints) of each array of ids."""
    out: list = [None] * len(blocks)
    for own in groups([len(b) for b in blocks]):
        sizes = np.array([len(blocks[i]) for i in own])
        steps = -(-int(sizes.max()) // LANES)
        ids = np.zeros((len(own), steps * LANES), np.uint32)
        for k, i in enumerate(own):
            ids[k, : len(blocks[i])] = blocks[i]
        if steps and int(ids.max()) >= len(table.frequencies):
            raise ValueError("an id that the frequency table does not know")
        ids = ids.reshape(len(own), steps, LANES)
        live = (np.arange(steps * LANES) < sizes[:, None]).reshape(ids.shape)
        state = np.full((len(own), LANES), LOW, np.uint64)
        words, sent = np.zeros(ids.shape, np.uint32), np.zeros(ids.shape, bool)
        checks = np.zeros((len(own), max(1, -(-steps // STEPS)), LANES), np.uint64)
        checks[:, 0] = state
        for t in range(steps - 1, -1, -1):
            s = ids[:, t]
            f, on = table.frequencies[s], live[:, t]
            if not f[on].all():
                raise ValueError("an id that the frequency table does not know")
            f = np.maximum(f, np.uint64(1))
            large = on & (state >= f << np.uint64(63 - BITS))
            words[:, t], sent[:, t] = state & np.uint64(0xFFFFFFFF), large
            x = np.where(large, state >> np.uint64(32), state)
            q = x // f
            state = np.where(on, (q << np.uint64(BITS)) + (x - q * f) + table.begins[s], state)
            if t % STEPS == 0:
                checks[:, t // STEPS] = state
        before = np.concatenate([np.zeros((len(own), 1), np.int64), np.cumsum(sent.sum(2), 1)], 1)
        for k, i in enumerate(own):
            n = max(1, -(-len(blocks[i]) // (LANES * STEPS)))
            out[i] = (words[k][sent[k]], checks[k, :n], before[k, :steps:STEPS][:n] if steps else np.zeros(1, np.int64))
    return out


def decode(segments: list[tuple[int, np.ndarray, np.ndarray, int]], table: Table) -> list[np.ndarray]:
    """The ids of segments (how many, states, the block's words, place of the first word), STEPS * LANES ids each at most."""
    out: list = [None] * len(segments)
    mask = np.uint64((1 << BITS) - 1)
    for own in groups([x[0] for x in segments]):
        sizes = np.array([segments[i][0] for i in own])
        steps = -(-int(sizes.max()) // LANES)
        base, streams, at = {}, [], np.zeros(len(own), np.int64)
        total = 0
        for k, i in enumerate(own):
            w = segments[i][2]
            if id(w) not in base:
                base[id(w)] = total
                streams.append(w)
                total += len(w)
            at[k] = base[id(w)] + segments[i][3]
        stream = np.concatenate([*streams, np.zeros(1, np.uint32)]).astype(np.uint64)
        state = np.stack([segments[i][1] for i in own]).astype(np.uint64)
        live = (np.arange(steps * LANES) < sizes[:, None]).reshape(len(own), steps, LANES)
        ids = np.empty((len(own), steps, LANES), np.uint32)
        for t in range(steps):
            slot = state & mask
            s = ids[:, t] = table.slots[slot]
            x = table.frequencies[s] * (state >> np.uint64(BITS)) + slot - table.begins[s]
            need = live[:, t] & (x < LOW)
            place = at[:, None] + np.cumsum(need, 1) - 1
            if int(place[:, -1].max(initial=0)) >= total and need.any():
                raise Corrupt("a block's stream ends too early")
            x = np.where(need, (x << np.uint64(32)) | stream[np.where(need, place, total)], x)
            state = np.where(live[:, t], x, state)
            at += need.sum(1)
        flat = ids.reshape(len(own), -1)
        for k, i in enumerate(own):
            out[i] = flat[k, : segments[i][0]]
    return out


def pack(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, coded) -> bytes:
    """A block as bytes: head, document ids (64 bits) and whether they are there, lengths, checkpoints, words. Two checksums: of the ids, and of all bytes but its own."""
    words, states, places = coded
    body = b"".join([
        np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes(), np.array([x is not None for x in doc_ids], np.uint8).tobytes(), lengths.astype("<u4").tobytes(),
        states.astype("<u8").tobytes(), places.astype("<u4").tobytes(), words.astype("<u4").tobytes(),
    ])
    head = _HEAD.pack(MAGIC, len(ids), len(doc_ids), len(words), len(states), LANES, zlib.crc32(ids.astype("<u4").tobytes()))
    return head + _SUM.pack(zlib.crc32(body, zlib.crc32(head))) + body


def unpack(blocks: list[bytes], table: Table) -> list[tuple[list, np.ndarray, np.ndarray]]:
    """(document ids, lengths, ids) of blocks, decoded together from all their checkpoints."""
    heads, segments, spans = [], [], []
    for raw in blocks:
        at, parts = _HEAD.size + _SUM.size, []
        if len(raw) < at:
            raise Corrupt("a block is cut")
        magic, n, docs, n_words, checks, lanes, crc = _HEAD.unpack_from(raw)
        view = memoryview(raw)
        if magic != MAGIC or lanes != LANES or (zlib.crc32(view[at:], zlib.crc32(view[: _HEAD.size])),) != _SUM.unpack_from(raw, _HEAD.size):
            raise Corrupt("a block is damaged")
        for kind, count in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u8", checks * LANES), ("<u4", checks), ("<u4", n_words)):
            parts.append(np.frombuffer(raw, kind, count, at))
            at += parts[-1].nbytes
        values, there, lengths, states, places, words = parts
        states = states.reshape(checks, LANES)
        heads.append(([v if k else None for v, k in zip(values.tolist(), there)], lengths, crc))
        spans.append((len(segments), checks))
        segments += [(min(STEPS * LANES, n - k * STEPS * LANES), states[k], words, int(places[k])) for k in range(checks)]
    ids, out = decode(segments, table), []
    for (names, lengths, crc), (first, many) in zip(heads, spans):
        own = np.concatenate(ids[first : first + many])
        if zlib.crc32(own.astype("<u4").tobytes()) != crc:
            raise Corrupt("a block's ids are not those that were written")
        out.append((names, lengths.astype(np.int64), own))
    return out
