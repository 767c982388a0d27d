"""Quality rules as a short-circuit cascade.

Every document gets the base statistics. Documents that pass the base then go through the rules, each of which only sees
what the rules before it kept. Every rule's cost (seconds) and selectivity (documents rejected) are estimated first on a hash sample of about SAMPLE_ROWS whole texts of
all documents, summed over the tasks that have them; all tasks then run the rules by rejections per second, highest first. All rules are
deterministic and a document is kept if none rejects it, so the order changes the time, never the verdict.

Cases. Null and empty texts have no words and fail the base. Ties of rates keep the rules' given order. Repeated rows give repeated
rows; other columns are not read; empty tables give no rows. Very long texts take linear time and about 40 times their bytes.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haystrata.llm.common import flat, grouped, mix, owner, windows, word_hashes, words

#: Bound, on average, of the sample that orders the rules.
SAMPLE_ROWS = 5_000
#: Share of the packed texts below which those left are packed anew.
SPARSE = 0.7
_BLANK = " \t\n\x0b\x0c\r"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


class Texts:
    """A piece of texts with the statistics that base and rules use."""

    def __init__(self, texts: pa.Array):
        self.texts = texts
        self.data, self.offs = flat(texts)
        self.starts, self.ends, self.first = words(self.data, self.offs)

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def count(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[self.offs[1:]] - total[self.offs[:-1]]

    def words_with(self, mask: np.ndarray) -> np.ndarray:
        """How many words of each text have a marked byte."""
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        hit = np.concatenate([[0], np.cumsum(total[self.ends] > total[self.starts])])
        return hit[self.first[1:]] - hit[self.first[:-1]]

    def take(self, at: np.ndarray) -> Texts:
        """The texts at these ascending places, without reading any text anew."""
        if len(at) == len(self.offs) - 1:
            return self
        keep = np.zeros(len(self.offs) - 1, bool)
        keep[at] = True
        size, n_words = np.diff(self.offs), self.n_words
        out = Texts.__new__(Texts)
        out.texts = self.texts.take(pa.array(at))
        out.data = self.data[np.repeat(keep, size)]
        out.offs = np.concatenate([[0], np.cumsum(size[at])])
        out.first = np.concatenate([[0], np.cumsum(n_words[at])])
        held = np.repeat(keep, n_words)
        back = np.repeat(self.offs[:-1][at] - out.offs[:-1], n_words[at])
        out.starts, out.ends = self.starts[held] - back, self.ends[held] - back
        return out


def base(t: Texts) -> dict[str, np.ndarray]:
    blank = np.isin(t.data, np.frombuffer(_BLANK.encode(), np.uint8))
    out = {"n_words": t.n_words, "word_chars": t.count(~blank & ((t.data & 0xC0) != 0x80)), "n_symbols": t.count(_SYMBOL[t.data])}
    dup, lines = np.zeros(len(t.n_words), np.int64), np.zeros(len(t.n_words), np.int64)
    for i, text in enumerate(t.texts.to_pylist()):
        if text:
            full = [x for x in text.split("\n") if x.strip(_BLANK)]
            lines[i], dup[i] = len(full), len(full) - len(set(full))
    h, at = windows(word_hashes(t.data, t.starts, t.ends), t.first, 3)
    doc = owner(t.first, at)
    _, back, times = np.unique(mix(h ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_inverse=True, return_counts=True)
    at = at[times[back] >= 2]
    held = np.zeros(len(t.starts), bool)
    for k in range(3):
        held[at + k] = True
    total = np.concatenate([[0], np.cumsum(held)])
    return out | {"n_dup_lines": dup, "n_lines": lines, "n_repeat_words": total[t.first[1:]] - total[t.first[:-1]]}


@dataclass(frozen=True)
class Rule:
    """rejects(texts, base statistics) -> which are rejected. wants_text: the texts are needed, not just the statistics."""

    name: str
    rejects: Callable[[Texts | None, dict[str, np.ndarray]], np.ndarray]
    wants_text: bool = True


def _letters(t: Texts, _) -> np.ndarray:
    return 10 * t.words_with(_LETTER[t.data]) < 7 * t.n_words


def _shouting(t: Texts, _) -> np.ndarray:
    upper, lower = t.count((t.data >= 65) & (t.data <= 90)), t.count((t.data >= 97) & (t.data <= 122))
    return 2 * upper > upper + lower


def _exclaims(t: Texts, _) -> np.ndarray:
    return 10 * t.count(t.data == 33) > 3 * t.n_words


#: Production rules. Thresholds are shares in whole numbers, so no rounding is involved.
RULES = (
    Rule("symbols", lambda t, b: 10 * b["n_symbols"] > 2 * b["n_words"], False),
    Rule("dup_lines", lambda t, b: 10 * b["n_dup_lines"] > 3 * b["n_lines"], False),
    Rule("word_length", lambda t, b: (2 * b["word_chars"] < 5 * b["n_words"]) | (b["word_chars"] > 15 * b["n_words"]), False),
    Rule("letters", _letters),
    Rule("shouting", _shouting),
    Rule("exclaims", _exclaims),
)


def base_failed(b: dict[str, np.ndarray]) -> np.ndarray:
    return (b["n_words"] < 50) | (100 * b["n_repeat_words"] > 50 * b["n_words"])


def cascade(t: Texts, b: dict[str, np.ndarray], rules) -> np.ndarray:
    """Which texts are kept; a rule sees only what is left. Texts are packed anew only once SPARSE of those held are rejected, as packing costs about as much as a rule."""
    left = np.flatnonzero(~base_failed(b))
    held, at = t.take(left), left
    for rule in rules:
        if not len(left):
            break
        if not rule.wants_text:
            left = left[~rule.rejects(None, {k: v[left] for k, v in b.items()})]
            continue
        if len(left) < SPARSE * len(at):
            held, at = t.take(left), left
        no = np.zeros(len(t.n_words), bool)
        no[at] = rule.rejects(held, {k: v[at] for k, v in b.items()})
        left = left[~no[left]]
    kept = np.zeros(len(t.n_words), bool)
    kept[left] = True
    return kept


def rates(t: Texts, b: dict[str, np.ndarray], rules=RULES) -> dict[str, tuple[float, int]]:
    """(seconds, texts rejected) of each rule on all texts that pass the base."""
    at, out = np.flatnonzero(~base_failed(b)), {}
    held, stats = t.take(at), {k: v[at] for k, v in b.items()}
    for rule in rules:
        began = time.perf_counter()
        no = rule.rejects(held, stats)
        out[rule.name] = (time.perf_counter() - began, int(no.sum()))
    return out


def order_rules(docs: DataFrame, rules=RULES, sample: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per second on a hash sample of docs (doc_id, text); as they are where nothing is rejected. The driver gets a row a rule."""
    total = docs.count()
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, total // sample))) == 0)
    schema = pa.schema([("name", pa.string()), ("seconds", pa.float64()), ("rejected", pa.int64())])

    def one(batch):
        t = Texts(batch.column(1))
        found = rates(t, base(t), rules)
        return {"name": list(found), "seconds": [x for x, _ in found.values()], "rejected": [n for _, n in found.values()]}

    rows = chosen.mapInArrow(lambda it: grouped(it, "text", schema, one), "name string, seconds double, rejected long")
    rate = {r[0]: r[1] / max(r[2], 1e-9) for r in rows.groupBy("name").agg(F.sum("rejected"), F.sum("seconds")).collect()}
    return sorted(rules, key=lambda r: -rate.get(r.name, 0.0))


def quality_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), one row for each row of docs.

    Null texts have no words and fail the base. Null and repeated doc_ids go through as they are.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names), ("base_failed", pa.bool_()), ("kept", pa.bool_())])

    ordered = order_rules(docs, rules)

    def one(batch):
        t = Texts(batch.column(1))
        b = base(t)
        return {"doc_id": batch.column(0)} | {n: b[n] for n in names} | {"base_failed": base_failed(b), "kept": cascade(t, b, ordered)}

    return docs.mapInArrow(lambda it: grouped(it, "text", schema, one), ", ".join(["doc_id long", *(f"{n} long" for n in names), "base_failed boolean", "kept boolean"]))
