"""Toxicity by a weighted finite-state pattern grammar.

A lexicon reads the words of a clause as symbols: insult, threat, target, negation, report, other. Insults are word stems whose
weights are log odds learned from labelled rows, next to a few fixed entries; the other lists are fixed. Over the symbols run
deterministic weighted transducers: an arc is (next state, symbol written, weight). reach() transducers of target, negation and
reported speech keep whether such a word is still near; they write an insult or a threat in its reach as a marked one, with the mark's weight on the arc, and
pass all else on. insult() reads those and writes insults as hits; threat() reads what insult() writes and makes a threat a hit only if the target transducer has marked it.
compose() makes one table of two machines of which the second reads what the first writes, and multiplies their weights. Targets that come after are read by the
same target transducer from the clause's end; the composed machine then reads, from its beginning, what that has written: together they are a two-way transducer.
A mark's weight, how much a target raises and a negation or a report lowers
an insult, is learned from the labelled rows too, around a fixed prior.

A clause's score is the sum over its hits of word weight times the weight of the arcs; a document's score is a logistic function,
fitted on the same rows, of the sum of its clauses and of that sum by length. Clauses end at .!?;:\\n, of any length; words are found
at word beginnings only, so a stem inside a word does not count.

Cases. Null and empty texts have no clause and get the score of none. A null doc_id is not held out. Ties: of two entries at one word the
heavier counts, then an insult before a threat. Repeated rows give repeated rows; other columns are not read. Empty tables
give no rows; without labels of both classes the fixed grammar is used. Time is linear in the text.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haystrata.llm.common import grouped, labelled_sample

#: Bound of the training sample: labelled rows of each class. Their texts are learned from whole.
ROWS_PER_CLASS = 3000
#: Bound of the learned lexicon.
STEMS = 400
PREDICT_AT = 0.7
#: Fixed entries: word stem to weight.
INSULTS = {w: 2.0 for w in ("idiot", "moron", "stupid", "worthless", "pathetic", "disgusting", "loser", "scum", "trash", "clown", "imbecile", "retard", "bastard", "filth", "vermin", "dumbass")}
THREATS = {w: 1.5 for w in ("kill", "murder", "hurt", "beat", "destroy", "shoot", "stab", "strangle", "burn")}
TARGETS = frozenset("you your yours yourself u ur he she they them him her tu vous du ihr sie usted ustedes".split())
NEGATIONS = frozenset("not no never n't isn't aren't wasn't don't doesn't nobody nicht kein keine nie pas jamais nunca".split())
REPORTS = frozenset("said says say called calls quoted quote wrote reported alleged sagte schrieb disait écrit dijo escribió".split())
#: Words over which a target, negation or report stays in reach.
REACH = {"target": 4, "negation": 3, "report": 6}
#: Prior weights of the marks, and the deviation of their logarithms.
FACTOR = {"target": 1.5, "negation": 0.3, "report": 0.4}
SPREAD = 1.0
#: Symbols: words of no kind and of three kinds, then insults and threats with each set of marks, of which the first has none, then what the grammar looks for.
OTHER, CONTEXT, INSULT, THREAT, HIT, SYMBOLS = 0, {"target": 1, "negation": 2, "report": 3}, 4, 12, 20, 21
MARK = {"target": 1, "negation": 2, "report": 4}
_CONTEXT = {w: CONTEXT[k] for k, words in (("report", REPORTS), ("negation", NEGATIONS), ("target", TARGETS)) for w in words}
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_CLAUSE_END = re.compile(r"[.!?;:\n]")


# --- transducers ---


@dataclass(frozen=True)
class Transducer:
    """arcs[state][symbol] = (next state, symbol written, weight); state 0 is the start, every state is final."""

    arcs: tuple[tuple[tuple[int, int, float], ...], ...]


def marks_of(symbol: int) -> int:
    return (symbol - INSULT) % 8 if INSULT <= symbol < HIT else 0


def reach(kind: str, words: int, weight: float = 1.0) -> Transducer:
    """Counts down from a word of the kind; writes the insults and threats that it reaches with its mark, where they have none, at its weight."""
    rows = []
    for left in range(words + 1):
        row = []
        for symbol in range(SYMBOLS):
            after = words if symbol == CONTEXT[kind] else max(0, left - 1)
            new = bool(after) and INSULT <= symbol < HIT and not marks_of(symbol) & MARK[kind]
            row.append((after, symbol + MARK[kind] if new else symbol, weight if new else 1.0))
        rows.append(tuple(row))
    return Transducer(tuple(rows))


def insult() -> Transducer:
    """Writes insults, whatever their marks, as hits."""
    return Transducer((tuple((0, HIT if INSULT <= x < THREAT else x, 1.0) for x in range(SYMBOLS)),))


def threat() -> Transducer:
    """Writes threats that bear a target's mark as hits, others as no symbol of any kind."""
    return Transducer((tuple((0, (HIT if marks_of(x) & MARK["target"] else OTHER) if THREAT <= x < HIT else x, 1.0) for x in range(SYMBOLS)),))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """One machine that writes what second writes when it reads what first writes, at the product of their weights. States are the reachable pairs."""
    number, todo, rows = {(0, 0): 0}, [(0, 0)], []
    for a, b in todo:
        row = []
        for symbol in range(SYMBOLS):
            x, between, u = first.arcs[a][symbol]
            y, written, v = second.arcs[b][between]
            if (x, y) not in number:
                number[x, y] = len(number)
                todo.append((x, y))
            row.append((number[x, y], written, u * v))
        rows.append(tuple(row))
    return Transducer(tuple(rows))


def run(t: Transducer, symbols: list[int]) -> list[tuple[int, float]]:
    """The symbol that the transducer writes for each, and its arc's weight."""
    state, out = 0, []
    for s in symbols:
        state, written, weight = t.arcs[state][s]
        out.append((written, weight))
    return out


def marker(weights: dict[str, float] | None = None) -> Transducer:
    """The transducers of target, negation and report as one, which writes marked insults and threats."""
    w = weights or dict.fromkeys(MARK, 1.0)
    return compose(compose(reach("target", REACH["target"], w["target"]), reach("negation", REACH["negation"], w["negation"])), reach("report", REACH["report"], w["report"]))


#: What finds hits among marked symbols, the marks alone, and the target transducer that reads a clause from its end.
JUDGE = compose(insult(), threat())
FORWARD = marker()
BACKWARD = reach("target", REACH["target"])


def read(symbols: list[int], forward: Transducer = FORWARD, backward: Transducer = BACKWARD) -> list[tuple[int, float]]:
    """What the two-way transducer writes: forward reads what backward, from the end, has written."""
    after = run(backward, symbols[::-1])[::-1]
    return [(written, u * v) for (written, u), (_, v) in zip(run(forward, [x for x, _ in after]), after)]


def factors(weights: dict[str, float]) -> np.ndarray:
    """The weight of each marked symbol, 16 numbers: the product of its marks' weights where the grammar finds a hit, else 0."""
    hits = [x for x, _ in (run(JUDGE, [s])[0] for s in range(INSULT, HIT))]
    return np.array([np.prod([weights[k] for k, m in MARK.items() if marks_of(s) & m]) if hit == HIT else 0.0 for s, hit in zip(range(INSULT, HIT), hits)])


@dataclass
class Grammar:
    """Lexicons, the marks' weights, and the logistic weights of a document's matched clauses."""

    insults: dict[str, float] = field(default_factory=lambda: dict(INSULTS))
    threats: dict[str, float] = field(default_factory=lambda: dict(THREATS))
    marks: dict[str, float] = field(default_factory=lambda: dict(FACTOR))
    logit: np.ndarray = field(default_factory=lambda: np.array([-3.0, 1.0, 0.5]))
    _trie: object = None

    def __getstate__(self):
        return {"insults": self.insults, "threats": self.threats, "marks": self.marks, "logit": self.logit, "_trie": None}

    @property
    def trie(self):
        if self._trie is None:
            self._trie = ahocorasick.Automaton()
            for kind, entries in ((THREAT, self.threats), (INSULT, self.insults)):
                for stem, weight in entries.items():
                    self._trie.add_word(stem, (len(stem), kind, weight))
            self._trie.make_automaton()
        return self._trie

    def matches(self, low: str) -> dict[int, tuple[int, float]]:
        """Where insult and threat words begin in a lower-case text: the heaviest entry each. Threats match whole words."""
        found: dict[int, tuple[int, float]] = {}
        for end, (n, kind, weight) in self.trie.iter(low):
            at = end - n + 1
            if at and low[at - 1].isalnum() or kind == THREAT and end + 1 < len(low) and low[end + 1].isalnum():
                continue
            if (weight, -kind) > (found.get(at, (99, 0.0))[1], -found.get(at, (99, 0.0))[0]):
                found[at] = (kind, weight)
        return found

    def symbols(self, text: str | None):
        """For each clause with an insult or a threat, its words as symbols and their weights."""
        low = (text or "").lower()
        found = self.matches(low)
        at = sorted(found)
        i = end = 0
        while i < len(at):
            begin = max((low.rfind(c, end, at[i]) for c in ".!?;:\n"), default=-1)
            begin = begin + 1 if begin >= 0 else end
            end = m.start() if (m := _CLAUSE_END.search(low, at[i])) else len(low)
            symbols, weights = [], []
            for w in _WORD.finditer(low, begin, end):
                hit = found.get(w.start())
                word = w[0]
                symbols.append(hit[0] if hit else _CONTEXT.get(word, CONTEXT["negation"] if word.endswith("n't") else OTHER))
                weights.append(hit[1] if hit else 0.0)
            yield symbols, weights
            while i < len(at) and at[i] < end:
                i += 1

    def events(self, text: str | None) -> list[np.ndarray]:
        """For each clause with an insult or a threat, the sums of its word weights by marked symbol, 16 numbers."""
        out = []
        for symbols, weights in self.symbols(text):
            sums = np.zeros(16)
            for (s, _), w in zip(read(symbols), weights):
                if w:
                    sums[s - INSULT] += w
            out.append(sums)
        return out

    def clauses(self, text: str | None) -> list[float]:
        """Scores of the matched clauses, by the whole weighted machine."""
        whole, back = compose(marker(self.marks), JUDGE), reach("target", REACH["target"], self.marks["target"])
        scores = [sum(w * v for (s, v), w in zip(read(symbols, whole, back), weights) if s == HIT) for symbols, weights in self.symbols(text)]
        return [x for x in scores if x > 0]

    def score(self, text: str | None) -> float:
        x = features(np.sum([np.zeros(16), *self.events(text)], axis=0)[None], np.array([len(text or "")]), self.marks)
        return float(1 / (1 + np.exp(-np.clip(x @ self.logit, -30, 30)))[0])


def features(sums: np.ndarray, chars: np.ndarray, marks: dict[str, float]) -> np.ndarray:
    """One, the logarithms of all clauses' score and of that score by length, for each document's 16 sums."""
    total = sums @ factors(marks)
    return np.stack([np.ones(len(total)), np.log1p(total), np.log1p(1000.0 * total / (chars + 200))], 1)


# --- learning ---


def _stems(text: str) -> set[str]:
    out = set()
    for w in set(_WORD.findall(text.lower())):
        out.update(w[:k] for k in range(4, min(len(w), 9) + 1))
        out.add(w)
    return out


def stem_counts(sample: DataFrame) -> DataFrame:
    """(stem, toxic, clean): documents of sample (text, y) with the stem. A stem leaves a piece of a task's rows once."""
    schema = pa.schema([("stem", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def one(batch):
        toxic, clean = Counter(), Counter()
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            (toxic if y > 0 else clean).update(_stems(text))
        stems = sorted(toxic.keys() | clean.keys())
        return {"stem": stems, "toxic": [toxic[s] for s in stems], "clean": [clean[s] for s in stems]}

    rows = sample.select("text", "y").mapInArrow(lambda it: grouped(it, "text", schema, one), "stem string, toxic long, clean long")
    return rows.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose_stems(counts: list[tuple[str, int, int]], n_toxic: int, n_clean: int, stems: int = STEMS) -> dict[str, float]:
    """Up to `stems` stems of (stem, toxic, clean) with log odds of 2 or more: a stem that says no less than its longer forms stands for them."""
    odds = {s: np.log((t + 0.5) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1)) for s, t, c in counts}
    there = {s: t for s, t, _ in counts}
    chosen: dict[str, float] = {}
    for s in sorted((s for s in odds if odds[s] >= 2.0), key=lambda s: (-odds[s] * np.sqrt(there[s]), s)):
        if len(chosen) >= stems:
            break
        if not any(s[:k] in chosen for k in range(4, len(s))):
            chosen[s] = min(4.0, float(odds[s])) / 2
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 25) -> tuple[np.ndarray, float]:
    """Weights of a logistic regression with a small ridge by Newton steps, and their loss."""
    b, ridge = np.zeros(x.shape[1]), np.array([1e-3, 0.05, 0.05])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-6)
        b += np.clip(np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * b), -5, 5)
    z = np.clip(x @ b, -30, 30)
    return b, float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (ridge * b * b).sum())


def fit(sums: np.ndarray, chars: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, float], np.ndarray]:
    """The marks' weights and the logistic ones: least loss over a grid of each mark's weight in turn, with a normal prior on its logarithm around FACTOR."""
    marks = dict(FACTOR)
    weight = weight / weight.mean()

    def loss(m: dict[str, float]) -> float:
        return _logistic(features(sums, chars, m), y, weight, 12)[1] + sum(0.5 * (np.log(m[k] / FACTOR[k]) / SPREAD) ** 2 for k in m)

    for _ in range(2):
        for k in marks:
            marks[k] = min((marks | {k: v} for v in sorted({marks[k], 0.05, 0.1, 0.2, 0.3, 0.4, 0.55, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0})), key=loss)[k]
    return marks, _logistic(features(sums, chars, marks), y, weight)[0]


def event_sums(sample: DataFrame, grammar: Grammar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(16 sums, characters, label) of each row of sample (text, y): numbers only, so the driver gets at most 18 a sampled row."""
    schema = pa.schema([("sums", pa.list_(pa.float64())), ("chars", pa.int64()), ("y", pa.float64())])
    shared = sample.sparkSession.sparkContext.broadcast(grammar)

    def one(batch):
        texts = batch.column(0).to_pylist()
        return {"sums": [np.sum([np.zeros(16), *shared.value.events(t)], axis=0).tolist() for t in texts], "chars": [len(t) for t in texts], "y": batch.column(1)}

    rows = sample.select("text", "y").mapInArrow(lambda it: grouped(it, "text", schema, one), "sums array<double>, chars long, y double").collect()
    rows = sorted(map(tuple, rows), key=repr)  # the same sums whatever the order
    return np.array([r[0] for r in rows]).reshape(-1, 16), np.array([r[1] for r in rows], float), (np.array([r[2] for r in rows]) > 0).astype(float)


def held_out(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, value: str = "toxic", rows_per_class: int = ROWS_PER_CLASS) -> Grammar:
    """A grammar learned from the labelled rows that are not held out."""
    sample, counts = labelled_sample(docs, labels, F.when(F.col(value).isNotNull(), (F.col(value) > 0).cast("int")), rows_per_class, ~held_out("doc_id"))
    grammar = Grammar()
    n = {r[0]: r[1] for r in sample.groupBy("y").count().collect()}
    if len(n) < 2:
        return grammar
    odds = F.log((F.col("toxic") + 0.5) / (n[1.0] + 1)) - F.log((F.col("clean") + 0.5) / (n[0.0] + 1))
    found = stem_counts(sample).where(F.col("toxic") >= max(4, 0.01 * n[1.0])).where(odds >= 1.99)
    found = found.orderBy(F.desc(F.round(odds * F.sqrt("toxic"), 6)), "stem").limit(40 * STEMS)  # what the choice below can use
    grammar.insults = {**INSULTS, **choose_stems([tuple(r) for r in found.collect()], n[1.0], n[0.0])}
    sums, chars, y = event_sums(sample, grammar)
    weight = np.where(y > 0, counts[1.0] / n[1.0], counts[0.0] / n[0.0])
    grammar.marks, grammar.logit = fit(sums, chars, y, weight)
    return grammar


def score_toxicity(docs: DataFrame, grammar: Grammar, predict_at: float = PREDICT_AT) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of docs. Null texts are scored as empty; a null doc_id is not held out."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)  # at most STEMS entries and the fixed ones
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def one(batch):
        g, texts = shared.value, batch.column(2).to_pylist()
        sums = np.array([np.sum([np.zeros(16), *g.events(t)], axis=0) for t in texts])
        x = features(sums, np.array([len(t or "") for t in texts]), g.marks)
        score = 1 / (1 + np.exp(-np.clip(x @ g.logit, -30, 30)))
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "score": score, "predicted": (score >= predict_at).astype(np.int32)}

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lambda it: grouped(it, "text", schema, one), "doc_id long, held_out boolean, score double, predicted int")
