"""Personal data: high-recall generators, boosted trees over their candidates, calibrated thresholds.

Generators propose overlapping spans of four kinds, base patterns among them. A candidate is described by its format
(digits, groups, separators, checksums, validity, label lengths) and its context (the characters and key words around it) and scored
by gradient boosted trees, one model a kind. No table labels personal data, so labels are weak. A bounded sample of documents gives surroundings: of base spans, of gaps between
two words, and of digit runs of a card's length that fail the checksum. Positive are values in looser writing (an address with "at" and "dot", a compressed IPv6 address, a telephone number
without its country, a card with dots, a mistyped card after a word for cards) in the surroundings of base spans and of plain text; writings that could as well be plain numbers only after a word that
asks for them. Negative are those digit runs and look-alikes (number groups, order and version numbers, dates, amounts, clock times, ranges) in surroundings of plain text.

Two thirds of the documents train the trees. The others, with other grammars of writings and look-alikes, calibrate: a logistic fit of the score, and of each kind's thresholds
that have 95 % precision there the one that finds most. Base spans always stay; a further candidate becomes a
span if it is over its kind's threshold and overlaps no span already taken, best first.

Cases. Null texts are empty and stay null when redacted; empty texts have no spans. Ties: of equal probabilities the kind that is first by
name, then the earlier begin. Repeated rows give repeated rows; find_pii() reads doc_id and text only, redact() passes other columns on.
Empty tables give no rows and models of the grammars. Searches take time linear in the text.
"""

from __future__ import annotations

import ipaddress
import random
import re
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haystrata.llm.boosting import Boosted
from haystrata.llm.common import grouped, pieces, staged
from haystrata.llm.spans import Span, Taken, addresses, digest, digit_runs, emails, joined, luhn, phones

KINDS = ("email", "ip", "card", "phone")
#: Examples of each kind for training, and as many for calibration, half of them positive.
EXAMPLES = 1200
#: Bound, on average, of the documents whose spans and plain text are the real surroundings.
SAMPLE_DOCS = 20_000
SEED = 5
#: Characters of context on each side, and of the longest value that training looks at.
CONTEXT, MAX_VALUE = 24, 200
_LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}(?:\x20?(?:@|[(\[{](?i:at)[)\]}])\x20?|\x20(?i:at)\x20)[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[(\[{](?i:dot)[)\]}]\x20?|\x20(?i:dot)\x20)[A-Za-z0-9-]{1,63}){1,5}", re.A),
    "ip": re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])", re.A),
    "card": re.compile(r"(?<![0-9A-Za-z_])[0-9](?:[\x20./-]{0,2}[0-9]){12,18}(?![0-9A-Za-z_])", re.A),
    "phone": re.compile(r"(?<![0-9A-Za-z+_])(?:(?:\([0-9]{1,5}\)[\x20./-]{0,2}|[0-9]{1,5}[\x20./-]{1,2})[0-9]{2,8}(?:[\x20./-]{1,2}[0-9]{2,8}){0,4}|0[0-9]{8,13})(?![0-9A-Za-z_])", re.A),
}
_CUES = {
    "email": ("mail", "contact", "write", "reach", "address"),
    "ip": ("ip", "host", "server", "address", "from"),
    "card": ("card", "visa", "pay", "credit", "account"),
    "phone": ("call", "tel", "phone", "fax", "mobile", "dial"),
}
_AGAINST = ("version", "v.", "isbn", "id", "ref", "order", "total", "page", "date", "no.", "#", "$", "%", "build")
#: Common ends of host names.
_ENDS = frozenset("com org net edu gov info io co uk de fr es it nl ch at eu example".split())
_PLAIN = re.compile(r"(?<=[a-zà-ÿ])\x20(?=[a-zà-ÿ])")


def base_spans(text: str) -> list[Span]:
    """Base matches by kind as listed, then begin."""
    out = [("email", a, b) for a, b in emails(text)]
    if "." in text:
        out += [("ip", a, b) for a, b in addresses(text)]
    out += [("card", a, b) for a, b, d in digit_runs(text) if 13 <= len(d) <= 19 and luhn(d)]
    out += [("phone", a, b) for a, b, d in phones(text) if 9 <= len(d) <= 15]
    return out


def proposals(text: str) -> list[Span]:
    """The further candidates of every kind, overlapping or not."""
    low = text.lower()
    at = "@" in low or any(x in low for x in ("(at)", "[at]", "{at}")) or " at " in low and " dot " in low
    kinds = ["email"] * at + ["ip"] * (":" in low) + ["card", "phone"] * any(c in low for c in "0123456789")
    out = [(k, m.start(), m.end()) for k in kinds for m in _LOOSE[k].finditer(text)]
    return [s for s in out if s[0] != "phone" or 7 <= sum(c.isdigit() for c in text[s[1] : s[2]]) <= 14]


def _is_ipv6(value: str) -> bool:
    try:
        return ipaddress.ip_address(value).version == 6
    except ValueError:
        return False


def describe(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format and context of a candidate."""
    value, before, after = text[a:b], text[max(0, a - CONTEXT) : a].lower(), text[b : b + CONTEXT].lower()
    digits = "".join(c for c in value if "0" <= c <= "9")
    groups = re.findall(r"[0-9]+", value)
    sizes = [*map(len, groups), 0, 0, 0]
    words = re.findall(r"[A-Za-z0-9]+", value)
    seps = {c for c in value if not c.isalnum()}
    low = value.lower()
    return [
        len(value), len(digits), len(groups), max(sizes), min(sizes[: max(1, len(groups))]), len(seps), value.count(" "), value.count("."), value.count("-"), value.count("/"), value.count(":"), float("::" in value),
        sizes[0], sizes[1], sizes[2], sizes[max(0, len(groups) - 1)], float(digits[:1] == "0"), float(value[:1] == "("), float(bool(groups) and groups[0][:4].isdigit() and 1900 <= int(groups[0][:4]) < 2100), float(bool(groups) and len(groups[-1]) == 4 and 1900 <= int(groups[-1]) < 2100), len(set(digits)),
        float(luhn(digits)) if digits else 0.0, float(kind == "ip" and _is_ipv6(value)), float(bool(re.search(r"[(\[{]at[)\]}]", low))), float(" at " in low), float(bool(re.search(r"dot", low))), float(bool(words) and words[-1].lower() in _ENDS), float(bool(words) and any(c.isdigit() for c in words[0])), float(bool(re.match(r"[a-z0-9]*[._][a-z0-9]", low))),
        float(any(c in before for c in _CUES[kind])), float(any(c in before for c in _AGAINST)), float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in ":=" and bool(before)), float(after[:1] in "%$€/"), float(after[:1].isdigit() or after[:2].strip()[:1].isdigit()), float(before.rstrip()[-1:].isdigit()),
    ]


def surroundings(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, each: int = EXAMPLES) -> dict[str, list[tuple[str, str, str, bool]]]:
    """(value, before, after, held out) of up to `each` base spans of each kind, under "unlike" of digit runs that fail a card's checksum, and under "plain" of gaps between two words, in a hash sample of
    about sample_docs documents: those with the smallest hashes, so the same in any partitioning. A third of the documents is held out. A few hundred characters a row come to the driver."""
    total = docs.count()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    h = F.xxhash64("doc_id", "text")
    rows = rows.where(F.pmod(h, F.lit(max(1, total // sample_docs))) == 0).select("text", (F.pmod(F.xxhash64(h), F.lit(3)) == 2).alias("held"))
    schema = pa.schema([("kind", pa.string()), ("value", pa.string()), ("before", pa.string()), ("after", pa.string()), ("held", pa.bool_()), ("h", pa.string())])
    names = (*KINDS, "unlike", "plain")

    def one(batch):
        found: dict[str, set] = {k: set() for k in names}
        for text, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            spans = base_spans(text)
            gaps = [m.start() for m in _PLAIN.finditer(text)]
            fails = [("unlike", a, b) for a, b, d in digit_runs(text) if 13 <= len(d) <= 19 and not luhn(d)]
            for kind, a, b in [*spans, *fails, *(("plain", g, g) for g in gaps[:: max(1, len(gaps) // 3)])]:
                row = (text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT])
                if len(row[0]) <= MAX_VALUE:
                    found[kind].add((blake2b("\0".join(row).encode("utf-8", "replace"), digest_size=8).hexdigest(), *row, held))
        out = [(kind, *x, h) for kind, held in found.items() for h, *x in sorted(held)[:each]]
        return dict(zip(schema.names, zip(*out))) if out else None

    found = staged(rows.mapInArrow(lambda it: grouped(it, "text", schema, one), "kind string, value string, before string, after string, held boolean, h string"))
    keys = ["h", "value", "before", "after", "held"]
    return {k: [tuple(r) for r in found.where(F.col("kind") == k).select(*keys).distinct().orderBy(*keys).limit(each).select(*keys[1:]).collect()] for k in names}


class _Grammar:
    """Writings of a kind and what looks like them: strong ones that are personal data anywhere, weak ones that are only after a word that asks for them, and look-alikes. check: those of calibration, none of which is trained on."""

    def __init__(self, kind: str, rng: random.Random, check: bool):
        self.kind, self.rng, self.check = kind, rng, check

    def num(self, k: int, first: str = "123456789") -> str:
        return "".join(self.rng.choice(first if i == 0 else "0123456789") for i in range(k))

    def word(self) -> str:
        return "".join(self.rng.choice(["an", "er", "th", "on", "de", "la", "mi", "so", "ka", "in"]) for _ in range(self.rng.randint(1, 3)))

    def card(self, size: int = 16) -> str:
        d = self.rng.choice("3456") + self.num(size - 2)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def filled(self, forms: list[str]) -> str:
        """A form with d for any digit, n for one that is not 0, and s for one separator all through."""
        form, s = self.rng.choice(forms), self.rng.choice(" -.")
        return "".join(self.num(1, "0123456789") if c == "d" else self.num(1) if c == "n" else s if c == "s" else c for c in form)

    def strong(self, value: str | None) -> str:
        """A loose writing, of a real value if there is one."""
        rng, check = self.rng, self.check
        if self.kind == "email":
            user, _, host = (value or f"{self.word()}{rng.choice(['.', '_', '', self.num(2)])}{self.word()}@{self.word()}.{rng.choice(sorted(_ENDS))}").partition("@")
            at, dot = rng.choice([("{at}", "."), (" at ", " dot "), ("(AT)", "(DOT)"), ("[at]", " dot ")] if check else [("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", "."), (" @ ", "."), ("[at]", "."), (" at ", " dot "), (" AT ", " DOT ")])
            return user + at + (host.replace(".", dot) if dot != "." else host)
        if self.kind == "ip":
            h = lambda: "%x" % rng.randint(1, 65535)
            full = ":".join(h() for _ in range(8))
            short = rng.choice([lambda: f"fe80::{h()}:{h()}", lambda: f"::{h()}:{h()}", lambda: f"{h()}:{h()}:{h()}::"] if check else [lambda: f"2001:{h()}::{h()}", lambda: f"{h()}:{h()}:{h()}::{h()}:{h()}", lambda: f"{h()}::{h()}:{h()}:{h()}"])()
            return full if rng.random() < 0.5 else short if _is_ipv6(short) else full
        if self.kind == "card":
            d = "".join(c for c in value if c.isdigit()) if value else self.card(rng.choice([15, 16, 16]))
            d = d if len(d) in (15, 16) else self.card()
            s = rng.choice(["  ", "."] if check else [".", "/", " .", "- "])
            return s.join(re.findall("....", d)) if len(d) == 16 else s.join([d[:4], d[4:10], d[10:]])
        forms = ["0ddd-dddddd", "(nddd)ddd-dddd", "ndd.ddd.dddd", "0dddsddsddsddd", "1-ndd-ddd-dddd", "0ndd/dddddd"] if check else ["(ndd) ddd-dddd", "0dsddsddsddsdd", "0ddsdddsdddd", "0ddd ddddddd", "ndd-dddd", "0ndddddddddd", "0049 ndd ddddddd", "(0ndd) dddddd", "0ndd/ddddddd", "ndd-ddd-dddd"]
        return self.filled(forms)

    def weak(self, value: str | None) -> str:
        if self.kind == "card":  # mistyped
            d = self.card()
            k = self.rng.randrange(16)
            d = d[:k] + str((int(d[k]) + self.rng.randint(1, 9)) % 10) + d[k + 1 :]
            return d if self.rng.random() < 0.5 else " ".join(re.findall("....", d))
        return self.filled(["ddd ddd dddd", "dddd dddd", "ddd dddd"] if self.check else ["ndd ddd ddd", "ndd ddd dddd", "ndddd ddddd", "nd dd dd dd dd"]) if self.kind == "phone" else self.strong(value)

    def alike(self) -> str:
        rng, check = self.rng, self.check
        if self.kind == "email":
            w = self.word
            return rng.choice([f"{w()} at {w()} dot {w()}{w()}{w()}", f"{self.num(2)} @ {self.num(2)}.{self.num(1)}"] if check else [f"{w()} @ {w()}.{w()}{w()}", f"{w()} (at) {w()}.{w()}{w()}{w()}", f"{self.num(2)} @ {self.num(1)}.{self.num(2)}", f"{w()} @ {self.num(3)}.{self.num(2)}", f"{w()} at {self.num(1)} dot {w()}"])
        if self.kind == "ip":
            two = lambda: self.num(2, "0123456")
            h = lambda: "%02x" % rng.randint(0, 255)
            return rng.choice([f"{two()}:{two()}:{two()}:{two()}", ":".join(h() for _ in range(7)), f"{self.num(1)}:{two()}:{two()}"] if check else [f"{two()}:{two()}:{two()}", ":".join(h() for _ in range(6)), ":".join(self.num(2) for _ in range(rng.randint(4, 7))), f"::{self.word()[:1]}:"])
        if self.kind == "card":
            return self.filled(["dddsdddddsddddddd", "20dddddddddddd", "ndddddddddddddd", "ndd ddd ddd ddd ddd"] if check else ["nddddddddddddddd", "ndddddddddddd", "ndddddddddddddddddd", "nddd.dddd.dddd.dddd", "nddd dddd dddd dddd", "978-d-dd-dddddd-d", "ndd.ddd.ddd.ddd.ddd", "20dddddddddddd", "nddddddd dddddddd"])
        date = rng.choice([f"{rng.randint(1900, 2099)}s{self.num(1, '01')}ds{self.num(1, '0123')}d", f"{self.num(1, '0123')}ds{self.num(1, '01')}ds{rng.randint(1900, 2099)}"])
        return self.filled([date, "nd ddd ddd", "nddd/dddd", "ndd.ddd.ddd", "nddd.dddd", "ndd ddd ddd ddd"] if check else [date, date, "ndd ddd ddd", "ndd.ddd.ddd", "nd ddd ddd", "nddd-nddd", "nddd dddd", "ndd ddd ddd ddd", "nd.ddd.ddd.ddd", "ndd-dd-dddd", "ndddd.dddd", "nd dd dd dd", "ndsddsddsddsdd", "nddds.ddds.ddd", "nd.dd-nd.dd ddd", "978-d-dd-dddddd-d"])


def _examples(kind: str, n: int = EXAMPLES, real: dict[str, list[tuple[str, str, str, bool]]] | None = None, check: bool = False) -> list[tuple[str, int, int, int]]:
    """(text, begin, end, label) of values and look-alikes, in real surroundings where there are some; the same every time. check: of held-out documents and other grammars."""
    rng = random.Random(f"{SEED}{kind}{check}")
    g, real = _Grammar(kind, rng, check), {k: [x[:3] for x in rows if x[3] == check] for k, rows in (real or {}).items()}
    own, plain, others = real.get(kind) or [], real.get("plain") or [], (real.get("unlike") or []) if kind == "card" else []
    out = []
    for i in range(n):
        y = i % 2
        cue = rng.choice(_CUES[kind]) + rng.choice([" ", ": ", " number ", "="])
        against = rng.choice(_AGAINST) + rng.choice([" ", ": ", "=", ""])
        around = rng.choice(plain)[1:] if plain and rng.random() < 0.8 else (f"{g.word()} ", rng.choice([" ", ".", ", ", "\n", ")"]) + g.word())
        if y and rng.random() < 0.25 and kind in ("card", "phone"):
            value, before, after = g.weak(None), around[0] + " " + cue, around[1]
        elif y:
            base = rng.choice(own) if own and rng.random() < 0.6 else None
            value = g.strong(base[0] if base else None)
            before, after = base[1:] if base and rng.random() < 0.6 else (around[0] + " " + (cue if rng.random() < 0.3 else ""), around[1])
        elif others and rng.random() < 0.4:
            value, before, after = rng.choice(others)
        else:
            value = g.weak(None) if kind in ("card", "phone") and rng.random() < 0.25 else g.alike()
            before, after = around[0] + " " + (against if rng.random() < 0.4 else ""), around[1]
        if kind == "card" and rng.random() < 0.2:  # two side by side are one run of digits, which no base pattern takes
            d = g.card() if y else g.filled(["nddddddddddddddd"])
            value, other = d if rng.random() < 0.6 else " ".join(re.findall("....", d)), g.card() if y else g.filled(["nddddddddddddddd"])
            before, after = rng.choice([(f"{before} {other} ", after), (before, f" {other}{after}")])
        if before[-1:].isalnum():
            before += " "
        if after[:1].isalnum():
            after = " " + after
        out.append((before + value + after, len(before), len(before) + len(value), y))
    rng.shuffle(out)
    return out


def train(real: dict[str, list[tuple[str, str, str, bool]]] | None = None, examples: int = EXAMPLES) -> dict[str, Boosted]:
    """A model for each kind from surroundings(); deterministic."""
    models = {}
    for kind in KINDS:
        rows, held = _examples(kind, examples, real), _examples(kind, examples, real, True)
        x, y = (np.array(v, float) for v in ([describe(t, kind, a, b) for t, a, b, _ in rows + held], [y for *_, y in rows + held]))
        models[kind] = Boosted().fit(x, y, np.arange(len(y)) >= len(rows))
    return models


def all_spans(text: str, models: dict[str, Boosted]) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: base ones and the candidates that the models select. Both by kind as listed, then begin."""
    base = base_spans(text)
    taken = Taken(base)
    scored = []
    by_kind: dict[str, list[Span]] = {}
    for s in proposals(text):
        if not taken.meets(s[1], s[2]):
            by_kind.setdefault(s[0], []).append(s)
    for kind, found in by_kind.items():
        p = models[kind].probability(np.array([describe(text, *s) for s in found], float))
        scored += [(-float(q), *s) for q, s in zip(p, found) if q >= models[kind].threshold]
    extra: list[Span] = []
    for _, kind, a, b in sorted(scored):
        if not taken.meets(a, b):
            taken.add(a, b)
            extra.append((kind, a, b))
    return base, sorted(base + extra, key=lambda s: (KINDS.index(s[0]), s[1]))


def find_pii(docs: DataFrame, models: dict[str, Boosted] | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans; one row for each row of docs. Null texts are empty."""
    models = docs.sparkSession.sparkContext.broadcast(models or train(surroundings(docs)))  # four models of 40 small trees
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    def one(batch):
        out = {k: [] for k in schema.names[1:]}
        for text in batch.column(1).to_pylist():
            base, every = all_spans(text or "", models.value)
            for k in KINDS:
                out[f"n_{k}"].append(sum(s[0] == k for s in base))
            out["base_sha256"].append(digest(base))
            out["spans"].append(joined(every))
        return {"doc_id": batch.column(0)} | out

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lambda it: grouped(it, "text", schema, one), ", ".join(["doc_id long", *(f"n_{k} long" for k in KINDS), "base_sha256 string, spans string"]))


def redacted(text: str, spans: list[Span]) -> str:
    """text with every span replaced by its kind in brackets; overlapping spans become one, named by the earliest."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, models: dict[str, Boosted] | None = None) -> DataFrame:
    """docs, all rows and columns, with the spans in text replaced and n_chars (where there is such a column) counted anew. Null texts stay null."""
    models = docs.sparkSession.sparkContext.broadcast(models or train(surroundings(docs)))

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                i = piece.schema.get_field_index("text")
                text = [t if t is None else redacted(t, all_spans(t, models.value)[1]) for t in piece.column(i).to_pylist()]
                yield piece.set_column(i, piece.schema.field(i), pa.array(text, piece.schema.field(i).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
