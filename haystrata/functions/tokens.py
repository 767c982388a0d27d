"""Token counters of subword tokenizers in files: for line costs, contexts and statistics in a model's own tokens.

A path names a file of the tokenizers library (.json), of tiktoken (.tiktoken, with its split pattern) or of sentencepiece (.model). Files are read where the executors run, once a
worker, and texts are encoded in Arrow batches. Nothing is trained here.

Where a .json file's tokenizer does nothing but split by the byte-level library's own pattern and merge, no token goes on from a letter over white space, so the counts of a text's
chunks (white space and what follows it) add up; a worker remembers those of up to CHUNKS short ones.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from haystrata.functions.text import Counter, col


#: Chunks that a worker remembers, the longest of them, and characters that are encoded at once.
CHUNKS, CHUNK_CHARS, BATCH_CHARS = 1 << 18, 40, 1 << 20
_CHUNK = re.compile(r"\s*\S+|\s+")
#: The byte-level pattern over characters that are letters, numbers and marks in every version of Unicode: _PART cuts texts of _KNOWN as the library does.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
_KNOWN = re.compile(rf"[\t\n\r -~{_LETTERS}«»¡¿‐-‧]*")
_PART = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")
#: White space that libraries do not agree on.
_RARE = re.compile(r"[^\S \t\n\r]")


def _in_chunks(made: dict) -> bool:
    """Whether a tokenizer (its .json) counts a text as the sum of its chunks."""
    split, model = made.get("pre_tokenizer") or {}, made.get("model") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    tokens = all(x.get("special") for x in made.get("added_tokens") or [])  # other ones are found in any text
    return bool(plain and tokens and made.get("normalizer") is None and not made.get("truncation") and not made.get("padding") and model.get("type") == "BPE" and not model.get("dropout"))


class _Chunks:
    """Counts of texts by the counts of their chunks. ids: the library's ids of texts."""

    def __init__(self, ids: Callable[[list[str]], list[list[int]]]):
        self.ids, self.known = ids, {}
        self.end = ids(["\n"])[0][0]

    def __call__(self, texts: list[str]) -> list[int]:
        out, begin, size = [], 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= BATCH_CHARS:
                out += self._some(texts[begin : i + 1])
                begin, size = i + 1, 0
        return out + self._some(texts[begin:])

    def _counts(self, new: list[str]) -> dict[str, int]:
        """Counts of distinct chunks: those without line ends as lines of one text, in which each line end is a token of its own."""
        lines = [x for x in new if not (x.isspace() or "\n" in x or _RARE.search(x))]
        rest = list(set(new).difference(lines)) if len(lines) < len(new) else []
        counts = dict(zip(rest, map(len, self.ids(rest))))
        if lines:
            ids = np.array(self.ids(["\n".join(lines) + "\n"])[0])
            counts.update(zip(lines, (np.diff(np.flatnonzero(ids == self.end), prepend=-1) - 1).tolist()))
        return counts

    def _some(self, texts: list[str]) -> list[int]:
        found = [_PART.findall(x) if _KNOWN.fullmatch(x) else [x] if _RARE.search(x) else _CHUNK.findall(x) for x in texts]
        known = self.known
        new = list({c for chunks in found for c in chunks if c not in known})
        counts = self._counts(new)
        if len(known) + len(new) > CHUNKS:
            counts.update((c, known[c]) for chunks in found for c in chunks if c in known)
            known = self.known = {}
        out = [sum([counts[c] if c in counts else known[c] for c in chunks]) for chunks in found]
        short = {c: n for c, n in counts.items() if len(c) <= CHUNK_CHARS}
        if len(known) + len(short) <= CHUNKS:
            known.update(short)
        return out


@functools.lru_cache(4)
def _many(path: str, pattern: str | None) -> Callable[[list[str]], list[int]]:
    kind = os.path.splitext(path)[1]
    if kind == ".json":
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        ids = lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return _Chunks(ids) if _in_chunks(json.loads(tokenizer.to_str())) and len(ids(["\n"])[0]) == 1 else lambda texts: list(map(len, ids(texts)))
    if kind == ".tiktoken":
        import base64

        import tiktoken

        if not pattern:
            raise ValueError("a tiktoken file needs the pattern that splits texts")
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        encoding = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(x)) for x in texts]
    if kind == ".model":
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)] if texts else []
    raise ValueError(f"{path}: not a .json, .tiktoken or .model file")


class SubwordCounter(Counter):
    """A Counter of one tokenizer file; null texts have null counts."""

    def __init__(self, path: str, pattern: str | None = None):
        super().__init__(count=None, column=None, setup=self._one)
        self.path, self.pattern = path, pattern

    def _one(self) -> Callable[[str], int]:
        return lambda text: _many(self.path, self.pattern)([text])[0]

    def __getstate__(self):
        return {"path": self.path, "pattern": self.pattern}

    def __setstate__(self, state):
        self.__init__(**state)

    def __call__(self, c) -> Column:
        path, pattern = self.path, self.pattern

        @F.pandas_udf("int")
        def run(values: pd.Series) -> pd.Series:
            held = values[values.notna()]
            return pd.Series(_many(path, pattern)(held.tolist()), index=held.index, dtype="Int32").reindex(values.index)

        return run(col(c))
