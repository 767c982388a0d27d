"""Functions and comments of source code, as byte spans of UTF-8.

Python is read with ast and tokenize; the C-like languages with a lexer for strings, comments and brackets, which also gets
through truncated code. Exact for valid code, best effort otherwise. Spans come from row UDFs, which a worker gets a hundred rows at a time, so
that its memory follows the texts and not the table (Arrow batches have 10,000 rows of any length); text work on them is native.
"""

from __future__ import annotations

import ast
import functools
import io
import itertools
import re
import tokenize
from array import array
from bisect import bisect_left

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from haystrata.functions.text import col

FUNCTION_TYPE = "array<struct<name:string,start_line:int,end_line:int,start_byte:int,end_byte:int>>"
SPAN_TYPE = "array<struct<start:int,end:int>>"
_C_COMMENT = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])'|`(?:\\.|[^`\\])*`?""", re.S)
#: Two or more lines of nothing but a comment, with the first one and what is before its #.
_COMMENT_LINES = re.compile(r"^(([ \t]*)#[^\n]*\n)(?:[ \t]*#[^\n]*\n)+", re.M)
_HEADS = {
    "java": re.compile(r"((?:[\w<>\[\],.?&]+\s+)+?)(\w+)\s*\(.*\)\s*(?:\[\]\s*)*(?:throws\s+[\w.,\s]+)?$", re.S),
    "typescript": re.compile(r"((?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?)function\s*\*?\s*(\w+)\s*(?:<.*?>)?\s*\(.*\)\s*(?::.*)?$", re.S),
    "rust": re.compile(r"((?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|default|extern(?:\s+\S+)?)\s+)*)fn\s+(\w+)\s*(?:<.*?>)?\s*\(.*$", re.S),
    "cpp": re.compile(r"((?:[\w:<>,*&\[\]]+\s+)+)(\w+)\s*\(.*\)\s*(?:(?:const|noexcept|override|final)\s*)*(?:->.*)?$", re.S),
    "go": re.compile(r"()func\s+(\w+)\s*(?:\[.*?\])?\s*\(.*$", re.S),
}
#: Heads whose next brace is a type's and not the body's.
_TYPE_HEADS = {
    "typescript": re.compile(r"(?:export\s+|default\s+|declare\s+|async\s+)*function\b(?:(?:[^()]*<[^()]*)|.*\)\s*:\s*(?:.*(?:[|&<,:\[(]|=>)\s*)?)$", re.S),
    "go": re.compile(r".*\b(?:interface|struct)\s*$", re.S),
}
_CLASS = re.compile(r"\b(?:class|struct|union)\b[^()=]*$")
_ANNOTATION = re.compile(r"@(?!interface\b)[\w.]+\s*(?:\([^()]*\))?")
_MODIFIERS = frozenset("public private protected static final abstract synchronized native default strictfp".split())
_NO_TYPE = frozenset("new record class interface enum return throw else case".split())
_NO_NAME = frozenset("if for while switch catch synchronized else do try return new match loop".split())


class _Places:
    """Code points to bytes, and line and column to code points."""

    def __init__(self, text: str):
        self.text = text
        self.ascii = text.isascii()
        self.bytes: np.ndarray | None = None
        self.lines = [0]
        for m in re.finditer("\n", text):
            self.lines.append(m.end())

    def byte(self, i: int) -> int:
        if self.ascii:
            return i
        if self.bytes is None:
            codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
            self.bytes = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))])
        return int(self.bytes[i])

    def line(self, i: int) -> int:
        from bisect import bisect_right

        return bisect_right(self.lines, i) - 1


def _python_functions(text: str):
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines, at, starts = text.encode().split(b"\n"), 0, []
    for x in lines:
        starts.append(at)
        at += len(x) + 1
    found = []
    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            found.append((n.name, n.lineno - 1, n.end_lineno, starts[n.lineno - 1] + n.col_offset, starts[n.end_lineno - 1] + n.end_col_offset))
    return sorted(found, key=lambda x: x[3])


def _python_tokens(text: str) -> list[tuple[int, int, str]]:
    """(line, column, comment) of the # comments, as far as the text can be read."""
    found = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT:
                found.append((t.start[0] - 1, t.start[1], t.string))
    except (tokenize.TokenError, SyntaxError):
        pass
    return found


def _headed(text: str) -> tuple[str, list[int], dict[tuple[int, int], int]]:
    """text with only the first of each run of comment lines, which of the text's lines each of its lines is, and by line and column of a run's first # how many lines the run has."""
    parts, rows, runs, at, row = [], [], {}, 0, 0
    for m in _COMMENT_LINES.finditer(text):
        rows += range(row, row + text.count("\n", at, m.start()) + 1)
        row, n = rows[-1], m[0].count("\n")
        runs[len(rows) - 1, m.end(2) - m.start()] = n
        row += n
        parts.append(text[at : m.end(1)])
        at = m.end()
    return "".join([*parts, text[at:]]), [*rows, *range(row, row + text.count("\n", at) + 1)], runs


def _python_comments(text: str):
    """# comments, and string statements inside blocks (not the module's own docstring).

    Lines of nothing but a comment leave the tokenizer's state after another such line as it is, so it reads the first of a run; where that is no
    comment (it is in a string), it reads all.
    """
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    starts = [0, *itertools.accumulate(len(x) + 1 for x in lines)]
    whole = text, range(len(lines)), {}
    short, rows, runs = whole if "\r" in text or "\0" in text else _headed(text)  # a line end, or an error, where it is in a comment
    tokens = _python_tokens(short)
    if runs and not runs.keys() <= {t[:2] for t in tokens}:
        short, rows, runs = whole
        tokens = _python_tokens(short)
    found = []
    for r, c, comment in tokens:
        line, at = lines[rows[r]], starts[rows[r]]
        at += c if line.isascii() else len(line.decode("utf-8", "surrogatepass")[:c].encode("utf-8", "surrogatepass"))
        found.append((at, at + len(comment.encode("utf-8", "surrogatepass"))))
        for i in range(rows[r] + 1, rows[r] + runs.get((r, c), 1)):
            found.append((starts[i + 1] - 1 - len(lines[i].lstrip(b" \t")), starts[i + 1] - 1))
    if "'" not in short and '"' not in short:
        return sorted(found)
    try:
        tree = ast.parse(short)
    except (SyntaxError, ValueError, RecursionError):
        return sorted(found)
    for n in ast.walk(tree):
        for part in (() if isinstance(n, ast.Module) else [b for k in ("body", "orelse", "finalbody") if isinstance(b := getattr(n, k, None), list)]):
            for s in part:
                if isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str):
                    found.append((starts[rows[s.lineno - 1]] + s.col_offset, starts[rows[s.end_lineno - 1]] + s.end_col_offset))
    return sorted(found)


def _c_comments(text: str):
    p = _Places(text)
    return [(p.byte(m.start()), p.byte(m.end())) for m in _C_COMMENT.finditer(text) if m[0][:2] in ("//", "/*")]


def _head_name(lead: str, language: str, in_class: bool) -> str | None:
    """The name of the function whose body follows a head, None if it is none."""
    got = _HEADS[language].match(_ANNOTATION.sub(" ", lead).strip() if language == "java" else lead.rstrip())
    if not got or got[2] in _NO_NAME:
        return None
    before = got[1].split()
    if language == "java":
        types = [x for x in before if x not in _MODIFIERS]
        return got[2] if types and not _NO_TYPE.intersection(types) and any(x[:1] != "<" for x in types) else None
    if language == "cpp":
        return None if in_class or before[-1].endswith(("*", "&", ":")) or _NO_TYPE.intersection(before) else got[2]
    return got[2]


def _c_functions(text: str, language: str):
    """Brace blocks whose head, since the last ; { or } that is not in brackets of its own, reads like a function. A brace in brackets, or of a type in the head, leaves the head as it is."""
    blank = _C_COMMENT.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    p, found, head = _Places(text), [], 0
    stack: list[tuple] = []  # of open brackets: the bracket, (name, begin) of a function, the head that goes on after it, whether it is a class
    for m in re.finditer(r"[(){}\[\];]", blank):
        c, i = m[0], m.start()
        within = bool(stack) and stack[-1][0] != "{"
        if c in "([":
            stack.append((c, None, None, False))
        elif c in ")]":
            if within and stack[-1][0] == "(["[c == "]"]:
                stack.pop()
        elif c == ";":
            head = head if within else i + 1
        elif c == "{":
            lead = "" if within or language not in _HEADS else blank[head:i]
            a = head + len(lead) - len(lead.lstrip())
            lead = lead.lstrip()
            kind = language in _TYPE_HEADS and _TYPE_HEADS[language].match(lead)
            name = None if kind or not lead else _head_name(lead, language, bool(stack) and stack[-1][3])
            stack.append((c, (name, a) if name else None, head if within or kind else None, language == "cpp" and bool(_CLASS.search(lead))))
            head = i + 1
        else:
            while stack and stack[-1][0] != "{":
                stack.pop()
            _, top, before, _ = stack.pop() if stack else ("", None, None, False)
            if top:
                found.append((top[0], p.line(top[1]), p.line(i) + 1, p.byte(top[1]), p.byte(i + 1)))
            head = i + 1 if before is None else before
    return sorted(found, key=lambda x: x[3])


def functions(text: str | None, language: str) -> list[tuple]:
    """(name, start_line, end_line, start_byte, end_byte) of the functions in a file; lines 0-based, ends exclusive."""
    if not text:
        return []
    return _python_functions(text) if language == "python" else _c_functions(text, language)


def comments(text: str | None, language: str) -> list[tuple[int, int]]:
    """Byte spans of the comments, in order."""
    if not text:
        return []
    return _python_comments(text) if language == "python" else _c_comments(text)


def _outer(spans):
    """Spans without those inside others."""
    out = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def splice(text: str | None, language: str, replace) -> str:
    """text with every comment replaced by replace(comment)."""
    raw, out, at = (text or "").encode(), [], 0
    for a, b in _outer(comments(text, language)):
        out += [raw[at:a], replace(raw[a:b].decode(errors="replace")).encode()]
        at = b
    return b"".join([*out, raw[at:]]).decode(errors="replace")


def remove_comments(text: str | None, language: str) -> str:
    return splice(text, language, lambda c: "")


def clean_segment(text: str, language: str, path_comments: set[str]) -> str:
    """Comments removed but for those that name a context path."""
    return splice(text, language, lambda c: c if c in path_comments else "")


def clean_partial_file(text: str, language: str, partial_lines: int, sign: str, path: str) -> str:
    """The file's first partial_lines - 1 lines with comments blanked line for line, after its path comment; an ellipsis ends the last line."""
    kept = splice(text, language, lambda c: "\n" * c.count("\n")).split("\n")[: max(0, partial_lines - 1)]
    return f"{sign} Path: {path}\n" + "\n".join(kept) + "...\n"


class _Numbered:
    """Numbered comment lines as one text, with where each begins and the tokens before it; what has been made is kept, up to HELD lines."""

    HELD = 1 << 16

    def __init__(self, sign: str, count):
        self.sign, self.count, self.text, self.starts, self.sums = sign, count, "", array("q", [0]), array("q", [0])

    def line(self, k: int) -> str:
        return f"{self.sign} Line Number {k}\n"

    def grow(self, n: int) -> None:
        lines = [self.line(k) for k in range(len(self.sums) - 1, n)]
        for x in lines:
            self.starts.append(self.starts[-1] + len(x))
            self.sums.append(self.sums[-1] + self.count(x))
        self.text += "".join(lines)

    def take(self, tokens: int, k: int) -> tuple[str, int]:
        out = []
        if 0 < tokens and k < self.HELD:
            while len(self.sums) <= self.HELD and (len(self.sums) <= k + 1 or self.sums[-1] - self.sums[k] < tokens):
                self.grow(min(self.HELD, max(k + 1, 2 * len(self.sums))))
            end = min(bisect_left(self.sums, self.sums[k] + tokens, k), len(self.sums) - 1)
            out.append(self.text[self.starts[k] : self.starts[end]])
            tokens, k = tokens - self.sums[end] + self.sums[k], end
        while tokens > 0:
            out.append(self.line(k))
            tokens -= self.count(out[-1])
            k += 1
        return "".join(out), k


_numbered = functools.lru_cache(maxsize=4)(_Numbered)


def padding(sign: str, tokens: int, count, start: int = 0) -> tuple[str, int]:
    """Numbered comment lines until they make up for so many tokens, and the next number."""
    return _numbered(sign, count).take(tokens, start)


def _cleaned_side(part: str, language: str, far: dict | None, sign: str, keep: set[str], first: bool) -> str:
    """One side of a context without comments. far: its outermost file (path, content, n_lines in the context), cleaned as a whole, since the context may cut it anywhere."""
    if far is None:
        return clean_segment(part, language, keep)
    lines, n = part.split("\n"), int(far["n_lines"])
    whole = clean_partial_file(far["content"], language, n, sign, far["path"])
    if first:
        return whole + clean_segment("\n".join(lines[n:]), language, keep)
    return clean_segment("\n".join(lines[: len(lines) - 1 - n]) + "\n", language, keep) + whole


def clean_context(language: str, sign: str, prefix: str, needle: str, suffix: str, paths: list[str], top: dict | None, bottom: dict | None, ratio: float, pad: bool, count) -> tuple[str, str, str]:
    """Prefix, needle and suffix without comments but for those that name one of paths. pad: comment lines before the prefix and after the suffix make
    up for the tokens removed, those of the needle shared by ratio, less one on each side, so that the needle keeps its place."""
    new = bare_context(language, sign, prefix, needle, suffix, paths, top, bottom)
    return padded_context((prefix, needle, suffix), new, sign, ratio, count) if pad else new


def bare_context(language: str, sign: str, prefix: str, needle: str, suffix: str, paths: list[str], top: dict | None, bottom: dict | None) -> tuple[str, str, str]:
    keep = {f"{sign} Path: {p}" for p in paths}
    return _cleaned_side(prefix, language, top, sign, keep, True), clean_segment(needle, language, keep), _cleaned_side(suffix, language, bottom, sign, keep, False)


def padded_context(old: tuple[str, str, str], new: tuple[str, str, str], sign: str, ratio: float, count) -> tuple[str, str, str]:
    lost = [count(a) - count(b) for a, b in zip(old, new)]
    before = int(lost[1] * ratio)
    head, k = padding(sign, before + lost[0] - 1, count)
    tail, _ = padding(sign, lost[1] - before + lost[2] - 1, count, k)
    return head + "\n" + new[0], new[1], new[2] + tail + "\n"


def obfuscate(text: str | None, language: str) -> str:
    """Every comment as NUL bytes of the same byte length with a line end last; the text keeps its byte length."""
    return splice(text, language, lambda c: "\0" * (len(c.encode()) - 1) + "\n" if c else "")


def rename_functions(text: str, language: str, start: int = 0) -> str:
    """Function names replaced by function_<k>, whole words only."""
    for k, name in enumerate(dict.fromkeys(f[0] for f in functions(text, language))):
        text = re.sub(rf"\b{re.escape(name)}\b", f"function_{start + k}", text)
    return text


def _udf(fn, kind: str):
    return F.udf(fn, kind, useArrow=False)


def extract_functions(text, language) -> Column:
    return _udf(functions, FUNCTION_TYPE)(col(text), col(language))


def comment_spans(text, language) -> Column:
    return _udf(lambda t, x: _outer(comments(t, x)), SPAN_TYPE)(col(text), col(language))


def comment_ratio(text, language) -> Column:
    """Bytes in comments of all bytes; an empty text has 0."""
    spans = F.aggregate(comment_spans(text, language), F.lit(0), lambda a, s: a + s["end"] - s["start"])
    return F.when(F.octet_length(col(text)) > 0, spans / F.octet_length(col(text))).otherwise(0.0)


def without_comments(text, language) -> Column:
    return _udf(remove_comments, "string")(col(text), col(language))


def obfuscated(text, language) -> Column:
    return _udf(obfuscate, "string")(col(text), col(language))


def renamed_functions(text, language) -> Column:
    return _udf(rename_functions, "string")(col(text), col(language))


def first_function(block, language) -> str | None:
    """The code of the first function in a text, None without one."""
    found = functions(block, language)
    return block.encode()[found[0][3] : found[0][4]].decode() if found else None
