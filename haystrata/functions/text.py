"""Column functions: ids, budgets, prompts, slices, fences, paths, pass@k. All built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "```"
FENCED = rf"(?smdU)^{FENCE}(?:\w+)?\s*\n(.*?)^{FENCE}"
_BLANK = r"[\s\x1c-\x1f]+"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


class Counter:
    """Token counts of text: counter(column) is a column, counter.text(string) a number. count: of one string; column: a built-in expression with
    the same result, else count runs in Arrow batches. setup: makes count once a worker, for tokenizers that load files."""

    def __init__(self, count: Callable[[str], int] | None = None, column: Callable[[Column], Column] | None = None, setup: Callable[[], Callable[[str], int]] | None = None):
        self.count, self.column, self.setup = count, column, setup

    def text(self, value: str) -> int:
        if self.count is None:
            self.count = self.setup()
        return self.count(value)

    def __getstate__(self):
        return {"count": None if self.setup else self.count, "column": None, "setup": self.setup}

    def __call__(self, c) -> Column:
        return self.column(col(c)) if self.column else self._batched()(col(c))

    def _batched(self):
        own = Counter(self.count if not self.setup else None, None, self.setup)

        @F.pandas_udf("int")
        def run(values: pd.Series) -> pd.Series:
            return values.map(lambda x: None if x is None else own.text(x)).astype("Int32")

        return run


#: White-space tokens and the line end: the built-in line cost. Bytes, unlike text, are split at the white space of \\s alone.
space_tokens = Counter(lambda x: len(x.encode("utf-8", "surrogatepass").split()) + 1, lambda c: F.regexp_count(c, F.lit(r"\S+")) + 1)


def task_id(language, repo, name) -> Column:
    return F.concat(col(language), F.lit("::"), col(repo), F.lit("::"), col(name))


def cache_id(language, repo, name, context_size, ratio, clean_mode=None) -> Column:
    """The task id with context size and ratio, and the cleaning mode where one is given."""
    parts = [task_id(language, repo, name), F.lit("::"), col(context_size).cast("string"), F.lit("::"), col(ratio).cast("string")]
    return F.concat(*parts, *([F.lit("::"), F.lit(clean_mode)] if clean_mode else []))


def position_ratio(ordinal, total) -> Column:
    return (col(ordinal).cast("double") + F.lit(0.5).cast("double")) / col(total)


def prefix_budget(context_size, ratio, needle_tokens) -> Column:
    return (col(context_size) * col(ratio) - col(needle_tokens) / F.lit(2)).cast("int")


def description_block(description) -> Column:
    return F.concat(F.lit("\nFunction Description:"), col(description), F.lit("\n"))


def prompt(template, parts: dict) -> Column:
    """The parts that the template's lines name, one after another with nothing between; a name that is no part is an error when it is met."""
    held = F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), col(v))])
    piece = lambda k: F.coalesce(F.element_at(held, k), F.raise_error(F.concat(F.lit("no such part of a prompt: "), k)).cast("string"))
    return F.array_join(F.transform(F.split(col(template), "\n"), piece), "")


def actual_ratio(needle_token_start, code_context_ntokens) -> Column:
    """Where the needle really begins, as a share of the context's tokens; null for an empty context."""
    return F.try_divide(col(needle_token_start).cast("double"), col(code_context_ntokens))


def repo_tail(repo) -> Column:
    """The name of a repository without its owner."""
    return F.substring_index(col(repo), "/", -1)


def line_slice(text, start, end) -> Column:
    """Lines start (0-based) to end (exclusive)."""
    return F.array_join(F.slice(F.split(col(text), "\n"), F.greatest(col(start), F.lit(0)) + 1, F.greatest(col(end) - F.greatest(col(start), F.lit(0)), F.lit(0))), "\n")


def between(text, head: str, tail: str) -> Column:
    """What is after the last head, up to the next tail; the whole text without them."""
    return F.substring_index(F.substring_index(col(text), head, -1), tail, 1)


def strip(text) -> Column:
    return F.regexp_replace(col(text), rf"(?U)^{_BLANK}|{_BLANK}\z", "")


def fences(text) -> Column:
    """The bodies of fenced blocks of the stripped text."""
    return F.regexp_extract_all(strip(text), F.lit(FENCED), F.lit(1))


def tokens(text) -> Column:
    """White-space tokens of the stripped text; the empty text is one empty token."""
    return F.split(strip(text), rf"(?U){_BLANK}")


def drop_relative(path) -> Column:
    return F.array_join(F.filter(F.split(col(path), "/"), lambda x: ~x.isin(".", "..")), "/")


def model_name(stem) -> Column:
    return F.array_join(F.transform(F.split(col(stem), "_"), lambda x: F.when(x == "slash", "/").otherwise(x)), "")


def train_context(model, looked_up=None) -> Column:
    """The training context of a model by its name; names with a slash are looked up."""
    m = col(model)
    # Beginnings of model names and the contexts they were trained on.
    known = [("bigcode/starcoder2", "16k"), ("gpt-4-turbo", "128k"), ("gpt-4o-", "128k"), ("gpt-3.5-", "16k"), ("gemini-1.5-pro", "1000k"), ("gemini-1.5-flash", "1000k"), ("gemini-1.0-pro", "32k"), ("claude-3-", "200k")]
    out = F.when(m.startswith(known[0][0]), known[0][1])
    for k, v in known[1:]:
        out = out.when(m.startswith(k), v)
    if looked_up is not None:
        out = out.when(m.contains("/"), col(looked_up))
    return F.coalesce(out, F.lit("N/A"))


def pass_at_k(n, c, k) -> Column:
    """1 - C(n-c, k) / C(n, k): the chance that one of k of n samples, c of them correct, is correct."""
    n, c, k = col(n), col(c), col(k)
    product = F.aggregate(F.sequence(n - c + 1, F.greatest(n, n - c + 1)), F.lit(1.0), lambda a, i: a * (1 - k / i))
    return F.when(n - c < k, 1.0).when(c == 0, 0.0).otherwise(1 - product)


def path_comment(sign, path) -> Column:
    return F.concat(col(sign), F.lit(" Path: "), col(path))


def messages(user, system=None) -> Column:
    """The message list of a chat request; a null or empty system message is left out."""
    both = F.array(F.struct(F.lit("system").alias("role"), (col(system) if system is not None else F.lit(None).cast("string")).alias("content")), F.struct(F.lit("user").alias("role"), col(user).alias("content")))
    both = both.cast("array<struct<role:string,content:string>>")
    return F.filter(both, lambda x: (x["role"] == "user") | (F.coalesce(x["content"], F.lit("")) != ""))


def decode_chars(codes) -> Column:
    """Text from white-space separated character codes."""
    return F.array_join(F.transform(F.filter(F.split(col(codes), r"\s+"), lambda x: x != ""), lambda x: F.decode(F.unhex(F.lpad(F.hex(x.cast("int")), 8, "0")), "UTF-32")), "")


def big_file(files, sign) -> Column:
    """One text of array<struct<path, content>>: each file after a comment with its path."""
    return F.array_join(F.transform(F.array_sort(files), lambda f: F.concat(col(sign), F.lit(" current path: "), f["path"], F.lit("\n"), f["content"])), "")


# The request for a description, and the marks around the part that is kept. {name} and {code} are filled in.
DESC_HEAD, DESC_TAIL = "<desc_start>", "<desc_end>"
ASK = 'Can you **briefly** describe the purpose, input, output, and procedure of "{name}"?'
SKELETON = "1. **Purpose**: ...\n2. **Input**: ...\n3. **Output**: ...\n4. **Procedure**: ...\n"
NOTES = (
    "1. DO NOT reveal function names ({name}) and variable names\n"
    "2. Start with <desc_start> and end with <desc_end>\n"
    "3. Customize the description to differentiate it from other functions\n"
)


def annotation_prompt(name, code) -> Column:
    """The request to describe a function: question, code, question, skeleton, question, notes."""
    form = f"{ASK}\n\n{FENCE}\n{{code}}\n{FENCE}\n\n{ASK}\n\nPlease follow format to complete the skeleton below:\n\n{DESC_HEAD}\n{SKELETON}{DESC_TAIL}\n\n{ASK}\n\nNotes:\n{NOTES}"
    parts = [F.lit(form[a:b]) if x is None else col(x) for x, a, b in _cut_form(form, {"{name}": name, "{code}": code})]
    return F.concat(*parts)


def _cut_form(form: str, holes: dict):
    """The form as (None, begin, end) stretches and (column, 0, 0) holes, in order."""
    at = 0
    while True:
        found = min(((i, h) for h in holes if (i := form.find(h, at)) >= 0), default=None)
        if found is None:
            yield None, at, len(form)
            return
        yield None, at, found[0]
        yield holes[found[1]], 0, 0
        at = found[0] + len(found[1])
