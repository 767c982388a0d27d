"""Context construction: token-budgeted code around a needle, by running sums.

Every line costs at least one token, so "add lines while the total fits" keeps the rows whose running sum fits. The same
holds for whole files: a neighbour file is visited while the budget less the files before it is positive, and only the one
file that does not fit whole is cut line by line. Token sums of the files are made once a repository, over numbers only; a needle
finds the files it visits by an equality join on stretches of that sum as long as a context, and only their texts are fetched.

files: language, repo, path, file_idx, content. needles: language, repo, path, name, start_byte, end_byte, needle_ord,
n_needles. Offsets are bytes of UTF-8 (offset_mode='bytes') or code points ('chars').
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haystrata.functions import syntax
from haystrata.functions.text import path_comment, position_ratio, prefix_budget, space_tokens
from haystrata.operators.running import sums_before
from haystrata.schema import COMMENT_SIGN
from haystrata.sources.sinks import written

ELLIPSIS = "...\n"


def budget_lines(lines: DataFrame, key: list[str], budget, backward: bool = False) -> DataFrame:
    """lines (key, line_no, n_tok, …) that fit the budget from the top, or backward from the bottom, with run: the running sum."""
    order = F.desc("line_no") if backward else F.asc("line_no")
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("run", F.sum("n_tok").over(w)).where(F.col("run") <= budget)


def file_budget(costs: DataFrame, key: list[str], budget, order: str, backward: bool = False, orders: DataFrame | None = None) -> DataFrame:
    """costs (key, order, n_tok, …) of the files to visit, the first by order first or, backward, the last, with left: the budget that is left for each, and whole: it fits. orders: see sums_before()."""
    rows = sums_before(costs, key, order, {"left": "n_tok"}, backward, orders=orders).withColumn("left", budget - F.col("left"))
    return rows.where(F.col("left") > 0).withColumn("whole", F.col("n_tok") <= F.col("left"))


def _sign() -> Column:
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in COMMENT_SIGN.items() for x in (F.lit(k), F.lit(v))]), F.col("language")), F.lit("#"))


def _text(order: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("part").alias("t")))), lambda x: x["t"]), "")


def _cut(lines: DataFrame, key: list[str], backward: bool, ellipsis: bool) -> DataFrame:
    """The text of each group's fitting lines, with an ellipsis when some did not fit."""
    order = F.desc("line_no") if backward else F.asc("line_no")
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("fits", F.sum("n_tok").over(w) <= F.col("budget"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("line_no", "line")))), lambda x: F.concat(x["line"], F.lit("\n"))), "")
    end = F.when(F.bool_or(~F.col("fits")), F.lit(ELLIPSIS)).otherwise("") if ellipsis else F.lit("")
    return rows.groupBy(*key).agg(F.concat(text, end).alias("part"))


def _cut_array(rows: Column, budget: Column, count, backward: bool, ellipsis: bool) -> Column:
    """(tokens, part) of an array of lines: the tokens of all, and what _cut() says. For counters that are columns: the lines stay in their row."""
    costs = F.transform(rows, lambda x: count(F.concat(x, F.lit("\n"))).cast("long"))
    run = F.aggregate(F.reverse(costs) if backward else costs, F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n")), lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["n"] + F.when(a["sum"] + x <= budget, 1).otherwise(0)).alias("n")))
    of = lambda r: F.struct(r["sum"].alias("tokens"), F.concat(
        F.array_join(F.transform(F.slice(rows, F.size(rows) - r["n"] + 1 if backward else F.lit(1), r["n"]), lambda x: F.concat(x, F.lit("\n"))), ""),
        F.when(r["n"] < F.size(rows), F.lit(ELLIPSIS)).otherwise("") if ellipsis else F.lit(""),
    ).alias("part"))
    return F.get(F.transform(F.array(run), of), F.lit(0))


def _rows_of(path: str) -> Column:
    """A file's lines in a context: the comment with its path, then its own."""
    return F.concat(F.array(path_comment(_sign(), path)), F.split("content", "\n"))


def line_costs(files: DataFrame, count) -> DataFrame:
    """(language, repo, file_idx, line_no, n_tok): the tokens of a file's path comment, which is line 0, and of its lines."""
    lines = files.select("language", "repo", "file_idx", F.posexplode(_rows_of("path")).alias("line_no", "line"))
    return lines.withColumn("n_tok", count(F.concat("line", F.lit("\n")))).drop("line")


def file_costs(files: DataFrame, count=space_tokens, lines: DataFrame | None = None) -> DataFrame:
    """(language, repo, file_idx, n_tok, before): each file's tokens and those of the repository's files before it. lines: line_costs(), if they are held already."""
    if count.column and lines is None:
        tokens = F.aggregate(F.transform(_rows_of("path"), lambda x: count(F.concat(x, F.lit("\n")))), F.lit(0), lambda a, x: a + x)
        costs = files.select("language", "repo", "file_idx", tokens.cast("long").alias("n_tok"))
    else:  # batches of lines
        lines = line_costs(files, count) if lines is None else lines
        costs = lines.groupBy("language", "repo", "file_idx").agg(F.sum("n_tok").cast("long").alias("n_tok"))
    return sums_before(costs, ["language", "repo"], "file_idx", {"before": "n_tok"}, orders=files)


def visited(needles: DataFrame, costs: DataFrame, span: int, backward: bool) -> DataFrame:
    """(needle columns, file_idx, n_tok, left, whole) of the files that needles (language, repo, own_idx, own_end or own_begin as at, budget of at most span) visit.

    Before: files whose end is in (at - budget, at]; after: files whose begin is in [at, at + budget). Both lie in at most two stretches of span tokens.
    """
    place = F.col("before") + F.col("n_tok") - 1 if backward else F.col("before")
    f = costs.select("language", "repo", F.col("file_idx").alias("to_idx"), "n_tok", "before", F.floor(place / span).alias("stretch"))
    low, high = (F.col("at") - F.col("budget"), F.col("at")) if backward else (F.col("at"), F.col("at") + F.col("budget"))
    n = needles.where("budget > 0").withColumn("stretch", F.explode(F.sequence(F.floor(F.greatest(low, F.lit(0)) / span), F.floor(high / span))))
    got = n.join(f, ["language", "repo", "stretch"])
    got = got.where(F.col("to_idx") < F.col("own_idx") if backward else F.col("to_idx") > F.col("own_idx"))
    spent = F.col("at") - F.col("before") - F.col("n_tok") if backward else F.col("before") - F.col("at")
    got = got.withColumn("left", F.col("budget") - spent).where(F.col("left") > 0).withColumn("whole", F.col("n_tok") <= F.col("left"))
    return got.drop("stretch", "before", "at").withColumnRenamed("to_idx", "file_idx")


def make_context(needles: DataFrame, files: DataFrame, context_size: int, count=space_tokens, offset_mode: str = "bytes", parts: bool = False, costs: DataFrame | None = None) -> DataFrame:
    """needles with position_ratio, code_context, needle_token_start, needle_token_end, code_context_ntokens.

    Needles whose file is missing are dropped, as no context can be cut for them. A needle larger than its share of the
    budget gets an empty prefix. parts: also prefix, needle_code, suffix, context_paths, and top_file and bottom_file (path, content, n_lines): the
    outermost neighbour files, null without any. costs: file_costs() of these files, made and written here if there are none.
    """
    key = ["language", "repo", "path", "name", "start_byte", "end_byte", "needle_ord"]
    needles = needles.withColumn("position_ratio", position_ratio("needle_ord", "n_needles"))
    costs = written(file_costs(files, count)) if costs is None else costs
    own = needles.join(files.select("language", "repo", "path", "file_idx", "content"), ["language", "repo", "path"]).join(costs.withColumnRenamed("n_tok", "file_tok"), ["language", "repo", "file_idx"])
    if offset_mode == "bytes":
        raw = F.encode("content", "UTF-8")
        piece = lambda a, n: F.decode(F.substring(raw, a, n), "UTF-8")
    else:
        piece = lambda a, n: F.substring(F.col("content"), a, n)
    own = own.withColumn("needle_code", piece(F.col("start_byte") + 1, F.col("end_byte") - F.col("start_byte"))).withColumn("before_needle", piece(F.lit(1), F.col("start_byte"))).withColumn("after_needle", piece(F.col("end_byte") + 1, F.lit(2**31 - 1)))
    own = own.withColumn("needle_tok", count(F.col("needle_code"))).withColumn("pre", prefix_budget(F.lit(context_size), "position_ratio", "needle_tok"))
    own = own.withColumn("suf", F.lit(context_size) - F.col("needle_tok") - F.col("pre")).drop("content")
    # the needle's own file
    sides = (("prefix", True, "pre", F.concat(F.array(path_comment(_sign(), "path")), F.split("before_needle", "\n"))), ("suffix", False, "suf", F.split("after_needle", "\n")))
    if count.column:
        for side, backward, budget, rows in sides:
            own = own.withColumn(f"{side}_cut", _cut_array(rows, F.col(budget), count, backward, not backward))
        own = own.withColumns({f"{s}_own": F.col(f"{s}_cut.part") for s in ("prefix", "suffix")} | {f"{s}_own_tok": F.col(f"{s}_cut.tokens") for s in ("prefix", "suffix")}).drop("prefix_cut", "suffix_cut", "before_needle", "after_needle")
    out = own = written(own)  # both sides and the result read it, each only the columns it needs
    texts = files.select("language", "repo", "file_idx", F.col("path").alias("to_path"), "content")
    for side, backward, budget, rows in sides:
        base = own.select(*key, F.col("file_idx").alias("own_idx"), (F.col("before") if backward else F.col("before") + F.col("file_tok")).alias("at"), F.col(budget).alias("side_budget"), *[F.col(f"{side}_own_tok").alias("own_tok")] * bool(count.column))
        if not count.column:
            lines = own.select(*key, F.col(budget).alias("budget"), F.posexplode(rows).alias("line_no", "line"))
            lines = lines.withColumn("n_tok", count(F.concat("line", F.lit("\n"))))
            base = base.join(lines.groupBy(*key).agg(F.sum("n_tok").alias("own_tok")), key)
            out = out.join(_cut(lines, key, backward, not backward).withColumnRenamed("part", f"{side}_own"), key, "left")
        # neighbour files, nearest first: numbers only, then the texts of those
        near = visited(base.withColumn("budget", F.col("side_budget") - F.col("own_tok")).drop("own_tok", "side_budget"), costs, context_size, backward)
        near = written(near)
        alone = near.isEmpty()
        near = near.join(texts, ["language", "repo", "file_idx"])
        name = [*key, "file_idx", "to_path", "content"]
        whole = near.where("whole").select(*name, F.concat(F.array_join(_rows_of("to_path"), "\n"), F.lit("\n")).alias("part"))
        edge = near.where("not whole")
        if count.column:
            edge = edge.select(*name, _cut_array(_rows_of("to_path"), F.col("left"), count, False, True)["part"].alias("part"))
        else:
            edge = edge.select(*name, F.col("left").alias("budget"), F.posexplode(_rows_of("to_path")).alias("line_no", "line"))
            edge = _cut(edge.withColumn("n_tok", count(F.concat("line", F.lit("\n")))), name, False, True).select(*name, "part")
        far = F.max_by(F.struct(F.col("to_path").alias("path"), "content", (F.size(F.split("part", "\n")) - 1).alias("n_lines")), -F.col("file_idx") if backward else F.col("file_idx"))
        paths = F.transform(F.array_sort(F.collect_list(F.struct("file_idx", "to_path"))), lambda x: x["to_path"])
        around = whole.union(edge).groupBy(*key).agg(_text("file_idx").alias(f"{side}_files"), far.alias("top_file" if backward else "bottom_file"), paths.alias(f"{side}_paths"))
        if alone:  # no needle has a neighbour file on this side, so the contexts stay where they are
            out = out.select(*key, *[c for c in out.columns if c not in key], *[F.lit(None).cast(f.dataType).alias(f.name) for f in around.schema if f.name not in key])
        else:
            out = out.join(around, key, "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    none = F.array().cast("array<string>")
    out = out.withColumn("prefix", F.concat(text("prefix_files"), text("prefix_own"))).withColumn("suffix", F.concat(text("suffix_own"), text("suffix_files")))
    out = out.withColumn("context_paths", F.concat(F.coalesce("prefix_paths", none), F.array("path"), F.coalesce("suffix_paths", none)))
    out = out.drop("before_needle", "after_needle", "needle_tok", "pre", "suf", "before", "file_tok", "prefix_own", "suffix_own", "prefix_own_tok", "suffix_own_tok", "prefix_files", "suffix_files", "prefix_paths", "suffix_paths", "file_idx")
    out = joined(out, count)
    return out if parts else out.drop("prefix", "needle_code", "suffix", "context_paths", "top_file", "bottom_file")


def joined(rows: DataFrame, count=space_tokens) -> DataFrame:
    """rows (prefix, needle_code, suffix) with code_context and the token places, counted on the three finished strings."""
    start = count(F.col("prefix"))
    rows = rows.withColumn("code_context", F.concat("prefix", "needle_code", "suffix")).withColumn("needle_token_start", start).withColumn("needle_token_end", start + count(F.col("needle_code")))
    return rows.withColumn("code_context_ntokens", F.col("needle_token_end") + count(F.col("suffix")))


def clean_contexts(rows: DataFrame, pad: bool, count=space_tokens) -> DataFrame:
    """Contexts of make_context(parts=True) without comments, padded or not, with their token places counted anew."""
    return clean_modes(rows, {"": pad}, count).drop("clean_mode")


def clean_modes(rows: DataFrame, modes: dict[str, bool], count=space_tokens) -> DataFrame:
    """clean_contexts() once for each of modes, {clean_mode: pad}. Comments are looked for once a context, however many modes there are."""
    kept = ["language", "sign", "prefix", "needle_code", "suffix", "context_paths", "top_file", "bottom_file", "position_ratio"]
    pads = list(modes.values())

    def run(r):
        far = lambda x: None if x is None or x["path"] is None else x
        old = (r["prefix"], r["needle_code"], r["suffix"])
        new = syntax.bare_context(r["language"], r["sign"], *old, r["context_paths"], far(r["top_file"]), far(r["bottom_file"]))
        return [syntax.padded_context(old, new, r["sign"], r["position_ratio"], count.text) if pad else new for pad in pads]

    clean = F.udf(run, "array<struct<prefix:string,needle:string,suffix:string>>", useArrow=False)  # few texts at a time
    held = [c for c in rows.columns if c not in ("prefix", "needle_code", "suffix")]
    rows = rows.withColumn("sign", _sign()).withColumn("clean", clean(F.struct(*kept)))
    rows = rows.select(*held, F.explode(F.arrays_zip(F.array(*[F.lit(m) for m in modes]).alias("mode"), F.col("clean"))).alias("one"))
    rows = rows.select(*held, F.col("one.mode").alias("clean_mode"), F.col("one.clean.prefix").alias("prefix"), F.col("one.clean.needle").alias("needle_code"), F.col("one.clean.suffix").alias("suffix"))
    return joined(rows, count)
