"""End-to-end plans: task building, evaluation with a provider, scoring of stored outputs, curation of a dataset."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haystrata.functions import syntax, text
from haystrata.functions.provider import Provider, run_provider
from haystrata.operators import context, curate, deps, graph, score
from haystrata.operators.running import sums_before
from haystrata.streaming.resume import unfinished

# The order of a prompt's parts, and the instruction that models are asked with.
TEMPLATE = "instruction\ncode_context\ndescription\ninstruction"
INSTRUCTION = "Based on the function description and code context, please retrieve and repeat the exact described function from the code context in a code block wrapped by ```:"
CLEAN_MODES = ("none", "positional_padding", "no_padding")


def ordered_files(files: DataFrame, edges: DataFrame) -> DataFrame:
    """files with file_idx: their place in dependency order. Files outside the dependency graph are left out, as are nodes without a file."""
    order = graph.topo_order(edges).withColumnRenamed("topo_idx", "file_idx")
    return files.drop("file_idx").join(order, ["language", "repo", "path"])


def build_tasks(needles: DataFrame, files: DataFrame, context_size: int = 16 * 1024, languages: list[str] | None = None, clean_mode: str = "none", count=context.space_tokens) -> DataFrame:
    """Tasks of needles with a description, over files in order (file_idx)."""
    if clean_mode not in CLEAN_MODES:
        raise ValueError(f"clean_mode must be one of {CLEAN_MODES}")
    if languages:
        needles, files = (x.where(F.col("language").isin(languages)) for x in (needles, files))
    out = context.make_context(needles.where("description is not null"), files, context_size, count, parts=clean_mode != "none")
    if clean_mode != "none":
        out = context.clean_contexts(out, clean_mode == "positional_padding", count).drop("prefix", "needle_code", "suffix", "context_paths", "top_file", "bottom_file")
    out = out.withColumn("description", text.description_block("description")).withColumn("instruction", F.lit(INSTRUCTION)).withColumn("template", F.lit(TEMPLATE))
    out = out.withColumn("task_id", text.task_id("language", "repo", "name")).withColumn("cache_id", text.cache_id("language", "repo", "name", F.lit(context_size), "position_ratio", clean_mode))
    return with_prompt(out)


def with_prompt(tasks: DataFrame) -> DataFrame:
    """tasks with the prompt that their own template asks for."""
    return tasks.withColumn("prompt", text.prompt("template", {k: k for k in ("instruction", "code_context", "description")}))


def orphans(outputs: DataFrame, needles: DataFrame) -> DataFrame:
    """(language, repo) of outputs whose repository the dataset does not have."""
    return outputs.select("language", "repo").distinct().join(needles.select("language", "repo").distinct(), ["language", "repo"], "left_anti")


def evaluate(tasks: DataFrame, make: Callable[[], Provider], done: DataFrame | None = None, max_new_tokens: int = 1024, system_message: str | None = None) -> DataFrame:
    """Outputs of all tasks: those done already and the provider's replies to the others."""
    todo = with_prompt(tasks if done is None else unfinished(tasks, done))
    new = run_provider(todo, make, max_new_tokens, system_message)
    return new if done is None else done.unionByName(new, allowMissingColumns=True)


def score_all(outputs: DataFrame, needles: DataFrame, files: DataFrame, ignore_comments: bool = False, use_functions: bool = True) -> tuple[DataFrame, DataFrame]:
    """(evaluation rows, pass rates by scope). Needle code is whole lines of its file. ignore_comments compares without comments on both sides."""
    lost = orphans(outputs, needles).limit(5).collect()
    if lost:
        raise ValueError(f"outputs of repositories that are not in the dataset: {[tuple(r) for r in lost]}")
    code = needles.join(files.select("language", "repo", "path", "content"), ["language", "repo", "path"]).withColumn("code", text.line_slice("content", "start_line", "end_line")).drop("content")
    outs = outputs
    if use_functions:
        first = F.pandas_udf(lambda b, x: b.combine(x, lambda t, lang: next((f for k in (t if t is not None else []) if (f := syntax.first_function(k, lang))), None)), "string")
        blocks = text.fences(F.get("output", F.lit(0)))
        picked = first(blocks, F.col("language"))
        outs = outs.withColumn("output", F.when(picked.isNotNull(), F.array(F.concat(F.lit(text.FENCE + "\n"), picked, F.lit("\n" + text.FENCE)))).otherwise(F.col("output")))
    if ignore_comments:
        code = code.withColumn("code", syntax.without_comments("code", "language"))
        outs = outs.withColumn("output", F.array(syntax.without_comments(F.get("output", F.lit(0)), "language")))
    rows = score.score_outputs(outs, code)
    grid = score.threshold_grid(rows.select(F.col("language").alias("scope"), F.col("is_best_similar").alias("ok"), F.col("best_similar_score").alias("sim")))
    return rows, score.pass_by_scope(grid)


def dependency_lists(files: DataFrame, language: str) -> DataFrame:
    """deps (language, repo, src_ord, src, dst) of one language's files (language, repo, file_ord, path, content)."""
    own = files.where(F.col("language") == language)
    lists = deps.with_empty(own, deps.EDGES[language](own))
    return lists.join(own.select("repo", F.col("path").alias("src"), F.col("file_ord").alias("src_ord")), ["repo", "src"]).withColumn("language", F.lit(language))


def analyse_functions(files: DataFrame) -> DataFrame:
    """functions of files (language, repo, path, topo_idx, content) with global spans and comment_ratio."""
    rows = files.withColumn("f", F.explode(syntax.extract_functions("content", "language"))).select("language", "repo", "path", "topo_idx", "f.*", "content")
    body = F.decode(F.substring(F.encode("content", "UTF-8"), F.col("start_byte") + 1, F.col("end_byte") - F.col("start_byte")), "UTF-8")
    rows = rows.withColumn("comment_ratio", syntax.comment_ratio(body, "language")).withColumn("fn_ord", F.col("start_byte")).drop("content")
    return curate.with_global_spans(rows, files)


def annotation_requests(needles: DataFrame, files: DataFrame, prefix_lines: int = 100, span: int = 4096) -> DataFrame:
    """needles (language, repo, name, global_start_line, global_end_line) with prompt: a request to describe the function, shown after the prefix_lines
    lines before it. Lines count through all files (language, repo, path, file_idx, content) of the repository in order, so they may reach into the files before.

    Needles find their files by numbers only, by an equality join on stretches of span lines; then the files' texts are fetched, and only the lines wanted leave the tasks."""
    key = ["language", "repo"]
    ends = files.select(*key, "file_idx", F.size(F.split("content", "\n")).alias("lines"))
    base = sums_before(ends, key, "file_idx", {"first": "lines"}, orders=files).withColumn("end", F.col("first") + F.col("lines")).drop("lines")
    base = base.withColumn("stretch", F.explode(F.expr(f"sequence(first div {span}, (end - 1) div {span})")))
    low = F.greatest(F.lit(0), F.col("global_start_line") - prefix_lines).cast("long")
    wanted = needles.select(*key, F.col("name").alias("__hs_name"), F.col("global_start_line").cast("long").alias("__hs_start"), low.alias("low"), F.col("global_end_line").cast("long").alias("high")).distinct().where("high > low")
    spread = wanted.withColumn("stretch", F.explode(F.expr(f"sequence(low div {span}, (high - 1) div {span})")))
    near = spread.join(base, [*key, "stretch"]).where(F.expr(f"end > low and first < high and stretch = greatest(low div {span}, first div {span})")).drop("stretch")
    part = text.line_slice("content", F.greatest(F.lit(0), F.col("low") - F.col("first")).cast("int"), (F.least("high", "end") - F.col("first")).cast("int"))
    rows = near.join(files.select(*key, "file_idx", "content"), [*key, "file_idx"]).select(*key, "__hs_name", "__hs_start", "high", "file_idx", part.alias("t"))
    code = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_idx", "t"))), lambda x: x["t"]), "\n")  # of the wanted lines only
    found = rows.groupBy(*key, "__hs_name", "__hs_start", "high").agg(code.alias("__hs_code"))
    found = found.select(*[F.col(k).alias(f"__hs_{k}") for k in key], "__hs_name", "__hs_start", F.col("high").alias("__hs_end"), "__hs_code")
    same = [F.col(k).eqNullSafe(F.col(f"__hs_{k}")) for k in [*key, "name"]] + [F.col("global_start_line") == F.col("__hs_start"), F.col("global_end_line") == F.col("__hs_end")]
    return needles.join(found, same).withColumn("prompt", text.annotation_prompt("name", "__hs_code")).select(*needles.columns, "prompt")


def annotate(needles: DataFrame, files: DataFrame, make: Callable[[], Provider], done: DataFrame | None = None) -> DataFrame:
    """Annotations (repo, name, prompt, raw_annotation, annotation) of the needles that done has none of, with the settings that annotation asks with."""
    todo = needles if done is None else unfinished(needles, done, ["repo", "name"])
    # The length and the temperature of an annotation.
    replies = run_provider(annotation_requests(todo, files), make, max_tokens=2048, temperature=0.2)
    return parse_annotations(replies).select("repo", "name", "prompt", "raw_annotation", "annotation")


def parse_annotations(replies: DataFrame) -> DataFrame:
    """replies (output) with raw_annotation and annotation."""
    raw = F.get("output", F.lit(0))
    return replies.withColumn("raw_annotation", raw).withColumn("annotation", text.between(raw, "<desc_start>", "<desc_end>"))


def token_stats(files: DataFrame, count=context.space_tokens) -> DataFrame:
    """language, repo, tokens of each repository's files as one text, with a path comment each, in the order of their paths. Files are counted where they are and only numbers meet.

    White-space tokens are exact: a file that ends in a token joins the next one's first. Other counters' tokens are the sum over the files, each with its comment."""
    piece = text.big_file(F.array(F.struct("path", "content")), context._sign())
    joins = F.lit(count is context.space_tokens) & F.right(piece, F.lit(1)).rlike(r"\S")
    rows = files.select("language", "repo", "path", count(piece).cast("long").alias("n"), joins.cast("int").alias("joins"))
    one = rows.groupBy("language", "repo").agg(F.sum("n").alias("n"), F.sum("joins").alias("joins"), F.count(F.lit(1)).alias("files"), F.max_by("joins", "path").alias("last"))
    whole = F.col("n") - F.col("joins") + F.col("last") - (F.col("files") - 1) if count is context.space_tokens else F.col("n")
    return one.select("language", "repo", whole.cast("int").alias("tokens"))


def obfuscate_files(files: DataFrame) -> DataFrame:
    return files.withColumn("content", syntax.obfuscated("content", "language"))
