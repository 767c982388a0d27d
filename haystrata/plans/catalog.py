"""Registered queries of the retrieval-evaluation operators, each with its SQL.

The tables hold no source code, so roles are mapped: language and repository are documents.lang and documents.source, a file is
a document in doc_id order, a line's cost is its white-space tokens and one, a needle is a benchmark item, and the items of
a repository are those whose item_id mod 20 is the number of its source.
"""

from __future__ import annotations

import functools

from pyspark.sql import Window
from pyspark.sql import functions as F

from haystrata.functions import syntax, text, tokens
from haystrata.functions.bleu import similarity
from haystrata.functions.provider import Echo, run_provider
from haystrata.operators import context, curate, deps, graph, score
from haystrata.plans import evaluate
from haystrata.sources import readers, sinks
from haystrata.streaming import replies, resume

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c, alias=None):
    return F.round(c, 6).alias(alias or c)


# --- scoring ---

_KEYED = """
a AS (SELECT doc_id AS rid, lang, source AS k, string_split_regex(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
b AS (SELECT item_id AS nid, 'src' || (item_id % 20) AS k, string_split_regex(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[ \\t\\n\\x0B\\f\\r]+') AS w FROM benchmark),
ns AS (SELECT unnest([1, 2, 3, 4]) AS n),
ag AS (SELECT rid, k, n, len(w) AS h, unnest(list_transform(range(1, greatest(len(w) - n + 2, 1)), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM a, ns),
bg AS (SELECT nid, k, n, len(w) AS r, unnest(list_transform(range(1, greatest(len(w) - n + 2, 1)), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM b, ns),
ac AS (SELECT rid, k, h, n, g, count(*) AS c FROM ag GROUP BY ALL),
bc AS (SELECT nid, k, r, n, g, count(*) AS c FROM bg GROUP BY ALL),
m AS (SELECT rid, nid, h, r, sum(CASE WHEN n = 1 THEN least(ac.c, bc.c) ELSE 0 END) AS m1, sum(CASE WHEN n = 2 THEN least(ac.c, bc.c) ELSE 0 END) AS m2, sum(CASE WHEN n = 3 THEN least(ac.c, bc.c) ELSE 0 END) AS m3, sum(CASE WHEN n = 4 THEN least(ac.c, bc.c) ELSE 0 END) AS m4
  FROM ac JOIN bc USING (k, n, g) GROUP BY rid, nid, h, r),
p AS (SELECT *, ln(h::DOUBLE) / 5 AS s, 1 AS e2, 1 + (m2 = 0)::INT AS e3, 1 + (m2 = 0)::INT + (m3 = 0)::INT AS e4 FROM m),
q AS (SELECT *, m1 / h::DOUBLE AS p1, CASE WHEN m2 > 0 THEN m2 / greatest(1, h - 1)::DOUBLE WHEN h > 1 THEN s / pow(2, e2) / greatest(1, h - 1) ELSE 0 END AS p2,
  CASE WHEN m3 > 0 THEN m3 / greatest(1, h - 2)::DOUBLE WHEN h > 1 THEN s / pow(2, e3) / greatest(1, h - 2) ELSE 0 END AS p3,
  CASE WHEN m4 > 0 THEN m4 / greatest(1, h - 3)::DOUBLE WHEN h > 1 THEN s / pow(2, e4) / greatest(1, h - 3) ELSE 0 END AS p4 FROM p),
pairs AS (SELECT rid, nid, CASE WHEN m1 = 0 THEN 0 ELSE (CASE WHEN h > r THEN 1 ELSE exp(1 - r / h::DOUBLE) END) * exp(0.25 * (CASE WHEN p1 > 0 THEN ln(p1) ELSE 0 END + CASE WHEN p2 > 0 THEN ln(p2) ELSE 0 END + CASE WHEN p3 > 0 THEN ln(p3) ELSE 0 END + CASE WHEN p4 > 0 THEN ln(p4) ELSE 0 END)) END AS sim FROM q)"""
_BEST = (
    _KEYED
    + """,
top AS (SELECT rid, nid, sim FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY round(sim, 9) DESC, nid) AS i FROM pairs WHERE sim > 0) WHERE i = 1),
best AS (SELECT rid, lang, nid AS best_nid, coalesce(sim, 0.0) AS best_sim FROM a LEFT JOIN top USING (rid))"""
)
_GRID = _BEST + ",\ngrid AS (SELECT lang AS scope, th / 10.0::DOUBLE AS threshold, best_nid IS NOT NULL AND round(best_sim, 9) >= th / 10.0::DOUBLE AS passed FROM best, (SELECT unnest(range(0, 11)) AS th))"
_SCORES = _GRID + ",\nscores AS (SELECT scope, threshold, count(*) AS n, avg(passed::INT::DOUBLE) AS pass_at_1 FROM grid GROUP BY scope, threshold UNION ALL SELECT 'all', threshold, count(*), avg(passed::INT::DOUBLE) FROM grid GROUP BY threshold)"


def _pairs(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("rid"), F.col("source").alias("key"), "text")
    items = t(spark, d, "benchmark").select(F.col("item_id").alias("nid"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("key"), "text")
    return similarity(docs, items).withColumn("sim", F.round("sim", 9))


def _best(spark, d):
    return score.best_match(t(spark, d, "documents").select(F.col("doc_id").alias("rid"), "lang"), _pairs(spark, d))


def _scores(spark, d):
    rows = _best(spark, d).select(F.col("lang").alias("scope"), F.col("best_nid").isNotNull().alias("ok"), F.col("best_sim").alias("sim"))
    return score.pass_by_scope(score.threshold_grid(rows))


@query(f"WITH {_KEYED} SELECT rid, nid, round(sim, 6) AS sim FROM pairs")
def q01_bleu_pairs(spark, d):
    return _pairs(spark, d).select("rid", "nid", _r("sim"))


@query(f"WITH {_BEST} SELECT rid, coalesce(best_nid, -1) AS best_nid, round(best_sim, 6) AS best_sim FROM best")
def q02_best_match(spark, d):
    return _best(spark, d).select("rid", F.coalesce("best_nid", F.lit(-1)).alias("best_nid"), _r("best_sim"))


@query(f"WITH {_GRID} SELECT scope, threshold, sum(passed::INT)::BIGINT AS n_passed, count(*) AS n FROM grid GROUP BY scope, threshold")
def q03_threshold_grid(spark, d):
    rows = _best(spark, d).select(F.col("lang").alias("scope"), F.col("best_nid").isNotNull().alias("ok"), F.col("best_sim").alias("sim"))
    return score.threshold_grid(rows).groupBy("scope", "threshold").agg(F.count_if("passed").alias("n_passed"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_SCORES} SELECT scope, threshold, n, round(pass_at_1, 6) AS pass_at_1 FROM scores")
def q04_pass_at_1_by_scope(spark, d):
    return _scores(spark, d).select("scope", "threshold", "n", _r("pass_at_1"))


@query("""WITH x AS (SELECT lang, count(*) AS n, sum(quality) AS c FROM documents JOIN labels USING (doc_id) GROUP BY lang), k AS (SELECT unnest([1, 10, 100]) AS k)
SELECT lang, k::INT AS k, n, c::BIGINT AS c, round(CASE WHEN n - c < k THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 1 - exp(list_sum(list_transform(range((n - c + 1)::BIGINT, n + 1), lambda i: ln(1 - k / i::DOUBLE)))) END, 6) AS pass_at_k FROM x, k WHERE n >= k""")
def q05_pass_at_k(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "lang").join(t(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("c"))
    rows = rows.withColumn("k", F.explode(F.array(F.lit(1), F.lit(10), F.lit(100)))).where("n >= k")
    return rows.select("lang", "k", "n", "c", F.round(text.pass_at_k("n", "c", "k"), 6).alias("pass_at_k"))


@query(f"WITH {_SCORES} SELECT scope, " + ", ".join(f"round(max(CASE WHEN round(threshold * 10) = {i} THEN pass_at_1 END), 6) AS t{i:02d}" for i in range(11)) + " FROM scores GROUP BY scope")
def q06_score_pivot(spark, d):
    return score.pivot_scores(_scores(spark, d).withColumn("pass_at_1", F.round("pass_at_1", 6)))


@query(f"""WITH {_SCORES}, e AS (SELECT scope, threshold, pass_at_1, max(pass_at_1) OVER w AS hi, min(pass_at_1) OVER w AS lo FROM scores WHERE scope <> 'all' WINDOW w AS (PARTITION BY threshold))
SELECT scope, threshold, round(pass_at_1, 6) AS pass_at_1, abs(pass_at_1 - hi) < 0.01 AS is_max, NOT abs(pass_at_1 - hi) < 0.01 AND abs(pass_at_1 - lo) < 0.01 AS is_min FROM e""")
def q07_extremes_flag(spark, d):
    return score.extremes(_scores(spark, d)).withColumn("pass_at_1", F.round("pass_at_1", 6))


# --- budgets and contexts ---

_LINES = "lines AS (SELECT doc_id, i AS line_no, string_split(text, chr(10))[i + 1] AS line FROM (SELECT doc_id, text, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)), cost AS (SELECT *, len(regexp_extract_all(line, '[^ \\t\\n\\x0B\\f\\r]+')) + 1 AS n_tok FROM lines)"


def _lines(spark, d):
    rows = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.select("doc_id", "line_no", context.space_tokens(F.col("line")).alias("n_tok"))


@query(f"WITH {_LINES}, r AS (SELECT *, sum(n_tok) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM cost) SELECT doc_id, line_no::BIGINT AS line_no, run::BIGINT AS run FROM r WHERE run <= 100")
def q08_line_budget_forward(spark, d):
    return context.budget_lines(_lines(spark, d), ["doc_id"], 100).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("run").cast("long").alias("run"))


@query(f"WITH {_LINES}, r AS (SELECT *, sum(n_tok) OVER (PARTITION BY doc_id ORDER BY line_no DESC) AS run FROM cost) SELECT doc_id, line_no::BIGINT AS line_no, run::BIGINT AS run FROM r WHERE run <= 100")
def q09_line_budget_backward(spark, d):
    return context.budget_lines(_lines(spark, d), ["doc_id"], 100, backward=True).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("run").cast("long").alias("run"))


_FILE_SQL = """WITH f AS (SELECT lang, source, doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) + 1 AS n_tok FROM documents),
r AS (SELECT *, 5000 - coalesce(sum(n_tok) OVER (PARTITION BY lang, source ORDER BY doc_id {} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM f)
SELECT doc_id, l::BIGINT AS tokens_left, n_tok <= l AS whole FROM r WHERE l > 0"""


def _file_budget(spark, d, backward):
    docs = t(spark, d, "documents")
    rows = t(spark, d, "documents").select("lang", "source", "doc_id", context.space_tokens(F.col("text")).alias("n_tok"))
    return context.file_budget(rows, ["lang", "source"], F.lit(5000), "doc_id", backward, docs).select("doc_id", F.col("left").cast("long").alias("tokens_left"), "whole")


@query(_FILE_SQL.format("DESC"))
def q10_file_budget_prefix(spark, d):
    return _file_budget(spark, d, True)


@query(_FILE_SQL.format(""))
def q11_file_budget_suffix(spark, d):
    return _file_budget(spark, d, False)


def _tok(x):
    return f"(len(regexp_extract_all({x}, '[^ \\t\\n\\x0B\\f\\r]+')) + 1)"


#: A needle a repository: all of the middle document but its first tenth and last half, in a context of 2,000 tokens at ratio 0.5.
_CONTEXT_SQL = f"""
WITH d AS (SELECT lang, source, doc_id, text, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY lang, source) AS k FROM documents),
f AS (SELECT lang, source, doc_id, list_concat(['# Path: ' || doc_id], string_split(text, chr(10))) AS rows FROM documents),
c AS (SELECT *, list_sum(list_transform(rows, lambda x: {_tok("x")})) AS n FROM f),
own AS (SELECT lang, source, doc_id, text, length(text) // 10 AS a, length(text) // 2 AS b FROM d WHERE i = (k + 1) // 2),
nd AS (SELECT *, substring(text, a + 1, b - a) AS needle, list_concat(['# Path: ' || doc_id], string_split(substring(text, 1, a), chr(10))) AS up, string_split(substring(text, b + 1), chr(10)) AS down FROM own),
bg AS (SELECT *, trunc(2000 * 0.5 - {_tok("needle")} / 2.0)::BIGINT AS pre, 2000 - {_tok("needle")} - trunc(2000 * 0.5 - {_tok("needle")} / 2.0)::BIGINT AS suf FROM nd),
ul AS (SELECT lang, source, pre, j, up[j] AS line, sum({_tok("up[j]")}) OVER (PARTITION BY lang, source ORDER BY j DESC) AS run FROM (SELECT *, unnest(range(1, len(up) + 1)) AS j FROM bg)),
u AS (SELECT lang, source, max(run) AS used, coalesce(string_agg(line || chr(10), '' ORDER BY j) FILTER (run <= pre), '') AS part FROM ul GROUP BY lang, source),
dl AS (SELECT lang, source, suf, j, down[j] AS line, sum({_tok("down[j]")}) OVER (PARTITION BY lang, source ORDER BY j) AS run FROM (SELECT *, unnest(range(1, len(down) + 1)) AS j FROM bg)),
w AS (SELECT lang, source, max(run) AS used, coalesce(string_agg(line || chr(10), '' ORDER BY j) FILTER (run <= suf), '') || CASE WHEN max(run) > any_value(suf) THEN '...' || chr(10) ELSE '' END AS part FROM dl GROUP BY lang, source),
pf AS (SELECT c.lang, c.source, c.doc_id, c.rows, c.n, bg.pre - u.used - coalesce(sum(c.n) OVER (PARTITION BY c.lang, c.source ORDER BY c.doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM c JOIN bg ON c.lang = bg.lang AND c.source = bg.source AND c.doc_id < bg.doc_id JOIN u ON u.lang = c.lang AND u.source = c.source),
sf AS (SELECT c.lang, c.source, c.doc_id, c.rows, c.n, bg.suf - w.used - coalesce(sum(c.n) OVER (PARTITION BY c.lang, c.source ORDER BY c.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM c JOIN bg ON c.lang = bg.lang AND c.source = bg.source AND c.doc_id > bg.doc_id JOIN w ON w.lang = c.lang AND w.source = c.source),
v AS (SELECT 'p' AS side, * FROM pf WHERE l > 0 UNION ALL SELECT 's', * FROM sf WHERE l > 0),
vl AS (SELECT side, lang, source, doc_id, l, n, j, rows[j] AS line, sum({_tok("rows[j]")}) OVER (PARTITION BY side, lang, source, doc_id ORDER BY j) AS run FROM (SELECT *, unnest(range(1, len(rows) + 1)) AS j FROM v)),
vp AS (SELECT side, lang, source, doc_id, coalesce(string_agg(line || chr(10), '' ORDER BY j) FILTER (run <= l), '') || CASE WHEN max(run) > any_value(l) THEN '...' || chr(10) ELSE '' END AS part FROM vl GROUP BY side, lang, source, doc_id),
vs AS (SELECT side, lang, source, string_agg(part, '' ORDER BY doc_id) AS part FROM vp GROUP BY side, lang, source),
j AS (SELECT bg.lang, bg.source, bg.doc_id, coalesce(x.part, '') || u.part AS prefix, needle, w.part || coalesce(y.part, '') AS suffix FROM bg JOIN u USING (lang, source) JOIN w USING (lang, source) LEFT JOIN vs x ON x.side = 'p' AND x.lang = bg.lang AND x.source = bg.source LEFT JOIN vs y ON y.side = 's' AND y.lang = bg.lang AND y.source = bg.source)
SELECT lang AS language, source AS repo, doc_id::VARCHAR AS path, md5(prefix || needle || suffix) AS context_md5, {_tok("prefix")}::INT AS needle_token_start, ({_tok("prefix")} + {_tok("needle")})::INT AS needle_token_end, ({_tok("prefix")} + {_tok("needle")} + {_tok("suffix")})::INT AS code_context_ntokens FROM j"""


@query(_CONTEXT_SQL)
def q12_context_text(spark, d):
    got = _middle_needles(_documents(spark, d), 2000, context.space_tokens)
    return got.select("language", "repo", "path", F.md5("code_context").alias("context_md5"), "needle_token_start", "needle_token_end", "code_context_ntokens")


def _documents(spark, d):
    return t(spark, d, "documents").select(F.col("lang").alias("language"), F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("path"), F.col("doc_id").alias("file_idx"), F.col("text").alias("content"))


def _middle_needles(docs, size, count, costs=None):
    w = Window.partitionBy("language", "repo")
    place = docs.select("language", "repo", "path", "file_idx", F.length("content").alias("n")).withColumn("i", F.row_number().over(w.orderBy("file_idx"))).withColumn("k", F.count(F.lit(1)).over(w))
    needles = place.where("i = (k + 1) div 2").select("language", "repo", "path", F.lit("needle").alias("name"), F.expr("n div 10").cast("int").alias("start_byte"), F.expr("n div 2").cast("int").alias("end_byte"), F.lit(2).alias("needle_ord"), F.lit(5).alias("n_needles"))
    return context.make_context(needles, docs, size, count, offset_mode="chars", costs=costs)


_NEEDLES = "n AS (SELECT item_id, text, 'src' || (item_id % 20) AS repo, row_number() OVER (PARTITION BY item_id % 20 ORDER BY item_id) - 1 AS needle_ord, count(*) OVER (PARTITION BY item_id % 20) AS n_needles FROM benchmark)"


def _needles(spark, d):
    w = Window.partitionBy("repo")
    rows = t(spark, d, "benchmark").withColumn("repo", F.concat(F.lit("src"), F.col("item_id") % 20))
    return rows.withColumn("needle_ord", F.row_number().over(w.orderBy("item_id")) - 1).withColumn("n_needles", F.count(F.lit(1)).over(w)).withColumn("position_ratio", text.position_ratio("needle_ord", "n_needles"))


@query(f"WITH {_NEEDLES} SELECT item_id, needle_ord::INT AS needle_ord, n_needles, round((needle_ord + 0.5::DOUBLE) / n_needles, 9) AS position_ratio FROM n")
def q13_position_ratio(spark, d):
    return _needles(spark, d).select("item_id", "needle_ord", "n_needles", F.round("position_ratio", 9).alias("position_ratio"))


@query(f"""WITH {_NEEDLES}, c AS (SELECT item_id, (needle_ord + 0.5::DOUBLE) / n_needles AS r, len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) + 1 AS n FROM n)
SELECT item_id, trunc(16384 * r - n / 2.0::DOUBLE)::INT AS prefix_budget, (16384 - n - trunc(16384 * r - n / 2.0::DOUBLE))::INT AS suffix_budget FROM c""")
def q14_budget_split(spark, d):
    rows = _needles(spark, d).withColumn("n", context.space_tokens(F.col("text")))
    pre = text.prefix_budget(F.lit(16384), "position_ratio", "n")
    return rows.select("item_id", pre.alias("prefix_budget"), (F.lit(16384) - F.col("n") - pre).alias("suffix_budget"))


@query("SELECT conv_id, turn, md5('Find:' || text || chr(10) || 'Function Description:' || role || chr(10) || 'Find:') AS prompt_md5 FROM conversations")
def q15_prompt_concat(spark, d):
    rows = t(spark, d, "conversations").select("conv_id", "turn", F.lit("Find:").alias("instruction"), F.col("text").alias("code_context"), text.description_block("role").alias("description"), F.lit(evaluate.TEMPLATE).alias("template"))
    return evaluate.with_prompt(rows).select("conv_id", "turn", F.md5("prompt").alias("prompt_md5"))


@query("SELECT doc_id, lang || '::' || source || '::' || doc_id AS task_id, lang || '::' || source || '::' || doc_id || '::16384::0.25::none' AS cache_id FROM documents")
def q16_ids(spark, d):
    name = F.col("doc_id").cast("string")
    return t(spark, d, "documents").select("doc_id", text.task_id("lang", "source", name).alias("task_id"), text.cache_id("lang", "source", name, F.lit(16384), F.lit(0.25), "none").alias("cache_id"))


# --- curation ---

_FN = "fn AS (SELECT doc_id, lang AS language, source AS repo, line AS name, line_no, strlen(line) AS n FROM (SELECT doc_id, lang, source, unnest(range(0, len(string_split(text, chr(10))))) AS line_no, string_split(text, chr(10)) AS l FROM documents), LATERAL (SELECT l[line_no + 1] AS line) WHERE line <> '')"


def _functions(spark, d):
    """Lines as functions: the line is the name, its bytes the size, the document the file."""
    rows = t(spark, d, "documents").select(F.col("lang").alias("language"), F.col("source").alias("repo"), F.col("doc_id").alias("topo_idx"), F.posexplode(F.split("text", "\n")).alias("fn_ord", "name"))
    return rows.where("name <> ''").withColumn("n", F.octet_length("name")).withColumn("path", F.col("topo_idx").cast("string"))


@query(f"WITH {_FN}, o AS (SELECT language, repo, name FROM fn GROUP BY ALL HAVING count(*) = 1) SELECT language, repo, count(*) AS n_unique, sum(n)::BIGINT AS bytes FROM fn JOIN o USING (language, repo, name) GROUP BY language, repo")
def q17_unique_names(spark, d):
    return curate.unique_names(_functions(spark, d)).groupBy("language", "repo").agg(F.count(F.lit(1)).alias("n_unique"), F.sum("n").alias("bytes"))


_BINS = f"""{_FN}, o AS (SELECT language, repo, name FROM fn GROUP BY ALL HAVING count(*) = 1),
base AS (SELECT doc_id, lang AS language, source AS repo, coalesce(sum(length(text)) OVER (PARTITION BY lang, source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(length(text)) OVER (PARTITION BY lang, source) AS total FROM documents),
e AS (SELECT fn.*, ((before + line_no) // greatest(1, total // 64)) AS bin FROM fn JOIN o USING (language, repo, name) JOIN base USING (doc_id, language, repo) WHERE n <= 2000),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY language, repo, bin ORDER BY doc_id, line_no) AS i FROM e) WHERE i = 1)"""


def _bins(spark, d):
    docs = t(spark, d, "documents").select(F.col("lang").alias("language"), F.col("source").alias("repo"), F.col("doc_id").alias("topo_idx"), F.col("text").alias("content"))
    base = curate.global_offsets(docs).select("language", "repo", "topo_idx", "chars_before")
    fns = curate.unique_names(_functions(spark, d)).where("n <= 2000").join(base, ["language", "repo", "topo_idx"]).withColumn("global_start_byte", F.col("chars_before") + F.col("fn_ord"))
    return curate.bin_first(fns, curate.repo_sizes(docs))


@query(f"WITH {_BINS} SELECT language, repo, bin::BIGINT AS bin, doc_id, line_no::INT AS line_no FROM picked")
def q18_needle_bins(spark, d):
    return _bins(spark, d).select("language", "repo", "bin", F.col("topo_idx").alias("doc_id"), F.col("fn_ord").alias("line_no"))


@query(f"""WITH {_BINS} SELECT language, repo, doc_id, line_no::INT AS line_no, (i2 - 1)::INT AS needle_ord FROM (SELECT *, row_number() OVER (PARTITION BY language, repo ORDER BY md5('0/' || doc_id || '/' || name), doc_id::VARCHAR, name) AS i2 FROM picked) WHERE i2 <= 10""")
def q19_needle_sample(spark, d):
    got = curate.sample_per_repo(_bins(spark, d), 10)
    return got.select("language", "repo", F.col("topo_idx").alias("doc_id"), F.col("fn_ord").alias("line_no"), "needle_ord")


@query("SELECT doc_id, coalesce(sum(length(text)) OVER w, 0)::BIGINT AS chars_before, coalesce(sum(len(string_split(text, chr(10)))) OVER w, 0)::BIGINT AS lines_before FROM documents WINDOW w AS (PARTITION BY lang, source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def q20_global_offsets(spark, d):
    docs = t(spark, d, "documents").select(F.col("lang").alias("language"), F.col("source").alias("repo"), F.col("doc_id").alias("topo_idx"), F.col("text").alias("content"))
    return curate.global_offsets(docs).select(F.col("topo_idx").alias("doc_id"), "chars_before", "lines_before")


@query("SELECT lang AS language, source AS repo, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY lang, source")
def q21_repo_sizes(spark, d):
    return curate.repo_sizes(t(spark, d, "documents").select(F.col("lang").alias("language"), F.col("source").alias("repo"), F.col("text").alias("content")))


@query("SELECT doc_id, n::BIGINT AS n_tok FROM (SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) + 1 AS n FROM documents) ORDER BY n, doc_id DESC LIMIT 1")
def q22_token_min_argmin(spark, d):
    rows = t(spark, d, "documents").select("doc_id", context.space_tokens(F.col("text")).cast("long").alias("n_tok"))
    return curate.smallest_last(rows, "n_tok", "doc_id")


@query("WITH r AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents) SELECT least(64, (n_chars - lo) * 64 // (hi - lo) + 1)::INT AS bin, count(*) AS n FROM documents, r GROUP BY 1")
def q23_token_histogram(spark, d):
    return curate.histogram(t(spark, d, "documents").select("n_chars"), "n_chars")


@query("SELECT source AS repo, count(*) AS n, count(DISTINCT x.c) AS n_dep FROM documents LEFT JOIN (SELECT 'src' || (item_id % 15) AS source, count(*) AS c FROM benchmark GROUP BY 1) x USING (source) GROUP BY source")
def q24_merge_left_default(spark, d):
    repos = t(spark, d, "documents").select(F.col("source").alias("repo"), "doc_id")
    dep = t(spark, d, "benchmark").groupBy(F.concat(F.lit("src"), F.col("item_id") % 15).alias("repo")).agg(F.count(F.lit(1)).alias("dependency"))
    return curate.merge_dependency(repos, dep).groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dependency").alias("n_dep"))


@query("SELECT u.user_id, e.event_id AS last_event FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events WHERE event_type = 'click') WHERE i = 1) e ON u.user_id = e.user_id")
def q25_merge_last_wins(spark, d):
    events = t(spark, d, "events")
    lines = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("last_event"), F.struct("ts", "event_id").alias("o"))
    return curate.merge_last(events.select("user_id").distinct(), lines, ["user_id"], "last_event", "o")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 250000)")
def q26_resume_anti(spark, d):
    done = t(spark, d, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return resume.unfinished(t(spark, d, "customer").select("c_custkey"), done, ["c_custkey"])


@query("SELECT o_orderkey AS k, round(o_totalprice, 2) AS v, 'cache' AS origin FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 0.0, 'new' FROM orders WHERE o_orderstatus <> 'F'")
def q27_cache_semi_union(spark, d):
    orders = t(spark, d, "orders")
    cache = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.round("o_totalprice", 2).alias("v"), F.lit("cache").alias("origin"))
    return resume.cached_or_new(orders.select(F.col("o_orderkey").alias("k")), cache, lambda x: x.select("k", F.lit(0.0).alias("v"), F.lit("new").alias("origin")), "k")


def _subwords():
    """A public byte-level tokenizer; the package gives its files' places."""
    import public_tokenizers

    return tokens.SubwordCounter(public_tokenizers.path("byte_bpe_50k.json"))


@query()
def q53_subword_contexts(spark, d):
    """The budget of 512 subword tokens of every document's lines from the top, and the needle contexts of q12 in subword tokens. SQL has no such tokenizer; tests hold both against loops."""
    count = _subwords()
    files = _documents(spark, d)
    lines = sinks.written(context.line_costs(files, count))  # each line is counted once
    kept = context.budget_lines(lines.where("line_no > 0"), ["file_idx"], 512).groupBy(F.col("file_idx").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_lines"), F.max("run").alias("n_tokens"))
    got = _middle_needles(files, 2000, count, sinks.written(context.file_costs(files, count, lines)))
    cut = got.select(F.col("path").cast("long").alias("doc_id"), F.md5("code_context").alias("context_md5"), "needle_token_start", "needle_token_end", "code_context_ntokens")
    return t(spark, d, "documents").select("doc_id").join(kept, "doc_id", "left").join(cut, "doc_id", "left")


# --- texts ---


@query("""WITH x AS (SELECT conv_id, turn, 'before' || chr(10) || '```py' || chr(10) || text || chr(10) || '```' || chr(10) || 'after' AS s FROM conversations)
SELECT conv_id, turn, len(b)::INT AS n_blocks, md5(b[1]) AS first_md5 FROM (SELECT conv_id, turn, regexp_extract_all(s, '(?sm)^```(?:[0-9A-Za-z_]+)?\\s*\\n(.*?)^```', 1) AS b FROM x)""")
def q28_fence_extract(spark, d):
    f = text.FENCE
    rows = t(spark, d, "conversations").select("conv_id", "turn", text.fences(F.concat(F.lit(f"before\n{f}py\n"), "text", F.lit(f"\n{f}\nafter"))).alias("b"))
    return rows.select("conv_id", "turn", F.size("b").alias("n_blocks"), F.md5(F.get("b", F.lit(0))).alias("first_md5"))


@query("SELECT conv_id, turn, md5(text) AS inside_md5 FROM conversations")
def q29_capture_extract(spark, d):
    rows = t(spark, d, "conversations")
    marked = F.concat(F.lit("head <desc_start> old <desc_start>"), "text", F.lit("<desc_end> tail <desc_end>"))
    return rows.select("conv_id", "turn", F.md5(text.between(marked, "<desc_start>", "<desc_end>")).alias("inside_md5"))


@query("SELECT doc_id, md5(array_to_string(string_split(text, chr(10))[2:4], chr(10))) AS slice_md5 FROM documents")
def q30_line_slice(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(text.line_slice("text", F.lit(1), F.lit(4))).alias("slice_md5"))


#: A function of two lines in each language, before and after its name.
_FUNCTION = {"python": ("def ", "():\n    return 1\n"), "java": ("int ", "() {\n    return 1; }\n"), "typescript": ("function ", "() {\n    return 1; }\n"), "rust": ("fn ", "() -> i32 {\n    1 }\n"), "cpp": ("int ", "() {\n    return 1; }\n"), "go": ("func ", "() int {\n    return 1 }\n")}


def _commented_code(doc_id, text):
    """language and code columns: every line of a whole text as a comment, then a function f<doc_id>."""
    names = list(_FUNCTION)
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(F.col(doc_id), F.lit(len(names))).cast("int") + 1)
    sign = pick(["# " if n == "python" else "// " for n in names])
    lines = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\r\x00\x0c]", " "), "\n", -1)
    code = F.concat(F.array_join(F.transform(lines, lambda x: F.concat(sign, x, F.lit("\n"))), ""), pick([a for a, _ in _FUNCTION.values()]), F.lit("f"), F.col(doc_id).cast("string"), pick([b for _, b in _FUNCTION.values()]))
    return pick(names).alias("language"), code.alias("code")


_PICK = lambda values: "[" + ", ".join("'" + v.replace("\n", "' || chr(10) || '") + "'" for v in values) + "][doc_id % 6 + 1]"
#: The parts of _commented_code: the text's lines, the sign, and the function.
_CODE_SQL = f"""code AS (SELECT doc_id, t, len(string_split(t, chr(10))) AS n, {_PICK(["# " if k == "python" else "// " for k in _FUNCTION])} AS sign, {_PICK([a for a, _ in _FUNCTION.values()])} || 'f' || doc_id || {_PICK([b for _, b in _FUNCTION.values()])} AS fn
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\r\\x00\\x0c]', ' ', 'g') AS t FROM documents))"""


def _code(spark, d):
    return t(spark, d, "documents").select("doc_id", *_commented_code("doc_id", "text"))


@query(f"WITH {_CODE_SQL} SELECT doc_id, md5(repeat(chr(10), n) || fn) AS bare_md5 FROM code")
def q31_comment_strip(spark, d):
    return _code(spark, d).select("doc_id", F.md5(syntax.without_comments("code", "language")).alias("bare_md5"))


@query(f"WITH {_CODE_SQL} SELECT doc_id, round((strlen(t) - (n - 1) + n * strlen(sign)) / (strlen(t) + 1 + n * strlen(sign) + strlen(fn))::DOUBLE, 9) AS comment_ratio FROM code")
def q32_comment_ratio(spark, d):
    return _code(spark, d).select("doc_id", F.round(syntax.comment_ratio("code", "language"), 9).alias("comment_ratio"))


#: A language's path of a document by turns, the ways in which its code names the document that follows it by turns, and what names others without being code. {} is an id, in the last ones two later.
_IMPORTS = {
    "python": (["p/m{}.py"], ["import p.m{}\n", "import os, p.m{} as x\n", "from p import m{}\n", "from . import m{}\n", "from .m{} import f\n", "from p.m{} import (a,  # one\n  b)\n", "import os; from p import q, \\\n  m{}\n"],
        '"""\nimport p.m{}\n"""\nx = "from p import m{}" # import p.m{}\n', "# "),
    "cpp": (["src/d{}.h"], ['#include "d{}.h"\n', "#include <src/d{}.h>\n", '# include "../src/d{}.h"\n', '  #include "./d{}.h" // own\n'], 'int x; /*\n#include "d{}.h"\n*/ // #include "d{}.h"\n', "// "),
    "java": (["src/a/C{}.java", "src/a/C{}.java", "src/a/C{}.java", "src/k{}/C{}.java"], ["import a.C{};\n", "class X {{ C{} y; }}\n", "import java.util.List; import k{}.*;\n", "import static a.C{}.run;\n"],
        '/* C{} */ String s = "a C{} b"; char c = \'"\'; // import a.C{};\n', "// "),
    "go": (["x/g{}.go"], ["func f() {{ g{}.Run() }}\n", "var v = g{} . T{{}}\n"], "var s = `g{}.Run()` + \"g{}.Run\" // g{}.Run()\n/* g{}.Run() */\n", "// "),
    "rust": (["src/r{}.rs"], ["use crate::r{}::f;\n", "use std::io; pub(crate) use crate::{{a, q::{{c, d as e}}, r{}::{{self, g as h, *}}, self}};\n", "use super::r{}::f;\n", "use self::super::r{}::{{x::y}};\n", "pub use crate::{{\n  r{} as z,\n}};\n"],
        'const S: &str = "use crate::r{}::f;"; /*\nuse crate::r{}::f;\n*/ // use crate::r{};\n', "// "),
    "typescript": (["s/t{}.ts"], ['import {{x}} from "./t{}";\n', 'const y = require("../s/t{}.js")\n', 'import z from "@/t{}"\n', 'export * from "s/t{}";\n', 'import "@only/{}.end"\n', 'const m = await import( "./t{}.ts" )\n'],
        '/* import {{x}} from "./t{}"; */ // require("./t{}")\n', "// "),
}
_TSCONFIG = '{ // aliases\n"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["none/*", "./s/*"], "@only/*.end": ["s/t*"], "@*": ["wrong/*"],}}}'


def _import_edges(spark, d, language):
    """Documents as source files of their language's repository: an import of the next id in one of the language's ways, names of others that are no code, and all lines of the whole text as comments."""
    paths, uses, decoy, sign = _IMPORTS[language]
    fill = lambda form, c: F.concat(*[x for i, part in enumerate(form.format(*["\0"] * form.count("{}")).split("\0")) for x in ([c] * (i > 0) + [F.lit(part)])])
    by_turns = lambda forms, c: F.get(F.array(*[fill(f, c.cast("string")) for f in forms]), F.pmod(F.col("doc_id"), F.lit(len(forms))).cast("int"))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.concat(F.lit(sign), x, F.lit("\n")))
    code = F.concat(by_turns(uses, F.col("doc_id") + 1), fill(decoy, (F.col("doc_id") + 2).cast("string")), F.array_join(lines, ""))
    files = t(spark, d, "documents").select(F.col("lang").alias("repo"), by_turns(paths, F.col("doc_id")).alias("path"), code.alias("content"))
    if language == "typescript":
        files = files.unionByName(t(spark, d, "documents").select(F.col("lang").alias("repo")).distinct().select("repo", F.lit("tsconfig.json").alias("path"), F.lit(_TSCONFIG).alias("content")))
    return deps.EDGES[language](files)


def _edge_sql(language):
    paths = _IMPORTS[language][0]
    path = lambda x: "CASE " + " ".join(f"WHEN {x}.doc_id % {len(paths)} = {k} THEN '{p.replace('{}', f"' || {x}.doc_id || '")}'" for k, p in enumerate(paths)) + " END"
    return f"SELECT DISTINCT a.lang AS repo, {path('a')} AS src, {path('b')} AS dst FROM documents a JOIN documents b ON a.lang = b.lang AND b.doc_id = a.doc_id + 1"


@query(_edge_sql("python"))
def q33_import_edges(spark, d):
    return _import_edges(spark, d, "python")


@query(_edge_sql("cpp"))
def q34_include_resolve(spark, d):
    return _import_edges(spark, d, "cpp")


@query(_edge_sql("java"))
def q43_java_edges(spark, d):
    return _import_edges(spark, d, "java")


@query(_edge_sql("go"))
def q44_go_edges(spark, d):
    return _import_edges(spark, d, "go")


@query(_edge_sql("rust"))
def q45_rust_edges(spark, d):
    return _import_edges(spark, d, "rust")


@query(_edge_sql("typescript"))
def q46_typescript_edges(spark, d):
    return _import_edges(spark, d, "typescript")


@query("SELECT c_custkey, array_to_string(list_transform(string_split(c_mktsegment || '_slash_' || c_name, '_'), lambda x: CASE WHEN x = 'slash' THEN '/' ELSE x END), '') AS model FROM customer")
def q35_model_name(spark, d):
    return t(spark, d, "customer").select("c_custkey", text.model_name(F.concat("c_mktsegment", F.lit("_slash_"), "c_name")).alias("model"))


@query("SELECT user_id, event_type, CASE event_type WHEN 'click' THEN '128k' WHEN 'view' THEN '16k' ELSE 'N/A' END AS train_size, count(*) AS n FROM events GROUP BY user_id, event_type")
def q36_train_context(spark, d):
    model = F.when(F.col("event_type") == "click", "gpt-4-turbo-1").when(F.col("event_type") == "view", "gpt-3.5-x").otherwise("other")
    return t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).select("user_id", "event_type", text.train_context(model).alias("train_size"), "n")


@query("""SELECT u.user_id FROM (SELECT DISTINCT user_id FROM events) u WHERE user_id >= 20
AND user_id IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY user_id HAVING count(*) >= 30)
AND user_id IN (SELECT user_id FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id HAVING sum(event_id % 1000) >= 12000)""")
def q37_commit_filter(spark, d):
    """A user is a repository with its number of stars, an event a commit and a file of its type."""
    events = t(spark, d, "events").withColumn("repo", F.col("user_id"))
    files = events.select("repo", F.concat(F.lit("f."), "event_type").alias("path"), (F.col("event_id") % 1000).alias("size"))
    repos = events.select("repo", F.col("repo").alias("stars")).distinct()
    return readers.crawl_filter(repos, events, files, "2024-01-15", 30, 12000, [".click", ".view"], 20).select(F.col("repo").alias("user_id"))


@query("""WITH RECURSIVE c AS (SELECT c_nationkey AS nation, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer),
up AS (SELECT nation, r AS v, r AS u FROM c UNION ALL SELECT nation, v, u // 2 FROM up WHERE u > 1),
m AS (SELECT nation, u, max(v) AS last FROM up GROUP BY nation, u)
SELECT m.nation, c.c_custkey::VARCHAR AS path, (row_number() OVER (PARTITION BY m.nation ORDER BY last DESC, u) - 1)::INT AS topo_idx FROM m JOIN c ON c.nation = m.nation AND c.r = m.u""")
def q38_topo_order(spark, d):
    """A nation's customers as a binary tree: the r-th depends on the (r div 2)-th and, against a cycle, the first on the last; the walk starts at the last."""
    w = Window.partitionBy("c_nationkey")
    rows = t(spark, d, "customer").select("c_nationkey", "c_custkey").withColumn("r", F.row_number().over(w.orderBy("c_custkey")))
    up = rows.select("c_nationkey", F.col("r").alias("half"), F.col("c_custkey").alias("before"))
    rows = rows.withColumn("half", F.expr("r div 2")).join(up, ["c_nationkey", "half"], "left")
    last = F.max("c_custkey").over(w)
    edges = rows.select(F.lit("l").alias("language"), F.col("c_nationkey").cast("string").alias("repo"), (-F.col("r")).alias("src_ord"), F.col("c_custkey").cast("string").alias("src"), F.array(F.coalesce("before", last).cast("string")).alias("dst"))
    return graph.topo_order(edges).select(F.col("repo").cast("int").alias("nation"), "path", "topo_idx")


#: By turns: a language, code with one function of a document's name and others that are nested or none of the language's function forms, how many functions it has, and how many lines the named one.
_FORMS = [
    ("python", "def f{}(x):\n    def g(y): return y\n    return g\n", 2, 3),
    ("java", "class A {\n  A() { x(); }\n  @B({1, 2}) Object f{}(int x) { return new C() { int g(int y) { return y; } }; }\n}\n", 2, 1),
    ("typescript", "const v = () => { x() }\nexport function f{}(a: {b: number}): {c: T} | {d: T} {\n  return a\n}\n", 1, 3),
    ("rust", "pub fn f{}<T: Into<u8>>(x: [u8; { 1 + 1 }]) -> u8 where T: Copy {\n  x\n}\n", 1, 3),
    ("cpp", "int* p() { return 0; }\nstruct S { int m() { return 1; } };\nvoid S::n() { x(); }\nint f{}(int x = g(1)) {\n  return x;\n}\n", 1, 3),
    ("go", "func (r R) m() { x() }\nfunc f{}(x interface{}) interface{} {\n  return x\n}\n", 1, 3),
]


@query(f"SELECT doc_id, {[x[2] for x in _FORMS]}[doc_id % 6 + 1] AS n_functions, 'f' || doc_id AS name, {[x[3] for x in _FORMS]}[doc_id % 6 + 1] AS n_lines FROM documents")
def q39_function_extract(spark, d):
    """All lines of each document's text as comments, then code in six languages by turns: the function that has the document's id as name, and how many there are."""
    turn = F.pmod(F.col("doc_id"), F.lit(len(_FORMS))).cast("int")
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), turn)
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\x00\x0c]", " "), "\n", -1)
    sign = pick(["# " if x[0] == "python" else "// " for x in _FORMS])
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    code = F.concat(F.array_join(F.transform(lines, lambda x: F.concat(sign, x, F.lit("\n"))), ""), F.replace(pick([x[1] for x in _FORMS]), F.lit("f{}"), name))
    rows = t(spark, d, "documents").select("doc_id", name.alias("wanted"), syntax.extract_functions(code, pick([x[0] for x in _FORMS])).alias("f"))
    one = F.get(F.filter("f", lambda x: x["name"] == F.col("wanted")), F.lit(0))
    return rows.select("doc_id", F.size("f").alias("n_functions"), one["name"].alias("name"), (one["end_line"] - one["start_line"]).alias("n_lines"))


@query("SELECT conv_id, turn, md5(text) AS reply_md5 FROM conversations")
def q40_provider_echo(spark, d):
    rows = t(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    return run_provider(rows, Echo).select("conv_id", "turn", F.md5(F.get("output", F.lit(0))).alias("reply_md5"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def q41_stream_resume(spark, d):
    """The resume stream over JSON lines that come in two deliveries, the second with all rows of the first again."""
    rows, folder = t(spark, d, "events").select("user_id", "event_type"), sinks.work_folder(spark)
    for part in (rows.where("user_id % 2 = 0"), rows):
        part.write.mode("append").json(f"{folder}/in")
        resume.append_results(spark, f"{folder}/in", "user_id long, event_type string", f"{folder}/out", f"{folder}/at", ["user_id", "event_type"])
    return spark.read.schema("user_id long, event_type string").parquet(f"{folder}/out")


@query("SELECT doc_id, md5(text) AS text_md5, n_chars FROM documents")
def q42_json_roundtrip(spark, d):
    """All documents as JSON lines, and read again with a schema."""
    folder = sinks.work_folder(spark)
    sinks.append_jsonl(t(spark, d, "documents").select("doc_id", "text", "n_chars"), f"{folder}/out.jsonl")
    rows = readers.read_jsonl(spark, f"{folder}/out.jsonl", "doc_id long, text string, n_chars long")
    return rows.select("doc_id", F.md5("text").alias("text_md5"), "n_chars")


class _Numbered:
    """Answers with the number of its run and the question."""

    def __init__(self, run: int):
        self.run = run

    def generate_reply(self, question, **_):
        return [f"{self.run}:{question}"]


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS run, md5(text) AS reply_md5 FROM documents")
def q52_reply_batches(spark, d):
    """Every document asked as a task by two runs over the same folders: the first has the even ones, the second all of them and so asks only the others."""
    rows = t(spark, d, "documents").select(F.col("lang").alias("language"), F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("name"), F.col("text").alias("prompt"))
    folder = sinks.work_folder(spark)
    for run, part in ((1, rows.where("cast(name as long) % 2 = 0")), (2, rows)):
        replies.ask_all(part, f"{folder}/run", f"{folder}/out", functools.partial(_Numbered, run), flush_tasks=4096, keep=["language", "repo", "name", "output"])
    reply = F.get("output", F.lit(0))
    got = readers.read_jsonl(spark, f"{folder}/out", "language string, repo string, name string, output array<string>")
    return got.select(F.col("name").cast("long").alias("doc_id"), F.substring_index(reply, ":", 1).cast("int").alias("run"), F.md5(F.substr(reply, F.lit(3))).alias("reply_md5"))


_ASK = "'Can you **briefly** describe the purpose, input, output, and procedure of \"' || role || '\"?'"


@query(f"""SELECT conv_id, turn, md5({_ASK} || chr(10) || chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10) || chr(10) || {_ASK} || chr(10) || chr(10) || 'Please follow format to complete the skeleton below:' || chr(10) || chr(10) || '<desc_start>' || chr(10)
|| '1. **Purpose**: ...' || chr(10) || '2. **Input**: ...' || chr(10) || '3. **Output**: ...' || chr(10) || '4. **Procedure**: ...' || chr(10) || '<desc_end>' || chr(10) || chr(10) || {_ASK} || chr(10) || chr(10) || 'Notes:' || chr(10)
|| '1. DO NOT reveal function names (' || role || ') and variable names' || chr(10) || '2. Start with <desc_start> and end with <desc_end>' || chr(10) || '3. Customize the description to differentiate it from other functions' || chr(10)) AS ask_md5 FROM conversations""")
def q47_annotation_prompt(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", F.md5(text.annotation_prompt("role", "text")).alias("ask_md5"))


@query(f"WITH {_CODE_SQL} SELECT doc_id, md5(fn) AS code_md5 FROM code")
def q48_sanitized_reply(spark, d):
    """A reply of prose, a fenced block without a function and one with all of a document as comments: the first function of a block is what counts."""
    f = text.FENCE
    rows = _code(spark, d).withColumn("reply", F.concat(F.lit(f"so:\n{f}\nnothing\n{f}\nand\n{f}\n"), "code", F.lit(f"\n{f}\n")))
    blocks = F.explode(text.fences("reply"))
    found = rows.select("doc_id", "language", blocks.alias("b")).select("doc_id", "b", F.get(syntax.extract_functions("b", "language"), F.lit(0)).alias("f")).where("f is not null")
    body = F.decode(F.substring(F.encode("b", "UTF-8"), F.col("f.start_byte") + 1, F.col("f.end_byte") - F.col("f.start_byte")), "UTF-8")
    return found.select("doc_id", F.md5(F.concat(body, F.lit("\n"))).alias("code_md5"))


@query(f"WITH {_CODE_SQL} SELECT doc_id, strlen(t) + 1 + n * strlen(sign) + strlen(fn) AS n_bytes, md5(fn) AS rest_md5 FROM code")
def q49_obfuscated(spark, d):
    """Comments become NUL bytes of the same length; what is left is the function."""
    rows = _code(spark, d).select("doc_id", syntax.obfuscated("code", "language").alias("o"))
    return rows.select("doc_id", F.octet_length("o").cast("long").alias("n_bytes"), F.md5(F.regexp_replace("o", r"^(?:\x00*\n)*", "")).alias("rest_md5"))


@query(f"WITH {_CODE_SQL} SELECT doc_id, md5(replace(fn, 'f' || doc_id, 'function_0')) AS named_md5 FROM code")
def q50_renamed_functions(spark, d):
    rows = _code(spark, d).select("doc_id", syntax.renamed_functions("code", "language").alias("c"))
    return rows.select("doc_id", F.md5(F.regexp_extract("c", r"(?s)((?:def|int|function|fn|func) function_0\(.*)$", 1)).alias("named_md5"))


@query("SELECT lang AS language, source AS repo, len(regexp_extract_all(string_agg('# current path: ' || doc_id || chr(10) || text, '' ORDER BY doc_id::VARCHAR), '[^ \\t\\n\\x0B\\f\\r]+'))::INT + 1 AS tokens FROM documents GROUP BY lang, source")
def q51_token_stats(spark, d):
    files = t(spark, d, "documents").select(F.col("lang").alias("language"), F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return evaluate.token_stats(files)


from haystrata.plans import catalog_stages  # noqa: E402,F401  registers its queries
