"""Registered queries of exchange files, stages and small columns, each with its SQL; catalog.py says how roles are mapped."""

from __future__ import annotations

from pyspark.sql import functions as F

from haystrata.functions import text
from haystrata.functions.provider import Echo
from haystrata.operators import context, curate, deps, score
from haystrata.plans import evaluate
from haystrata.plans.catalog import _BINS, _functions, _import_edges, query, t
from haystrata.sources import readers, sinks, trees


def _files(spark, d):
    return t(spark, d, "documents").select(F.col("lang").alias("language"), F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("path"), F.col("doc_id").alias("topo_idx"), F.col("doc_id").alias("file_idx"), F.col("text").alias("content"))


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id::VARCHAR) - 1 AS o, row_number() OVER (PARTITION BY lang, source, doc_id % 3 ORDER BY doc_id::VARCHAR) - 1 AS n3, count(*) FILTER (doc_id % 3 = 0) OVER (PARTITION BY lang, source) AS n_needles FROM documents)
SELECT 'file' AS kind, lang AS language, source AS repo, o::INT AS ord, doc_id::VARCHAR AS path, md5(text) AS value FROM d
UNION ALL SELECT 'dependency', lang, source, o::INT, doc_id::VARCHAR, md5(CASE WHEN doc_id % 2 = 0 THEN (doc_id + 1) || ',' || (doc_id + 2) ELSE '' END) FROM d
UNION ALL SELECT 'needle', lang, source, n3::INT, doc_id::VARCHAR, md5('about ' || doc_id || ' of ' || n_needles) FROM d WHERE doc_id % 3 = 0
UNION ALL SELECT 'seed', lang, source, 0, '', md5('sha ' || count(*)) FROM d GROUP BY lang, source""")
def q54_dataset_json(spark, d):
    """Every document in dataset files of the exchange format, one for each repository, and read back as files, dependencies, needles and seeds."""
    docs = _files(spark, d).withColumn("id", F.col("topo_idx"))
    needle = F.struct(*[F.col("path").alias("name") if c == "name" else F.lit(0).alias(c) for c in ("name", "start_line", "end_line")], F.col("path").alias("path"), F.concat(F.lit("about "), "path").alias("description"))
    list_of = lambda c: F.array_sort(F.collect_list(c))
    repos = docs.groupBy("language", "repo").agg(
        F.map_from_entries(list_of(F.struct("path", "content"))).alias("content"), F.concat(F.lit("sha "), F.count(F.lit(1))).alias("commit_sha"),
        F.map_from_entries(list_of(F.struct("path", F.when(F.col("id") % 2 == 0, F.array((F.col("id") + 1).cast("string"), (F.col("id") + 2).cast("string"))).otherwise(F.array().cast("array<string>"))))).alias("dependency"),
        F.array_sort(F.collect_list(F.when(F.col("id") % 3 == 0, needle))).alias("needles"),
    )
    own = F.struct("repo", "commit_sha", F.lit("/").alias("entrypoint_path"), F.lit("t").alias("topic"), "content", "dependency", "needles")
    path = sinks.work_folder(spark) + "/dataset"
    repos.select(F.to_json(F.create_map("language", F.array(own))).alias("value"), F.col("language").alias("l"), F.col("repo").alias("r")).write.partitionBy("l", "r").text(path)
    repos = readers.read_dataset(spark, path)
    row = lambda df, kind, ord_, path, value: df.select(F.lit(kind).alias("kind"), "language", "repo", F.col(ord_).alias("ord"), path.alias("path"), F.md5(value).alias("value"))
    out = row(readers.files_of(repos), "file", "file_ord", F.col("path"), F.col("content"))
    out = out.union(row(readers.deps_of(repos), "dependency", "src_ord", F.col("src"), F.array_join("dst", ",")))
    out = out.union(row(readers.needles_of(repos), "needle", "needle_ord", F.col("path"), F.concat("description", F.lit(" of "), "n_needles")))
    return out.union(row(readers.read_seeds(spark, path), "seed", "repo_ord", F.lit(""), F.col("commit_sha")))


@query("SELECT o_orderkey, false AS overwrite FROM orders WHERE NOT o_totalprice > 200000 UNION ALL SELECT o_orderkey, true FROM orders")
def q55_stage_flags(spark, d):
    """What a stage still has to do, and what it does to overwrite, where orders over a price have their result."""
    orders = t(spark, d, "orders")
    done = orders.where("o_totalprice > 200000").select("o_orderkey")
    return curate.pending(orders.select("o_orderkey"), done, ["o_orderkey"]).withColumn("overwrite", F.lit(False)).union(curate.pending(orders.select("o_orderkey"), done, ["o_orderkey"], True).withColumn("overwrite", F.lit(True)))


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE doc_id % 2 = 0")
def q56_contents_api(spark, d):
    """A contents listing of all documents, of which every other is base64 and the rest too large to be listed."""
    rows = t(spark, d, "documents").select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 2 == 0, "base64").otherwise("none").alias("encoding"), F.when(F.col("doc_id") % 2 == 0, F.base64(F.encode("text", "UTF-8"))).otherwise("").alias("content"))
    return readers.decode_contents(rows).select(F.col("path").alias("doc_id"), F.md5("content").alias("text_md5"))


@query("""SELECT doc_id, source AS tail, CASE WHEN n_chars > 0 THEN doc_id / n_chars::DOUBLE END AS ratio, 'hé' || chr((65 + doc_id % 26)::INT) AS decoded, source || '/' || lang || '/x.py' AS path,
CASE WHEN doc_id % 2 = 0 THEN '[{"role":"system","content":"' || lang || '"},' ELSE '[' END || '{"role":"user","content":"' || source || '"}]' AS messages FROM documents""")
def q57_small_columns(spark, d):
    rows = t(spark, d, "documents")
    codes = F.concat(F.lit(" 104  233\n"), (F.lit(65) + F.col("doc_id") % 26).cast("string"))
    system = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).when(F.col("doc_id") % 3 == 0, "")
    return rows.select(
        "doc_id", text.repo_tail(F.concat("lang", F.lit("/"), "source")).alias("tail"), text.actual_ratio("doc_id", "n_chars").alias("ratio"), text.decode_chars(codes).alias("decoded"),
        text.drop_relative(F.concat(F.lit("../"), "source", F.lit("/./"), "lang", F.lit("/../x.py"))).alias("path"), F.to_json(text.messages("source", system)).alias("messages"),
    )


@query("SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN text || chr(10) WHEN 1 THEN 'x' || text || 'y' ELSE '```' || chr(10) || text || '!' END) AS code_md5 FROM documents")
def q58_sanitized_blocks(spark, d):
    """Replies with two fenced blocks, none, and one that never ends, by turns: the first block, else the stripped reply."""
    f, turn = text.FENCE, F.col("doc_id") % 3
    two = F.concat(F.lit(f"so:\n{f}py\n"), "text", F.lit(f"\n{f}\nor\n{f}\nother\n{f}\n"))
    reply = F.when(turn == 0, two).when(turn == 1, F.concat(F.lit(" \n x"), "text", F.lit("y\t \n"))).otherwise(F.concat(F.lit(f"\n{f}\n"), "text", F.lit("! ")))
    return score.sanitize(t(spark, d, "documents").select("doc_id", reply.alias("reply"))).select("doc_id", F.md5("code").alias("code_md5"))


@query("""SELECT 'orphan' AS kind, lang AS language, source AS repo, 0 AS n FROM (SELECT DISTINCT lang, source FROM documents) WHERE NOT (lang IN ('en', 'de') AND source IN (SELECT 'src' || (item_id % 20) FROM benchmark))
UNION ALL SELECT 'functions', lang, source, sum(len(list_filter(string_split(text, chr(10)), lambda x: x <> '')))::INT FROM documents GROUP BY lang, source HAVING sum(len(list_filter(string_split(text, chr(10)), lambda x: x <> ''))) > 0""")
def q59_orphans_and_counts(spark, d):
    """Repositories of outputs that no needle has, and the functions of each repository."""
    outputs = t(spark, d, "documents").select(F.col("lang").alias("language"), F.col("source").alias("repo"))
    needles = t(spark, d, "benchmark").select(F.explode(F.array(F.lit("en"), F.lit("de"))).alias("language"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("repo"))
    lost = evaluate.orphans(outputs, needles).select(F.lit("orphan").alias("kind"), "language", "repo", F.lit(0).alias("n"))
    return lost.union(curate.functions_per_repo(_functions(spark, d)).select(F.lit("functions"), "language", "repo", F.col("n_functions").cast("int")))


_ASK = "'Can you **briefly** describe the purpose, input, output, and procedure of \"' || doc_id || '\"?'"


@query(f"""WITH l AS (SELECT lang, source, doc_id, line, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id, k) - 1 AS g, k FROM (SELECT lang, source, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents)),
n AS (SELECT lang, source, doc_id, g + 1 AS a FROM l WHERE k = 0),
c AS (SELECT n.doc_id, string_agg(line, chr(10) ORDER BY g) AS code FROM n JOIN l ON l.lang = n.lang AND l.source = n.source AND l.g >= greatest(0, a - 3) AND l.g < a + 2 GROUP BY n.doc_id)
SELECT doc_id, md5({_ASK} || chr(10) || chr(10) || '```' || chr(10) || code || chr(10) || '```' || chr(10) || chr(10) || {_ASK} || chr(10) || chr(10) || 'Please follow format to complete the skeleton below:' || chr(10) || chr(10) || '<desc_start>' || chr(10)
|| '1. **Purpose**: ...' || chr(10) || '2. **Input**: ...' || chr(10) || '3. **Output**: ...' || chr(10) || '4. **Procedure**: ...' || chr(10) || '<desc_end>' || chr(10) || chr(10) || {_ASK} || chr(10) || chr(10) || 'Notes:' || chr(10)
|| '1. DO NOT reveal function names (' || doc_id || ') and variable names' || chr(10) || '2. Start with <desc_start> and end with <desc_end>' || chr(10) || '3. Customize the description to differentiate it from other functions' || chr(10)) AS prompt_md5, ' and end with ' AS annotation FROM c""")
def q60_annotation_requests(spark, d):
    """A request for every document's second and third line, shown after the three lines before them in the whole repository, answered by an echo and parsed."""
    files = _files(spark, d)
    base = curate.global_offsets(files, "file_idx")
    needles = base.select("language", "repo", F.col("path").alias("name"), (F.col("lines_before") + 1).cast("int").alias("global_start_line"), (F.col("lines_before") + 3).cast("int").alias("global_end_line"))
    asked = evaluate.annotation_requests(needles, files, 3)
    got = evaluate.parse_annotations(evaluate.run_provider(asked, Echo))
    return got.select(F.col("name").cast("long").alias("doc_id"), F.md5("prompt").alias("prompt_md5"), "annotation")


@query(f"""WITH {_BINS}, r AS (SELECT *, row_number() OVER (PARTITION BY language, repo ORDER BY md5('0/' || doc_id || '/' || name), doc_id::VARCHAR, name) AS i2 FROM picked)
SELECT language, repo, doc_id, line_no::INT AS line_no, (i2 - 1)::INT AS needle_ord, least(10, count(*) OVER (PARTITION BY language, repo))::INT AS n_needles FROM r QUALIFY i2 <= 10""")
def q61_select_needles(spark, d):
    """Needles of every repository by the whole selection: names of their own, length, bins, seeded sample."""
    files = _files(spark, d)
    base = curate.global_offsets(files).select("language", "repo", "topo_idx", "chars_before")
    fns = _functions(spark, d).join(base, ["language", "repo", "topo_idx"]).withColumn("global_start_byte", F.col("chars_before") + F.col("fn_ord")).withColumn("start_byte", F.lit(0)).withColumn("end_byte", F.col("n"))
    return curate.select_needles(fns, files).select("language", "repo", F.col("topo_idx").alias("doc_id"), F.col("fn_ord").alias("line_no"), "needle_ord", "n_needles")


@query("""SELECT a.lang AS repo, 'root/x/g' || a.doc_id || '.go' AS src, CASE WHEN b.doc_id IS NULL THEN '' ELSE 'root/x/g' || b.doc_id || '.go' END AS dst FROM documents a LEFT JOIN documents b ON a.lang = b.lang AND b.doc_id = a.doc_id + 1""")
def q62_dependency_lists(spark, d):
    """Sorted dependency lists of every document as a Go file, empty ones too, with the entry point before their paths."""
    files = t(spark, d, "documents").select(F.col("lang").alias("repo"), F.concat(F.lit("x/g"), "doc_id", F.lit(".go")).alias("path"))
    lists = deps.with_empty(files, _import_edges(spark, d, "go"))
    return deps.sanitize_go_paths(lists, "root/").select("repo", "src", F.array_join("dst", ",").alias("dst"))


@query("SELECT DISTINCT l_orderkey AS repo, l_partkey::VARCHAR AS src, nxt::VARCHAR AS dst FROM (SELECT l_orderkey, l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS nxt FROM lineitem) WHERE nxt IS NOT NULL AND nxt <> l_partkey")
def q63_cycle_edges(spark, d):
    """An order's parts, line by line, as a cycle of imports: an edge for each pair that follow one another."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string"))
    return deps.cycle_edges(t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("repo")).agg(lines.alias("cycle")))


@query("SELECT p_partkey::VARCHAR AS model, CASE WHEN greatest(p_size * 1024 * (p_partkey % 2), (p_partkey % 9000) * (p_partkey % 3)) = 0 THEN 'N/A' ELSE (greatest(p_size * 1024 * (p_partkey % 2), (p_partkey % 9000) * (p_partkey % 3)) // 1024) || 'k' END AS train_size FROM part")
def q64_model_context(spark, d):
    """Parts as model configurations with two of the known length keys, 0 where they have none."""
    rows = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("model"), (F.col("p_size") * 1024 * (F.col("p_partkey") % 2)).alias("max_position_embeddings"), (F.col("p_partkey") % 9000 * (F.col("p_partkey") % 3)).alias("seq_len"))
    return readers.model_context(rows)


@query("""SELECT a.lang AS repo, 'lib/' || a.doc_id AS src, 'lib/' || b.doc_id AS dst FROM documents a JOIN documents b ON a.lang = b.lang AND b.doc_id = a.doc_id + 1 WHERE a.doc_id % 5 <> 0 AND b.doc_id % 5 <> 0""")
def q65_prefixed_paths(spark, d):
    """Edges of paths without their parent directory, which they get where both files are in it."""
    docs = t(spark, d, "documents").select(F.col("lang").alias("repo"), "doc_id")
    files = docs.select("repo", F.concat(F.when(F.col("doc_id") % 5 == 0, "src/").otherwise("lib/"), "doc_id").alias("path"))
    edges = docs.select("repo", F.col("doc_id").cast("string").alias("src"), (F.col("doc_id") + 1).cast("string").alias("dst"))
    return deps.prefix_paths(edges, "lib", files)


@query("""SELECT CASE k WHEN 0 THEN 'py' WHEN 1 THEN 'en' ELSE 'one' END AS kind, lang || '/' || source || '/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.txt' END AS path, strlen(text) AS size, md5(text) AS content_md5 FROM documents, (SELECT unnest([0, 1, 2]) AS k)
WHERE k = 0 AND doc_id % 2 = 0 OR k = 1 AND lang = 'en' OR k = 2 AND doc_id = (SELECT min(doc_id) FROM documents)""")
def q66_file_tree(spark, d):
    """Every document as a file in a tree of folders, read through the tree source by ending, by beginning and by name."""
    docs = t(spark, d, "documents")
    name = F.concat("lang", F.lit("/"), "source", F.lit("/"), "doc_id", F.when(F.col("doc_id") % 2 == 0, ".py").otherwise(".txt"))
    folder = sinks.work_folder(spark)
    trees.write_tree(docs.select(name.alias("path"), F.col("text").alias("content")), folder)
    first = docs.agg(F.min_by(name, "doc_id")).first()[0] or "none"
    out = None
    for kind, picked in (("py", {"ends": [".py"]}), ("en", {"begins": ["en/"]}), ("one", {"names": [first]})):
        one = trees.read_tree(spark, folder, **picked).select(F.lit(kind).alias("kind"), "path", "size", F.md5("content").alias("content_md5"))
        out = one if out is None else out.union(one)
    return out


_CLEAN_SQL = """WITH d AS (SELECT doc_id, string_split(regexp_replace(text, '[\\r\\x00\\x0c]', ' ', 'g'), chr(10)) AS l FROM documents),
c AS (SELECT doc_id, len(l) AS n, list_sum(list_transform(l, lambda x: 1 + len(regexp_extract_all(x, '[^ \\t\\n\\x0B\\f\\r]+'))))::BIGINT AS lost FROM d),
p AS (SELECT *, greatest(0, (lost + 3) // 5) AS k, '# Path: ' || doc_id || '.py' || chr(10) || repeat(chr(10), n) || 'x = 1' || chr(10) || chr(10) AS a, chr(10) || repeat(chr(10), n) || 'z = 3' || chr(10) AS b FROM c),
m AS (SELECT doc_id, 'no_padding' AS mode, a, b, 7 AS s FROM p
UNION ALL SELECT doc_id, 'positional_padding', array_to_string(list_transform(range(k), lambda i: '# Line Number ' || i || chr(10)), '') || chr(10) || a, b || array_to_string(list_transform(range(k, 2 * k), lambda i: '# Line Number ' || i || chr(10)), '') || chr(10), 7 + 4 * k FROM p)
SELECT doc_id, mode, md5(a || 'y = 2' || b) AS context_md5, s::INT AS needle_token_start, (s + 4)::INT AS needle_token_end FROM m"""


@query(_CLEAN_SQL)
def q67_clean_contexts(spark, d):
    """Contexts without comments, padded and not, of a needle in each document's own file: all lines of its text as comments before the needle and again after it."""
    shown = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\x00\x0c]", " ")
    notes = F.concat(F.lit("# "), F.replace(shown, F.lit("\n"), F.lit("\n# ")), F.lit("\n"))
    before = F.concat(notes, F.lit("x = 1\n"))
    path = F.concat("doc_id", F.lit(".py"))
    docs = t(spark, d, "documents").select(F.lit("python").alias("language"), F.col("doc_id").cast("string").alias("repo"), path.alias("path"), F.lit(0).alias("file_idx"), F.concat(before, F.lit("y = 2\n"), notes, F.lit("z = 3")).alias("content"), F.length(before).alias("at"))
    needles = docs.select("language", "repo", "path", F.lit("y").alias("name"), F.col("at").alias("start_byte"), (F.col("at") + 5).alias("end_byte"), F.lit(2).alias("needle_ord"), F.lit(5).alias("n_needles"))
    rows = context.make_context(needles, docs.drop("at"), 4_000_000, offset_mode="chars", parts=True)
    got = context.clean_modes(rows, {"no_padding": False, "positional_padding": True})
    return got.select(F.col("repo").cast("long").alias("doc_id"), F.col("clean_mode").alias("mode"), F.md5("code_context").alias("context_md5"), "needle_token_start", "needle_token_end")
