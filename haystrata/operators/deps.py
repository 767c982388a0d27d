"""Import edges of source files: files (repo, path, content) -> edges (repo, src, dst), joined against the files that exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haystrata.functions.text import drop_relative

# Directories that includes are searched in.
INCLUDE_DIRS = ["include", "src", "lib", "libs", "library", "libraries", "inc"]


def _dir(path) -> F.Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def _join_path(a, b) -> F.Column:
    return F.when(a == "", b).otherwise(F.concat(a, F.lit("/"), b))


def _normal(path) -> F.Column:
    """A path without . and x/.. steps; .. at the start is dropped."""
    step = lambda acc, x: F.when(x.isin(".", ""), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


_STRING = r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"?'
_CHAR = r"'(?:\\[^\n]{1,8}|[^'\\\n])'"
_C_NOTE = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\z)"
_QUOTE = r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'?"
_DOUBLE3 = r'"""[\s\S]*?(?:"""|\z)'
#: What is no code of a language, in the order in which one pass over a text tries it: literals over several lines, others, comments.
_NO_CODE = {
    "python": (_DOUBLE3 + "|" + _DOUBLE3.replace('"', "'"), f"{_STRING}|{_QUOTE}", r"#[^\n]*"),
    "java": (_DOUBLE3, f"{_STRING}|{_CHAR}", _C_NOTE),
    "cpp": (r'R"(?<mark>[^()\\\s]{0,16})\([\s\S]*?(?:\)\k<mark>"|\z)', f"{_STRING}|{_CHAR}", _C_NOTE),
    "go": ("`[^`]*`?", f"{_STRING}|{_CHAR}", _C_NOTE),
    "rust": (r'r(?<mark>#{0,8})"[\s\S]*?(?:"\k<mark>|\z)', f"{_STRING}|{_CHAR}", _C_NOTE),
    "typescript": (r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`?", f"{_STRING}|{_QUOTE}", _C_NOTE),
}


def code_only(content, language: str, literals: bool = False) -> F.Column:
    """A text without comments and, unless literals of one line are to stay, without string and character literals; a space stands for each. One linear pass; what never ends reaches to the end of its line or the text."""
    long, short, notes = _NO_CODE[language]
    return F.regexp_replace(content, f"(?:{long})|(?<kept>{short})|{notes}", " ${kept}" if literals else " ")


def _edges(found: DataFrame) -> DataFrame:
    return found.where("src <> dst").select("repo", "src", "dst").distinct()


def with_empty(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, src, dst array sorted) for every file; files without edges have an empty list."""
    lists = edges.groupBy("repo", "src").agg(F.array_sort(F.collect_set("dst")).alias("dst"))
    return files.select("repo", F.col("path").alias("src")).join(lists, ["repo", "src"], "left").withColumn("dst", F.coalesce("dst", F.array().cast("array<string>")))


def cpp_edges(files: DataFrame, entrypoint: str = "") -> DataFrame:
    """#include lines, resolved against the file's own directory, the root, then every directory with an include-like name; the first that exists."""
    inc = files.select("repo", F.col("path").alias("src"), F.explode(F.split(code_only("content", "cpp", True), "\n")).alias("line"))
    inc = inc.select("repo", "src", F.regexp_extract(F.trim("line"), r"""^#\s?include\s+["<]([^">]*\.[^">]*)[">]""", 1).alias("inc")).where("inc <> ''").distinct()
    names = files.select("repo", F.col("path").alias("dst"))
    dirs = files.select("repo", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/"))).alias("dir")).distinct()
    dirs = dirs.where(F.substring_index("dir", "/", -1).isin(*INCLUDE_DIRS))
    near = inc.select("repo", "src", "inc", _dir(F.col("src")).alias("dir"), F.lit(0).alias("rank")).union(inc.select("repo", "src", "inc", F.lit(""), F.lit(1)))
    far = inc.join(dirs, "repo").select("repo", "src", "inc", "dir", F.lit(2))
    cand = near.union(far).withColumn("dst", _normal(_join_path(F.col("dir"), F.col("inc")))).where(F.col("dst").startswith(entrypoint))
    w = Window.partitionBy("repo", "src", "inc").orderBy("rank", "dir")
    hit = cand.join(names, ["repo", "dst"], "left_semi").withColumn("n", F.row_number().over(w)).where("n = 1")
    return _edges(hit)


def python_edges(files: DataFrame) -> DataFrame:
    """import and from-import statements whose module is a file of the repository."""
    module = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), r"/__init__$", ""), "/", ".")
    mods = files.select("repo", module.alias("module"), F.col("path").alias("dst"))
    clean = F.regexp_replace(code_only("content", "python"), r"\\\s*\n", " ")  # a line that goes on
    text = files.select("repo", F.col("path").alias("src"), module.alias("own"), F.col("path").rlike(r"(^|/)__init__\.py$").alias("package"), clean.alias("content"))
    plain = text.select("repo", "src", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)(?:^|[;:])[ \t]*import[ \t]+([^\n;]+)"), F.lit(1))).alias("m"))
    plain = plain.select("repo", "src", F.explode(F.split("m", ",")).alias("m")).select("repo", "src", F.regexp_extract("m", r"^\s*([\w.]+)", 1).alias("module"))
    stmt = text.select("repo", "src", "own", "package", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)(?:^|[;:])[ \t]*from(?:[ \t]+|(?=\.))([.\w]+\s+import\b\s*(?:\([^)]*\)|[^\n;(]*))"), F.lit(1))).alias("m"))
    stmt = stmt.select("repo", "src", "own", "package", F.split("m", r"\s+import\b\s*\(?").alias("p")).select("repo", "src", "own", "package", F.col("p")[0].alias("base"), F.explode(F.split(F.col("p")[1], ",")).alias("name"))
    stmt = stmt.withColumn("name", F.regexp_extract("name", r"^\s*(\w+)", 1)).where("name <> ''")
    dots = F.length("base") - F.length(F.regexp_replace("base", r"^\.+", ""))
    up = F.greatest(dots, F.lit(1)) - F.col("package").cast("int")  # a package's own module is its folder
    parent = F.array_join(F.slice(F.split("own", r"\."), 1, F.greatest(F.size(F.split("own", r"\.")) - up, F.lit(0))), ".")
    rest = F.regexp_replace("base", r"^\.+", "")
    full = F.when(dots == 0, F.col("base")).otherwise(F.concat_ws(".", F.when(parent != "", parent), F.when(rest != "", rest)))
    stmt = stmt.select("repo", "src", full.alias("base"), "name")
    wanted = plain.union(stmt.select("repo", "src", "base")).union(stmt.select("repo", "src", F.concat_ws(".", F.when(F.col("base") != "", F.col("base")), F.col("name"))))
    return _edges(wanted.distinct().join(mods, ["repo", "module"]))


def java_edges(files: DataFrame) -> DataFrame:
    """Imports (classes, static members, whole packages) and names of classes in the same directory, in code only."""
    names = files.select("repo", F.col("path").alias("dst"), _dir(F.col("path")).alias("dir"), F.regexp_extract("path", r"([^/]+)\.java$", 1).alias("stem"))
    files = files.select("repo", "path", code_only("content", "java").alias("content"))
    imp = files.select("repo", F.col("path").alias("src"), F.explode(F.regexp_extract_all("content", F.lit(r"(?m)(?:^|;)\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*(?=;)"), F.lit(1))).alias("m"))
    star = F.col("m").endswith(".*")
    path = F.replace(F.regexp_replace("m", r"\.\*$", ""), F.lit("."), F.lit("/"))
    up = F.regexp_replace(path, "/[^/]*$", "")
    tail = imp.select("repo", "src", star.alias("star"), F.explode(F.when(star, F.array(path)).otherwise(F.array(path, up))).alias("p"))
    suffixes = names.select("repo", "dst", F.explode(F.expr("transform(sequence(1, size(split(dst, '/'))), n -> array_join(slice(split(dst, '/'), n, size(split(dst, '/'))), '/'))")).alias("s"))
    one = tail.withColumn("s", F.concat("p", F.lit(".java"))).join(suffixes, ["repo", "s"])
    packages = names.where("dir <> ''").select("repo", "dst", F.explode(F.expr("transform(sequence(1, size(split(dir, '/'))), n -> array_join(slice(split(dir, '/'), n, size(split(dir, '/'))), '/'))")).alias("p"))
    every = tail.where("star").join(packages, ["repo", "p"])
    ids = files.select("repo", F.col("path").alias("src"), _dir(F.col("path")).alias("dir"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\b([A-Z]\w*)\b"), F.lit(1)))).alias("stem"))
    same = ids.join(names, ["repo", "dir", "stem"])
    return _edges(one.select("repo", "src", "dst").union(every.select("repo", "src", "dst")).union(same.select("repo", "src", "dst")))


def go_edges(files: DataFrame) -> DataFrame:
    """Selector expressions x.Name in code whose x is the stem of a file."""
    names = files.select("repo", F.col("path").alias("dst"), F.regexp_extract("path", r"([^/]+)\.go$", 1).alias("stem")).where("stem <> ''")
    ids = files.select("repo", F.col("path").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(code_only("content", "go"), F.lit(r"(?<![\w.])([A-Za-z_]\w*)\s*\.\s*[A-Za-z_]\w*"), F.lit(1)))).alias("stem"))
    return _edges(ids.join(names, ["repo", "stem"]))


def sanitize_go_paths(deps: DataFrame, entrypoint: str) -> DataFrame:
    """deps (repo, src, dst array) with relative steps dropped and the entry point in front."""
    clean = lambda p: F.concat(F.lit(entrypoint.rstrip("/") + "/" if entrypoint else ""), drop_relative(p))
    return deps.withColumn("src", clean(F.col("src"))).withColumn("dst", F.transform("dst", clean))


def use_paths(tree) -> F.Column:
    """Every path of a use tree, nested groups expanded: array of paths without `as` names, a group's `self` and `*` as the group's own path. One fold over the tree's tokens with a stack of the open groups' paths."""
    parts = F.filter(F.regexp_extract_all(tree, F.lit(r"[{},]|[^{},]+"), F.lit(0)), lambda x: F.trim(x) != "")
    state = "struct<open:array<string>,own:string,out:array<string>>"
    begin = F.struct(F.array(F.lit("")).alias("open"), F.lit("").alias("own"), F.array().cast("array<string>").alias("out")).cast(state)

    def step(acc, x):
        top, own = F.get(acc["open"], F.lit(0)), acc["own"]
        kept = F.when(own == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(F.concat(top, own))))
        path = F.regexp_replace(F.regexp_replace(x, r"\s+as\s+\w+\s*$", ""), r"\s", "")
        rest = F.slice(acc["open"], 2, F.greatest(F.size(acc["open"]) - 1, F.lit(0)))
        made = lambda stack, word, out: F.struct(stack.alias("open"), word.alias("own"), out.alias("out")).cast(state)
        group = F.when(x == "{", made(F.concat(F.array(F.concat(top, own)), acc["open"]), F.lit(""), acc["out"])).when(x == "}", made(F.when(F.size(acc["open"]) > 1, rest).otherwise(acc["open"]), F.lit(""), kept))
        return group.when(x == ",", made(acc["open"], F.lit(""), kept)).otherwise(made(acc["open"], path, acc["out"]))

    leaves = F.aggregate(parts, begin, step, lambda a: F.when(a["own"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(F.concat(F.get(a["open"], F.lit(0)), a["own"])))))
    return F.array_distinct(F.transform(leaves, lambda x: F.regexp_replace(x, r"(?<=\w)::(?:self|\*)?$", "")))


def rust_edges(files: DataFrame) -> DataFrame:
    """use paths, nested groups expanded, and mod declarations, resolved to the longest module prefix that is a file (x.rs or x/mod.rs), else the crate's lib.rs or main.rs.
    A path that begins with no crate, self or super is one of the module's own children, or none of the repository's."""
    text = files.select("repo", F.col("path").alias("src"), code_only("content", "rust").alias("content"))
    root = F.regexp_extract("src", r"^((?:.*/)?src)/", 1)
    own = F.when(F.col("src").rlike(r"(^|/)(mod|lib|main)\.rs$"), _dir(F.col("src"))).otherwise(F.regexp_replace("src", r"\.rs$", ""))  # where the module's children are
    head = r"(?:^|[;{}\]])\s*(?:pub\s*(?:\([^)]*\))?\s+)?"
    text = text.select("repo", "src", root.alias("root"), own.alias("own"), "content")
    use = text.select("repo", "src", "root", "own", F.explode(F.regexp_extract_all("content", F.lit(head + r"use\s+(?:::)?([^;]+)(?=;)"), F.lit(1))).alias("m")).select("repo", "src", "root", "own", F.explode(use_paths(F.col("m"))).alias("m"))
    parts = F.filter(F.split("m", "::"), lambda x: x != "")
    use = use.select("repo", "src", "root", "own", parts.alias("p"))
    ups = F.size(F.split(F.regexp_extract(F.array_join("p", "::"), r"^((?:(?:self|super)(?:::|$))*)", 1), "super")) - 1
    lead = F.size(F.filter(F.split(F.regexp_extract(F.array_join("p", "::"), r"^((?:(?:self|super)(?:::|$))*)", 1), "::"), lambda x: x != ""))
    dirs = F.split("own", "/")
    above = F.array_join(F.slice(dirs, 1, F.greatest(F.size(dirs) - ups, F.lit(0))), "/")
    first = F.get("p", F.lit(0))
    base = F.when(first == "crate", F.col("root")).when(lead > 0, above).otherwise(F.col("own"))
    rest = F.slice("p", F.when(first == "crate", F.lit(2)).otherwise(lead + 1), F.size("p") + 1)
    use = use.select("repo", "src", "root", base.alias("base"), rest.alias("p"), ((first == "crate") | (lead > 0)).alias("sure"))
    mod = text.select("repo", "src", "root", F.col("own").alias("base"), F.explode(F.regexp_extract_all("content", F.lit(head + r"mod\s+(\w+)\s*(?=;)"), F.lit(1))).alias("m")).select("repo", "src", "root", "base", F.array("m").alias("p"), F.lit(True).alias("sure"))
    # from the crate's root on: an item of a module is in the module's file
    inner = F.filter(F.split(F.when(F.col("base") == F.col("root"), F.lit("")).otherwise(F.substr("base", F.length("root") + F.when(F.col("root") == "", 1).otherwise(2))), "/"), lambda x: x != "")
    every = use.union(mod).select("repo", "src", "root", F.concat(inner, "p").alias("p"), F.when(F.col("sure"), 0).otherwise(F.size(inner) + 1).alias("least")).distinct().withColumn("u", F.concat_ws("::", "p"))
    cand = every.where("least <= size(p)").select("repo", "src", "root", "u", "p", F.explode(F.sequence(F.col("least"), F.size("p"))).alias("n"))
    stem = _join_path(F.col("root"), F.array_join(F.slice("p", 1, F.col("n")), "/"))
    main = F.array(_join_path(F.col("root"), F.lit("lib.rs")), _join_path(F.col("root"), F.lit("main.rs")))
    cand = cand.select("repo", "src", "u", "n", F.explode(F.when(F.col("n") > 0, F.array(F.concat(stem, F.lit(".rs")), F.concat(stem, F.lit("/mod.rs")))).otherwise(main)).alias("dst"))
    w = Window.partitionBy("repo", "src", "u").orderBy(F.desc("n"), "dst")
    return _edges(cand.join(files.select("repo", F.col("path").alias("dst")), ["repo", "dst"], "left_semi").withColumn("k", F.row_number().over(w)).where("k = 1"))


def path_aliases(files: DataFrame) -> DataFrame:
    """(repo, dir, base, pattern, targets) of the compiler configurations (tsconfig.json, jsconfig.json) among files, comments and trailing commas allowed; base: the folder that targets
    and plain names begin at, null without a base URL. A configuration without paths has one row with a null pattern."""
    own = files.where(F.col("path").rlike(r"(^|/)(tsconfig|jsconfig)\.json$"))
    plain = F.regexp_replace(code_only("content", "typescript", True), r",(\s*[}\]])", "$1")
    c = F.from_json(plain, "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>")["compilerOptions"]
    rows = own.select("repo", _dir(F.col("path")).alias("dir"), F.col("path"), c["baseUrl"].alias("url"), F.coalesce(c["paths"], F.create_map().cast("map<string,array<string>>")).alias("paths"))
    best = rows.groupBy("repo", "dir").agg(F.max_by(F.struct("url", "paths"), "path").alias("c")).select("repo", "dir", "c.*")  # of two, the TypeScript one
    rows = best.select("repo", "dir", F.col("url"), F.explode_outer("paths").alias("pattern", "targets"))
    return rows.select("repo", "dir", F.when(F.col("url").isNotNull(), _normal(_join_path(F.col("dir"), F.col("url")))).alias("base"), "pattern", "targets")


def typescript_edges(files: DataFrame) -> DataFrame:
    """import, export-from and require paths with .ts, .js or an index file: relative ones by the file's folder, others by the path aliases of the nearest configuration above
    the file (an exact name, else the longest pattern prefix, its targets in order), else by its base URL."""
    clean = files.select("repo", F.col("path").alias("src"), code_only("content", "typescript", True).alias("content"))
    pattern = r"""(?:\bfrom\s*|\brequire\s*\(\s*|\bimport\s*\(?\s*)['"]([^'"\n]+)['"]"""
    imp = clean.select("repo", "src", F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(1))).alias("m")).distinct()
    near = F.col("m").rlike(r"^\.{1,2}(/|$)")
    relative = imp.where(near).select("repo", "src", "m", _normal(_join_path(_dir(F.col("src")), F.col("m"))).alias("stem"), F.lit(0).alias("place"))
    alias = path_aliases(files)
    # the nearest configuration: the longest of the file's folders that has one
    far = imp.where(~near).withColumn("steps", F.split(_dir(F.col("src")), "/"))
    far = far.select("repo", "src", "m", F.explode(F.transform(F.sequence(F.lit(0), F.size("steps")), lambda n: F.array_join(F.slice("steps", 1, n), "/"))).alias("dir")).distinct()
    held = far.join(alias.select("repo", "dir").distinct(), ["repo", "dir"]).groupBy("repo", "src", "m").agg(F.max_by("dir", F.length("dir")).alias("dir"))
    star = F.instr("pattern", "*")
    forms = alias.where("pattern is not null").select("repo", "dir", "base", "targets", F.when(star > 0, F.substr("pattern", F.lit(1), star - 1)).otherwise(F.col("pattern")).alias("head"), F.when(star > 0, F.substr("pattern", star + 1)).alias("tail"))
    heads = held.select("repo", "src", "m", "dir", F.explode(F.transform(F.sequence(F.lit(0), F.length("m")), lambda n: F.substr(F.col("m"), F.lit(1), n))).alias("head"))
    fit = heads.join(forms, ["repo", "dir", "head"]).where((F.col("tail").isNull() & (F.col("head") == F.col("m"))) | (F.col("tail").isNotNull() & F.endswith("m", "tail") & (F.length("head") + F.length("tail") <= F.length("m"))))
    best = fit.groupBy("repo", "src", "m", "dir").agg(F.max_by(F.struct("head", "tail", "base", "targets"), F.struct(F.col("tail").isNull(), F.length("head"), F.length("tail"))).alias("a"))
    middle = F.when(F.col("a.tail").isNull(), F.lit("")).otherwise(F.substr(F.col("m"), F.length("a.head") + 1, F.length("m") - F.length("a.head") - F.length("a.tail")))
    found = best.select("repo", "src", "m", F.coalesce("a.base", "dir").alias("at"), middle.alias("middle"), F.posexplode("a.targets").alias("place", "target"))
    found = found.select("repo", "src", "m", _normal(_join_path(F.col("at"), F.replace("target", F.lit("*"), F.col("middle")))).alias("stem"), "place")
    bases = alias.where("base is not null").select("repo", "dir", "base").distinct()
    plain = held.join(best, ["repo", "src", "m"], "left_anti").join(bases, ["repo", "dir"]).select("repo", "src", "m", _normal(_join_path(F.col("base"), F.col("m"))).alias("stem"), F.lit(0).alias("place"))
    ends = ["", ".ts", ".js", "/index.ts", "/index.js"]
    names = F.array(*[F.concat("stem", F.lit(e)) for e in ends], F.regexp_replace("stem", r"\.js$", ".ts"))  # a name of the compiled file
    cand = relative.union(found).union(plain).select("repo", "src", "m", "place", F.posexplode(names).alias("rank", "dst"))
    w = Window.partitionBy("repo", "src", "m").orderBy("place", "rank")
    sources = files.where(F.col("path").rlike(r"\.(ts|js)$")).select("repo", F.col("path").alias("dst"))
    return _edges(cand.join(sources, ["repo", "dst"], "left_semi").withColumn("k", F.row_number().over(w)).where("k = 1"))


def cycle_edges(cycles: DataFrame) -> DataFrame:
    """cycles (repo, cycle array) -> an edge for each consecutive pair."""
    pairs = F.expr("transform(sequence(1, greatest(size(cycle) - 1, 1)), i -> struct(get(cycle, i - 1) as src, get(cycle, i) as dst))")
    return _edges(cycles.select("repo", F.explode(pairs).alias("e")).select("repo", "e.src", "e.dst"))


def prefix_paths(deps: DataFrame, parent: str, files: DataFrame) -> DataFrame:
    """deps (repo, src, dst) with a parent directory in front where such files exist."""
    names = files.select("repo", F.col("path"))
    out = deps.withColumn("src", F.concat(F.lit(parent.rstrip("/") + "/"), F.col("src"))).withColumn("dst", F.concat(F.lit(parent.rstrip("/") + "/"), F.col("dst")))
    for end in ("src", "dst"):
        out = out.join(names.withColumnRenamed("path", end), ["repo", end], "left_semi")
    return out


def crate_targets(metadata: DataFrame, entrypoint: str) -> DataFrame:
    """(repo, name, src_path, kind) of the targets of cargo metadata (repo, metadata as JSON) under the entry point that are libraries or programs by their first kind."""
    ddl = "packages array<struct<targets:array<struct<name:string,src_path:string,kind:array<string>>>>>"
    rows = metadata.select("repo", F.explode(F.from_json("metadata", ddl)["packages"]).alias("p")).select("repo", F.explode("p.targets").alias("t"))
    rows = rows.select("repo", "t.name", "t.src_path", F.get("t.kind", F.lit(0)).alias("kind"))
    return rows.where(F.contains("src_path", F.lit(entrypoint)) & F.col("kind").isin("lib", "bin"))


EDGES = {"cpp": cpp_edges, "python": python_edges, "java": java_edges, "go": go_edges, "rust": rust_edges, "typescript": typescript_edges}
