"""Cases where the operators once did less than the whole job."""

import random

from haystrata.functions import syntax
from haystrata.llm import common, decontaminate, html_extract, pii, quality_classifier, secret_scan, simhash_vptree
from haystrata.plans import catalog
from test_llm import brute_pii


def test_pii_digits_set_apart():
    assert [s[0] for s in pii.base_spans("card 4 2 4 2 4 2 4 2 4 2 4 2 4 2 4 2 ok")] == ["card"]
    assert [s[0] for s in pii.base_spans("ring +4 9 3 0 1 2 3 4 5 6 7 now")] == ["phone"]
    rng = random.Random(6)
    for _ in range(3000):
        t = "".join(rng.choice(["4 2 4 2 ", "4-2-", "+4 9 3 0 1 2 3", " ", "+", "a", "(", ")", "-", "7 ", "é"]) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(t) == brute_pii(t)


def test_secret_key_spellings(spark):
    value = "aB3dE5fG7hJ9kL1mN2pQ"
    for name in ("accessKey", "clientKey", "privateKey", "Auth_Key", "ENCRYPTION-kEY", "signing_key"):
        assert [k for (k, *_), _ in secret_scan.loose_spans(f'{name}: "{value}"')] == ["keyed"], name
    for prefix in ("glpat-", "xoxb-", "npm-", "ghp_"):  # signs without an underscore
        assert [k for (k, *_), _ in secret_scan.loose_spans(f"x {prefix}{value}")] == ["provider"], prefix
    rows = [(1, f'accessKey: "{value}"', "a"), *[(10 + i, f"accessKey={value[::-1]}", s) for i, s in enumerate("abc")], (20, f"access_key={value[::-1]}", "d")]
    got = {r["doc_id"]: r for r in secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1]["spans"] == "keyed:12:32" and got[1]["n_live"] == 1
    assert got[20]["spans"] == "" and got[20]["n_live"] == 0 and got[20]["n_copied"] == 1  # copied by four owners


def test_one_row_of_each_component(spark):
    rng = random.Random(2)
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400))
    a, b, c, d, e = (prose() for _ in range(5))
    near = c + " Zz"
    rows = [(1, a), (None, a), (2, b), (None, b), (None, c), (None, near), (7, d), (7, e)]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    assert len({r["component_id"] for r in simhash_vptree.near_duplicates(df).where("doc_id is null").collect()}) == 3  # 1, 2 and one group of nulls
    kept = simhash_vptree.one_of_each(df)
    got = sorted(r["n"] for r in kept.collect())
    assert kept.columns == df.columns
    assert [n for n in got if n not in (4, 5)] == [0, 2, 6, 7] and len(got) == 5


def test_decontamination_by_row(spark):
    items = [" ".join(f"w{k}x{i}" for i in range(12)) for k in range(3)]
    rows = [(None, "head " + items[0] + " tail"), (None, "a clean text"), (5, items[1]), (5, "another clean text"), (6, None), (7, items[2] + " end")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for bound in ({}, {"item_bytes": 50}):
        kept = decontaminate.decontaminate(df, bench, **bound)
        assert kept.columns == df.columns and sorted(r["n"] for r in kept.collect()) == [1, 3, 4]


def test_all_grades_are_trained(spark):
    assert common.merged_levels([(1, 5), (0, 3)], 10) == [(0, 0, 0, 3), (1, 1, 1, 5)]
    assert common.merged_levels([(0.25, 5), (0.5, 3)], 10) == [(0.25, 0.25, 0.25, 5), (0.5, 0.5, 0.5, 3)]  # fractions stay apart
    bins = common.merged_levels([(y, 1000 if y == 0 else 1) for y in range(101)], 10)
    assert len(bins) == 10 and bins[0] == (0, 0, 0, 1000) and bins[-1][1] == 100 and sum(n for *_, n in bins) == 1100
    assert all(a[1] + 1 == b[0] and a[2] < b[2] for a, b in zip(bins, bins[1:]))
    rows = [(i, " ".join(["good" if j < i % 101 else "BAD!!" for j in range(100)])) for i in range(606)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 101) for i in range(606)], "doc_id long, quality int")
    model = quality_classifier.train(df, labels, "quality")
    assert len(model.grades) == 10 and model.grades[-1] > 85
    kept = {r["doc_id"] % 101 for r in quality_classifier.select_quality(df, model, model.grades[-1]).collect()}
    assert 100 in kept and min(kept) > 60


def test_alignment_takes_whole_pages():
    def naive(wrapper, page):
        n, m = len(wrapper), len(page)
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if wrapper[i] == page[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < n or j < m:
            if i < n and j < m and wrapper[i] == page[j]:
                yield "both"
                i, j = i + 1, j + 1
            elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
                yield "a"
                i += 1
            else:
                yield "b"
                j += 1

    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 40))] for _ in "ab")
        assert list(html_extract._skips(a, b)) == list(naive(a, b))
    page = "<body>" + "".join(f"<h{i % 5 + 1}>x{i}</h{i % 5 + 1}>" for i in range(900)) + "<footer>end</footer>"
    wrapper = html_extract.infer([html_extract.shape(html_extract.Page(p)) for p in (page, page.replace("x0", "y"))])
    leaves = wrapper.items[0].items[0].leaves
    assert len(leaves) == 900 and leaves[0][3] is None and all(x[3] for x in leaves[1:])


def test_html_whole_hosts(spark):
    links = '<ul><li><a href="/">see this other page over there</a></li><li><a href="/">and that one as well my friend</a></li></ul>'
    lines = lambda k: "".join(f"<p>line {k} {i}</p>" for i in range(450))
    rows = [(k, f"http://a.example/{k}", f"<body><article><p>Page {k} says</p>{links}" + ("<ul><li>own point</li></ul>" if k < 3 else "") + "</article></body>") for k in range(9)]
    rows += [(100 + k, f"http://b.example/{k}", f'<body><article>{lines(k)}<div class="box">The same box</div><div class="own">box of {k}</div></article></body>') for k in range(12)]
    rows += [(200 + k, f"http://c.example/{k}", '<body><article><div class="box">Copies of one page</div></article></body>') for k in range(4)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(9):
        assert got[k] == f"Page {k} says" + "\nown point" * (k < 3)  # a link list is one page's, not every ul's of the host
    for k in range(12):
        assert got[100 + k] == "\n".join([*(f"line {k} {i}" for i in range(450)), f"box of {k}"])
    assert {got[200 + k] for k in range(4)} == {"Copies of one page"}
    only = '<body><article><ul><li><a href="/">one link</a></li></ul></article></body>'
    assert html_extract.extract(only, None) == "one link"


def test_functions_of_whole_texts(spark):
    body = 'def no(): { "open\nint g() { /* ; }\r`more\n\n\'é last'
    df = spark.createDataFrame([(i, body) for i in range(6)] + [(6, None)], "doc_id long, text string")
    rows = df.select("doc_id", *catalog._commented_code("doc_id", "text")).collect()
    assert len({r["language"] for r in rows}) == 6
    for r in rows:
        above = r["code"].split("\n")[: 1 if r["doc_id"] == 6 else 4]
        assert [x.split(" ", 1)[1] for x in above] == ([""] if r["doc_id"] == 6 else body.replace("\r", " ").split("\n"))
        begin = len("\n".join(above).encode()) + 1
        got = syntax.functions(r["code"], r["language"])
        assert got == [(f"f{r['doc_id']}", len(above), len(above) + 2, begin, len(r["code"].encode()) - 1)], r["language"]


def test_several_and_nested_functions():
    lines = ["plain", "with } and {", 'a "quote', "é ü", "// # /*"]
    python, c, want_python, want_c = "", "", [], []
    for k, x in enumerate(lines):
        outer = f"def f{k}():\n    # {x}\n    def g{k}():\n        return {k}\n    return g{k}"
        at = len(python.encode())
        inner = at + len(f"def f{k}():\n    # {x}\n    ".encode())
        want_python += [(f"f{k}", 5 * k, 5 * k + 5, at, at + len(outer.encode())), (f"g{k}", 5 * k + 2, 5 * k + 4, inner, inner + len(f"def g{k}():\n        return {k}"))]
        python += outer + "\n"
        one = f"func h{k}() int {{\n    // {x}\n    return {k}\n}}"
        want_c.append((f"h{k}", 4 * k, 4 * k + 4, len(c.encode()), len((c + one).encode())))
        c += one + "\n"
    assert syntax.functions(python, "python") == want_python
    assert syntax.functions(c, "go") == want_c
