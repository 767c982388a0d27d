"""Cases of every operator and stage: hot keys, lost records, clashing columns, nulls, empty tables, long texts; shared helpers."""

import random
import re
import string
import time
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from haystrata.llm import common, decontaminate, mixing, queries, quality_rules, secret_scan, simhash_vptree, warc_fixity

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def secrets_corpus(seed):
    rng = random.Random(seed)
    value = lambda k, c=string.ascii_letters + string.digits: "".join(rng.choice(c) for _ in range(k))
    made = [
        lambda: f"{rng.choice(['password', 'Token', 'API_KEY', 'secret', 'apikey', 'ſecret'])}{rng.choice([' = ', ':', chr(34) + ': ' + chr(34)])}{value(rng.randint(4, 20))}",
        lambda: "AKIA" + value(rng.randint(8, 20), string.ascii_uppercase + string.digits),
        lambda: value(rng.randint(28, 70), "0123456789abcdef"),
        lambda: f"-----BEGIN RSA PRIVATE KEY-----\n{value(40)}\n-----END RSA PRIVATE KEY-----",
        lambda: f"eyJ{value(12)}.{value(20)}.{value(16)}",
        lambda: f"{rng.choice(['ghp_', 'glpat-', 'xoxb-'])}{value(rng.randint(12, 24))}",
        lambda: f"ftp://user:{value(10)}@host",
        lambda: f"{rng.choice(['accessKey', 'private-key', 'Signing_KEY'])}: {value(rng.randint(12, 24))}",
    ]
    copied = [m() for m in made]
    rows = []
    for i in range(300):
        parts = ["word é " * rng.randint(0, 4)]
        for _ in range(rng.randint(0, 4)):
            parts += [rng.choice(copied) if rng.random() < 0.3 else rng.choice(made)(), rng.choice([" ", "\n", " é, "])]
        rows.append((i if i % 17 else None, None if i % 41 == 7 else "".join(parts), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "d", None])))
    return rows + rows[:5]


def test_secrets_equal_their_sql(spark, tmp_path):
    rows = secrets_corpus(2)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = queries.op1_secret_scan(spark, str(tmp_path))
    want = con.execute(queries.OP1_SQL)
    assert [x[0] for x in want.description] == got.columns
    rows = Counter(map(tuple, got.collect()))
    assert rows == Counter(want.fetchall())
    kinds = Counter(x.split(":")[0] for r in rows for x in r[5].split(",") if x)
    assert set(kinds) == {*secret_scan.BASE, *secret_scan.LOOSE}
    assert any(r[7] for r in rows) and any(r[6] for r in rows)


def test_secret_searches_are_linear():
    for text in ("eyJ" * 200_000, "eyJ" + "a" * 600_000, "password" * 60_000, "token " * 100_000, "-----BEGIN " * 50_000, "://a:" * 100_000, "AKIA" * 100_000, "ghp_" * 100_000, "x" * 10 + "key" * 100_000):
        began = time.process_time()
        secret_scan.base_spans(text)
        secret_scan.loose_spans(text)
        assert time.process_time() - began < 3, text[:12]


def test_alike_rows_spread_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 100)
    rows = [(None, "one two three", "en", "a", 0)] * 2500 + [(i, "w " * (i % 9), "en", "ab"[i % 2], 0) for i in range(300)] + [(7, "w " * 7, "en", "b", 0)] * 3
    df = spark.createDataFrame(rows, DDL).select("*", F.lit(1).alias("size"), F.lit(2).alias("copy"), F.lit(3).alias("rid"))
    got = mixing.mix_sources(df, bucket_rows=50, fan_in=4).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(t.split())) for i, t, *_ in rows)
    taken, most = Counter(), {}
    for r in got:
        taken[r["target"]] += r["taken"]
        most[r["target"]] = max(most.get(r["target"], 0), r["size"])
    assert all(abs(v - k) <= most[k] for k, v in taken.items())
    assert Counter(map(tuple, mixing.mix_sources(df.repartition(9), bucket_rows=50, fan_in=4).collect())) == Counter(map(tuple, got))


def test_a_record_lost_in_the_middle_is_located(spark):
    rows = [(i, f"http://h/{i}", "<p>" + "x" * (i % 50)) for i in range(100)] + [(50, "http://again", "y")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("seq"), F.lit("f").alias("file"))
    a = warc_fixity.archive(pages, 100)
    b = warc_fixity.archive(pages.where("page_id <> 10").withColumn("html", F.when(F.col("page_id") == 70, F.lit("other")).otherwise(F.col("html"))), 100)
    got = Counter((r["id"], r["status"]) for r in warc_fixity.compare(a, b, fan_out=4).collect())
    assert got[(10, "missing")] == 1 and got[(70, "altered")] == 1 and sum(got.values()) == 102
    assert all(s == ("match" if i < 10 else "moved") for i, s in got if i not in (10, 70))
    back = Counter(r["status"] for r in warc_fixity.compare(b, a, fan_out=4).collect())
    assert back["extra"] == 1 and back["altered"] == 1 and back["missing"] == 0


def test_hot_keys_join_the_same(spark):
    rows = spark.range(1000).selectExpr("if(id < 700, 1, id) k", "id v").withColumn("w", F.lit("x"))
    table = common.staged(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("most")))
    for bound in (1, 100, 10_000):
        got = common.join_counted(rows, table, "k", bound)
        assert got.columns == ["k", "v", "w", "most"]
        assert Counter(map(tuple, got.collect())) == Counter((1 if i < 700 else i, i, "x", 699 if i < 700 else i) for i in range(1000))


def test_components_of_hubs_and_chains(spark):
    rng = random.Random(1)
    edges = [(999, i) for i in range(60)] + [(1000 + i, 999) for i in range(60)] + [(2000 + i, 2001 + i) for i in range(12)] + [(rng.randint(3000, 3200), rng.randint(3000, 3200)) for _ in range(150)] + [(7, 7), (5000, 5000)]
    above = {}

    def root(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            above[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    rows = common.components(df, hot_rows=3).collect()  # most keys are hot; test_llm's are not
    assert Counter(map(tuple, rows)) == Counter((v, root(v)) for v in list(above))
    assert common.components(df.where("a < 0")).isEmpty()


def test_scratch_folder(spark, tmp_path, monkeypatch):
    staged = common.staged(spark.range(3))
    assert staged.count() == 3 and common.clear_staged(spark) >= 1

    class Cluster:
        master = "spark://h:7077"

        class _jsc:
            @staticmethod
            def sc():
                return type("Sc", (), {"getCheckpointDir": staticmethod(lambda: type("No", (), {"isDefined": staticmethod(lambda: False)}))})

    class Session:
        sparkContext = Cluster()

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.scratch(Session())
    Session.conf.get = staticmethod(lambda *a: "file:///shared/")
    assert common.scratch(Session()) == "file:///shared"
    wide = spark.range(10).withColumn("s", F.lit("x" * 100)).withColumn("a", F.array(F.lit(1)))
    assert common.fits(wide, limit=10 * (64 + 24 + 100 + 8)) and not common.fits(wide, limit=10 * (64 + 24 + 100 + 8) - 1) and common.fits(wide.where("false"), limit=0)


def test_packed_texts_equal_fresh_ones():
    rng = random.Random(1)
    texts = ["".join(rng.choice([" ", "a", "é", "\n", "B#", "!"]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    t = quality_rules.Texts(pa.array(texts, pa.large_string()))
    for _ in range(20):
        at = np.array(sorted(rng.sample(range(80), rng.randint(0, 80))), np.int64)
        x, y = t.take(at), quality_rules.Texts(pa.array([texts[i] for i in at], pa.large_string()))
        assert all((a == b).all() for a, b in ((x.data, y.data), (x.offs, y.offs), (x.starts, y.starts), (x.ends, y.ends), (x.first, y.first)))


def test_cascade_order_never_changes_a_verdict_and_long_texts_are_linear(spark):
    rng = random.Random(3)
    words = ["plain", "words", "### $", "WOW!!", "12", "a b", "ok\nok"]
    texts = [" ".join(rng.choice(words[: rng.randint(1, 7)]) + rng.choice(string.ascii_lowercase) for _ in range(rng.randint(40, 120))) for _ in range(300)]
    t = quality_rules.Texts(pa.array(texts, pa.large_string()))
    b = quality_rules.base(t)
    want = ~quality_rules.base_failed(b) & ~np.any([r.rejects(t, b) for r in quality_rules.RULES], axis=0)
    for _ in range(10):
        order = rng.sample(quality_rules.RULES, len(quality_rules.RULES))
        assert (quality_rules.cascade(t, b, order) == want).all()
    slow = quality_rules.Rule("slow", lambda t, b: time.sleep(0.01) or np.zeros(len(b["n_words"]), bool))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = quality_rules.order_rules(docs, [slow, *quality_rules.RULES])
    found = quality_rules.rates(t, b, [slow, *quality_rules.RULES])
    assert {r.name for r in wanted} == set(found) and found["slow"] == (found["slow"][0], 0) and found[wanted[0].name][1] > 0
    assert quality_rules.order_rules(docs.where("false")) == list(quality_rules.RULES)
    df = spark.createDataFrame([(1, "ab " * 400_000), (2, "a" * 1_000_000), (2, None), (None, "")], "doc_id long, text string").select("*", F.lit(1).alias("n_words"))
    got = sorted((r["doc_id"] or 0, r["n_words"], r["kept"]) for r in quality_rules.quality_rules(df).collect())
    assert got == [(0, 0, False), (1, 400_000, False), (2, 0, False), (2, 1, False)]


def test_sweep_and_trees_equal_brute_force():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base ^ sum(np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64) for _ in range(k)) for k in range(1, 6)]))
    key = np.sort(rng.integers(0, 6, len(fp)))
    near = lambda i, j: bin(int(fp[i] ^ fp[j])).count("1") <= 4
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if key[i] == key[j] and near(i, j)}
    got = {(min(i, j), max(i, j)) for a, b, _ in simhash_vptree.sweep(key, fp) for i, j in zip(a.tolist(), b.tolist())}
    assert got == want and len(want) > 20
    every, compared = simhash_vptree.pruned_share(key, fp)
    assert compared < every
    assert list(simhash_vptree.sweep(key[:0], fp[:0])) == []


STAGE_TABLES = {"labels": ("doc_id long, quality int, toxic int", [(1, 1, 0), (2, 0, 0), (2, None, 1), (None, 1, 0)]), "benchmark": ("item_id long, text string", [(1, "never seen words in here at all"), (2, None), (None, "")])}


@pytest.fixture(scope="module")
def stage_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("stages")
    for name, (ddl, rows) in STAGE_TABLES.items():
        spark.createDataFrame(rows, ddl).write.parquet(str(d / f"{name}.parquet"))
    return str(d)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_cases(spark, stage_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    prose = "river stone quiet lamp garden winter paper train window cloud bread silver market letter bridge".split()
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(prose) for _ in range(n))
    rows = [(i, text(60), "en", "a", 1) for i in range(8)] + [(None, None, None, None, None), (None, "", "en", None, 0), (3, text(60), "en", "a", 1), (9, text(30_000), "fr", "b", 1)]
    df = spark.createDataFrame(rows, DDL)
    clash = df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(("fp", "h", "size", "y", "kind", "__row", "rid", "n"))])
    out = stage(spark, clash, stage_dir)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == clash.columns
    got = common.staged(out).count()
    least = {"quality_classifier": 1, "simhash_near_dedup": 7}.get(name, len(rows))
    assert least <= got <= len(rows)
    assert stage(spark, df.where("false"), stage_dir).count() == 0


def test_decontamination_cases(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (1, "alpha beta gamma delta epsilon zeta"), (None, "ALPHA beta"), (3, None)], "item_id long, text string")
    rows = [(1, "x alpha beta gamma delta epsilon zeta y"), (1, "x alpha beta gamma delta epsilon zeta y"), (None, "alpha  BETA"), (2, None), (4, "w " * 300_000 + "alpha beta")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("item_id"), F.lit(2).alias("n_shared"), F.lit(3).alias("containment"))
    got = Counter((r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in decontaminate.contaminated(df, items).collect())
    assert got == Counter({(1, 1, 2, 2): 4, (1, None, 1, 1): 2, (None, None, 1, 1): 1, (4, None, 1, 1): 1})
    assert [r["doc_id"] for r in decontaminate.decontaminate(df, items).collect()] == [2]


def test_dedup_of_long_and_null_texts(spark):
    rows = [(i, "word " * 200_000) for i in (5, 3)] + [(None, None), (8, ""), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("component_id"), F.lit(2).alias("fp"), F.lit(3).alias("n"))
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash_vptree.near_duplicates(df).collect())
    assert got == Counter({(5, 3): 1, (3, 3): 1, (None, 2): 1, (8, 2): 1, (2, 2): 1})
    assert pd.Series([r["doc_id"] for r in simhash_vptree.one_of_each(df).collect()]).tolist() in ([3, 2], [2, 3])
    assert re.fullmatch("[0-9a-f]{16}", simhash_vptree.near_duplicates(df).first()["fingerprint"])


def test_working_names_of_other_columns_are_kept(spark):
    names = ["__hs_id", "__hs_row", "__HS_ROW_", "__hs_key", "__hs_n", "row", "fp", "best", "root"]
    rows = [(1, "same words in this text here"), (2, "same words in this text here"), (3, "quite another text with its own words"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    got = simhash_vptree.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in df.collect() if r["doc_id"] != 2)
    left = common.keep_ids(df, df.select("doc_id").where("doc_id = 3"), "left_anti")
    assert left.columns == df.columns and left.count() == 3


def test_the_pipeline_leaves_one_staged_copy(spark, tmp_path):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice("river stone quiet lamp garden winter paper train".split()) for _ in range(60))
    rows = [(i, text(), "en", "ab"[i % 2], 1) for i in range(12)]
    spark.createDataFrame(rows, DDL).write.parquet(str(tmp_path / "documents.parquet"))
    for name, (ddl, own) in STAGE_TABLES.items():
        spark.createDataFrame(own, ddl).write.parquet(str(tmp_path / f"{name}.parquet"))
    before = common.staged_paths(spark)
    out = corpus_pipeline.run(spark, str(tmp_path))
    during = [p for p in common.staged_paths(spark) if p not in before]
    whole = [p for p in during if "text" in spark.read.parquet(p).columns]
    assert out.count() > 0 and len(whole) == 1 and common.staged_paths(spark)[: len(before)] == before
    assert common.clear_staged(spark, len(before)) == len(during) and common.staged_paths(spark) == before
