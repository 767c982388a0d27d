"""Toxicity grammar and quality classifier: their methods' parts, held-out accuracy, and cases."""

import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from haystrata.llm import quality_classifier as Q
from haystrata.llm import toxicity as T

DATA = "/root/testdata/sf0.01"


def brute_events(text, grammar):
    """(insult or threat, marks) of each event, word by word, with clauses from a split."""
    out = Counter()
    for clause in re.split(r"[.!?;:\n]", (text or "").lower()):
        words = re.findall(r"[^\W_]+(?:['’][^\W_]+)*", clause)
        kind = []
        for w in words:
            best = max([(grammar.insults[s], 1) for s in grammar.insults if w.startswith(s)] + ([(grammar.threats[w], 0)] if w in grammar.threats else []), default=None)
            kind.append(("I", best[0]) if best and best[1] else ("T", best[0]) if best else ("Y", 0) if w in T.TARGETS else ("N", 0) if w in T.NEGATIONS or w.endswith("n't") else ("R", 0) if w in T.REPORTS else ("O", 0))
        near = lambda i, k, n, step: any(0 <= i + step * d < len(kind) and kind[i + step * d][0] == k for d in range(1, n))
        for i, (k, w) in enumerate(kind):
            if k in "IT":
                marks = 1 * (near(i, "Y", 4, -1) or near(i, "Y", 4, 1)) + 2 * near(i, "N", 3, -1) + 4 * near(i, "R", 6, -1)
                out[(0 if k == "I" else 8) + marks] += w
    return out


def test_composed_transducers_equal_brute_force():
    rng = random.Random(3)
    g = T.Grammar()
    vocabulary = ["you", "he", "not", "said", "idiot", "idiots", "kill", "kills", "moron", "tree", "runs", "isn't", "nonidiot", "the", "a"]
    for _ in range(3000):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", " ", ". ", "\n", ", ", "; "]) for _ in range(rng.randint(0, 25)))
        got = np.sum([np.zeros(16), *g.events(text)], axis=0)
        want = brute_events(text, g)
        assert {i: round(x, 6) for i, x in enumerate(got) if x} == {i: round(x, 6) for i, x in want.items()}, text
    assert len(T.FORWARD.arcs) > 50  # the composed table: pairs of states of all its parts
    assert T.factors(T.FACTOR)[8] == 0 and T.factors(T.FACTOR)[9] == 1.5  # a threat without a target is not written


RAW = [T.OTHER, *T.CONTEXT.values(), T.INSULT, T.THREAT]


def strings(most):
    import itertools

    return (list(x) for n in range(most + 1) for x in itertools.product(RAW, repeat=n))


def test_composition_reads_what_the_first_writes():
    """Every string of up to six symbols: one composed table writes, at the same weight, what the machines write one after another."""
    weights = {"target": 1.5, "negation": 0.25, "report": 0.5}
    parts = [T.reach(k, T.REACH[k], weights[k]) for k in T.MARK] + [T.insult(), T.threat()]
    whole = T.compose(T.marker(weights), T.JUDGE)
    for symbols in strings(6):
        read, total = symbols, [1.0] * len(symbols)
        for t in parts:
            got = T.run(t, read)
            read, total = [x for x, _ in got], [u * v for u, (_, v) in zip(total, got)]
        assert T.run(whole, symbols) == list(zip(read, total)), symbols


def test_verdicts_depend_on_what_was_written_before():
    """Every string of up to six symbols: with a target transducer before it threat() finds exactly the threats near a target, alone none; in the other order nothing is marked."""
    target = T.reach("target", 2)
    both, alone, turned = T.compose(target, T.threat()), T.threat(), T.compose(T.threat(), target)
    differ = 0
    for symbols in strings(6):
        near = [x == T.THREAT and T.CONTEXT["target"] in symbols[max(0, i - 1) : i] for i, x in enumerate(symbols)]
        hits = [x == T.HIT for x, _ in T.run(both, symbols)]
        assert hits == near and not any(x == T.HIT for t in (alone, turned) for x, _ in T.run(t, symbols)), symbols
        differ += any(hits)
    assert differ > 5000


def test_weighted_machine_equals_the_sums_by_marks():
    rng = random.Random(4)
    g = T.Grammar(marks={"target": 1.7, "negation": 0.2, "report": 0.6})
    words = ["you", "not", "said", "idiot", "kill", "moron", "tree", "the", "isn't", "."]
    for _ in range(1500):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))
        want = [x for e in g.events(text) if (x := float(e @ T.factors(g.marks))) > 0]
        assert np.allclose(g.clauses(text), want), text


def test_clauses_of_any_length_follow_one_rule():
    g = T.Grammar()
    short = g.clauses("she did not. idiot x x")
    for n in (10, 2000, 3000, 50_000):
        assert g.clauses("she did not. idiot" + " x" * n) == short
        assert g.clauses("x " * n + "not an idiot") == g.clauses("not an idiot")
    times = []
    for n in (20_000, 80_000):
        for text in ("you idiot. " * n, "you idiot " * n, "idiot" + " " * 10 * n, "." * 10 * n + "idiot"):
            began = time.process_time()
            g.events(text)
            times.append(time.process_time() - began)
    assert all(b < 8 * a + 0.5 for a, b in zip(times[:4], times[4:]))


def spoken(rng, n):
    """(text, toxic): insults count against someone unless negated; quoted ones do not. Half of the rows are told apart by that alone."""
    fill = "river stone quiet lamp garden winter paper train window cloud bread silver market letter bridge".split()
    rows = []
    for _ in range(n):
        words = lambda k: " ".join(rng.choice(fill) for _ in range(k))
        ins = rng.choice(["idiot", "moron", "clown", "loser"])
        text, y = rng.choice([(f"you are an {ins}", 1), (f"you {ins}", 1), (f"you are not an {ins}", 0), (f"he is never a {ins}", 0), (f"they said the word {ins} aloud", 0), (f"one quoted {ins} there", 0)])
        rows.append((f"{words(rng.randint(8, 15))}. {text}. {words(rng.randint(8, 15))}.", y))
    return rows


def test_negation_and_report_decide(spark):
    rows = spoken(random.Random(8), 900)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    g = T.train(docs, labels)
    assert g.marks["negation"] < 0.3 and g.marks["report"] < 0.4
    got = {r["doc_id"]: r for r in T.score_toxicity(docs, g).collect()}
    held = [i for i in got if got[i]["held_out"]]
    right = np.mean([got[i]["predicted"] == rows[i][1] for i in held])
    assert len(held) > 200 and right > 0.95, (right, g.marks, g.logit)
    flat = T.Grammar(g.insults, g.threats, {k: 1.0 for k in g.marks}, g.logit)
    assert np.mean([int(flat.score(rows[i][0]) >= T.PREDICT_AT) == rows[i][1] for i in held]) < 0.7


def test_toxicity_cases(spark):
    rows = [(1, "you idiot"), (1, "you idiot"), (2, None), (3, ""), (None, "you idiot"), (4, "x" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("a").alias("y"), F.lit(1).alias("held_out"), F.lit(2).alias("stem"))
    got = Counter((r["doc_id"], round(r["score"], 6), r["predicted"]) for r in T.score_toxicity(df, T.Grammar()).collect())
    high, low = T.Grammar().score("you idiot"), T.Grammar().score("")
    assert got == Counter({(1, round(high, 6), int(high >= 0.7)): 2, (None, round(high, 6), int(high >= 0.7)): 1, (2, round(low, 6), 0): 1, (3, round(low, 6), 0): 1, (4, round(low, 6), 0): 1})
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (None, 1), (3, 0)], "doc_id long, toxic int")
    assert set(T.train(df, labels).marks) == set(T.FACTOR)


def test_grades_of_four_levels_held_out(spark):
    rng = random.Random(5)
    words = "river stone quiet lamp garden winter paper train window cloud bread silver market letter bridge".split()
    rows, labels = [], []
    for i in range(1200):
        y = i % 4
        rows.append((i, " ".join("zorg###" if rng.random() < (0.6, 0.35, 0.15, 0.0)[y] else rng.choice(words) for _ in range(rng.randint(40, 90)))))
        labels.append((i, y + 0.5))
    df, ratings = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, stars double")
    m = Q.train(df, ratings, "stars", where="doc_id % 3 <> 1")
    assert m.grades == [0.5, 1.5, 2.5, 3.5] and (np.diff(m.cuts) > 0).all()
    got = {r["doc_id"]: r for r in Q.grade(df, m, 2.5).where("doc_id % 3 = 1").collect()}
    off = np.mean([abs(r["expected_grade"] - (i % 4 + 0.5)) for i, r in got.items()])
    assert off < 0.35 and np.mean([r["selected"] == (i % 4 >= 2) for i, r in got.items()]) > 0.9
    assert any(abs(r["expected_grade"] - r["tail_probability"]) > 0.5 for r in got.values())


@pytest.mark.skipif(not __import__("os").path.isdir(DATA), reason="no tables")
def test_quality_and_toxicity_held_out_on_the_tables(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    m = Q.train(docs, labels, where=~T.held_out("doc_id"))
    assert len(m.grades) == 3
    rows = Q.grade(docs, m).join(labels, "doc_id").where(T.held_out("doc_id")).collect()
    assert np.mean([r["selected"] == (r["quality"] == 1) for r in rows]) > 0.97
    g = T.train(docs, labels)
    rows = T.score_toxicity(docs, g).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.95


def test_quality_cases(spark):
    rows = [(1, "fine words"), (1, "fine words"), (2, None), (3, ""), (None, "x ###"), (4, "x " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("a").alias("y"), F.lit(1).alias("selected"), F.lit(2).alias("x"))
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 1), (2, 0, 0), (None, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    m = Q.train(df, labels)
    assert m.grades == [0, 1, 2]
    got = Q.grade(df, m).collect()
    assert len(got) == 6 and len({(r["doc_id"], r["expected_grade"]) for r in got if r["doc_id"] == 1}) == 1
    kept = Q.select_quality(df, m)
    assert kept.columns == df.columns and kept.count() == sum(r["selected"] for r in got)
    one = Q.train(df, labels.where("quality = 1 and toxic = 1"))
    assert len(one.grades) == 1 and all(r["selected"] for r in Q.grade(df, one).collect())
    assert Q.select_quality(df, Q.train(df, labels.where("false"))).count() == 6
    assert Q.grade(df.where("false"), m).count() == 0
