"""Merkle manifest, token output and conversation repair against plain loops, SQL and their cases."""

import functools
import hashlib
import itertools
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from haystrata.llm import conversation_repair, merkle_manifest, rans, token_output

DDL = "doc_id long, source string, lang string, n_chars long, text string"
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def clashing(df):
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(("k", "pos", "n", "h", "leaf", "path", "above", "first", "part", "block", "i", "kind", "d1", "cost", "audit", "__hs_n", "__hs_b", "gone"))])


# --- Merkle manifest ---


def plain_leaf(r, altered):
    n = r[3]
    if altered and n is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
        n += 1
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[1], r[2], n, r[4])))


def plain_tree(hashes):
    """The root, and of each leaf the (own slot, sibling or '') pairs up to it."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for i, p in enumerate(at):
            paths[i].append((p & 1, hashes[p ^ 1] if p ^ 1 < len(hashes) else ""))
            at[i] = p >> 1
        hashes = [sha("".join(hashes[i : i + 2])) for i in range(0, len(hashes), 2)]
    return hashes[0], paths


def plain_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for g in langs:
        by[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r, False)))
        trees.append(plain_tree([plain_leaf(r, False) for r in by[g]]))
    root, tops = plain_tree([t for t, _ in trees]) if trees else ("", [])
    out = Counter()
    for g, (subroot, paths), top in zip(langs, trees, tops):
        for r, path in zip(by[g], paths):
            fold = plain_leaf(r, True)
            for slot, sibling in path + top:
                fold = sha(sibling + fold if slot else fold + sibling)
            out[(r[0], plain_leaf(r, False), subroot, root, sha("".join(s for _, s in path + top)), fold, fold == root)] += 1
    return out


def manifest_rows(seed, n):
    rng = random.Random(seed)
    rows = [(rng.choice([None, i, i]), rng.choice(["a", None]), rng.choice(["en"] * 5 + ["de", "é", "", None]), rng.choice([None, i]), rng.choice([None, "", "é\n" * (i % 9), f"t{i}"])) for i in range(n)]
    return rows + rows[:7] + [(5, "x", "lone", 1, "only one")] + [(3, "s", "en", 1, "w " * 100_000)]


@pytest.mark.parametrize("n", [0, 60, 300])
def test_manifest_equals_a_loop(spark, n):
    rows = manifest_rows(n, n)
    got = merkle_manifest.verify(clashing(spark.createDataFrame(rows, DDL)).repartition(5), found=merkle_manifest.tampered())
    assert Counter(map(tuple, got.collect())) == plain_manifest(rows)


def test_manifest_of_small_trees_and_empty_tables(spark):
    for rows in ([(1, "s", "en", 2, "x")], [(1, "s", "en", 2, "x"), (7, None, None, None, None)], [(i, "s", "en", 2, "x") for i in range(64)], [(i, "s", "en", 2, "x") for i in range(65)], [(i, "s", str(i), 2, "x") for i in range(70)]):
        got = merkle_manifest.verify(spark.createDataFrame(rows, DDL), found=merkle_manifest.tampered())
        assert Counter(map(tuple, got.collect())) == plain_manifest(rows)
    assert merkle_manifest.verify(spark.createDataFrame([], DDL)).count() == 0


def test_preimages_of_parents_hash_to_their_place_in_the_next(spark):
    rows = [(i, "s", "en" if i % 3 else "de", i, str(i)) for i in range(400)]
    m = merkle_manifest.build(spark.createDataFrame(rows, DDL))
    held = {(r["k"], r["level"], r["pos"]): r for r in m.parents().collect()}
    leaves = {(r["k"], r["pos"]): r["leaf"] for r in m.rows.collect()}
    ends = {r["k"]: (r["n"], r["subroot"]) for r in m.groups.collect()}
    for k, (n, subroot) in ends.items():
        level, width = 1, n
        while width > 1:
            below = lambda p: leaves[k, p] if level == 1 else held[k, level - 1, p]["hash"]  # noqa: E731, B023
            for p in range(-(-width // 2)):
                r = held[k, level, p]
                assert r["preimage"] == below(2 * p) + (below(2 * p + 1) if 2 * p + 1 < width else "") and r["hash"] == sha(r["preimage"])
            level, width = level + 1, -(-width // 2)
        assert held[k, level - 1, 0]["hash"] == subroot
    assert len(held) == sum(sum(-(-n // 2**j) for j in range(1, (n - 1).bit_length() + 1)) for n, _ in ends.values())


def test_groups_without_a_broadcast(spark, monkeypatch):
    rows = manifest_rows(4, 150)
    monkeypatch.setattr(merkle_manifest, "fits", lambda *a, **b: False)
    got = merkle_manifest.verify(spark.createDataFrame(rows, DDL), found=merkle_manifest.tampered())
    assert Counter(map(tuple, got.collect())) == plain_manifest(rows)


# --- token output ---


def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_rans_round_trip_and_size():
    rng = np.random.default_rng(1)
    blocks = [(rng.zipf(1.3, n) % 500).astype(np.uint32) for n in (0, 1, 63, 64, 65, 5000, 16384, 16385, 70_000)] + [np.zeros(40_000, np.uint32)]
    table = rans.Table.of(np.bincount(np.concatenate(blocks), minlength=500))
    assert table.frequencies.sum() == 1 << rans.BITS and (rans.Table.from_bytes(table.to_bytes()).frequencies == table.frequencies).all()
    packed = [rans.pack([1, None], np.array([len(b), 0]), b, c) for b, c in zip(blocks, rans.encode(blocks, table))]
    for (names, lengths, ids), b in zip(rans.unpack(packed, table), blocks):
        assert names == [1, None] and lengths.tolist() == [len(b), 0] and (ids == b).all()
    p = np.bincount(np.concatenate(blocks)) / sum(map(len, blocks))
    entropy = -np.sum(p[p > 0] * np.log2(p[p > 0])) * sum(map(len, blocks)) / 8
    assert sum(map(len, packed)) < 1.15 * entropy + len(blocks) * 1200
    with pytest.raises(ValueError, match="does not know"):
        rans.encode([np.array([499], np.uint32)], rans.Table.of(np.array([3, 1])))


@pytest.mark.parametrize("seed", range(4))
def test_frequencies_sum_up_for_any_counts(seed):
    rng = np.random.default_rng(seed)
    for counts in (rng.integers(0, 3, 100_000), np.r_[10**15, np.ones(50_000, int)], rng.zipf(1.1, 60_000) % 10**9, np.array([0, 7]), np.zeros(3, int), np.ones(1 << 19, int)):
        f = rans.Table.of(counts).frequencies
        assert f.sum() == 1 << rans.BITS and ((f > 0) | (counts == 0)).all()


def test_any_segment_decodes_alone_and_damage_is_found():
    rng = np.random.default_rng(2)
    ids = (rng.zipf(1.2, 60_000) % 3000).astype(np.uint32)
    table = rans.Table.of(np.bincount(ids))
    words, states, places = rans.encode([ids], table)[0]
    size = rans.STEPS * rans.LANES
    assert len(states) == len(places) == -(-len(ids) // size) > 2
    for k in reversed(range(len(states))):
        part = ids[k * size : (k + 1) * size]
        assert (rans.decode([(len(part), states[k], words, int(places[k]))], table)[0] == part).all()
    raw = rans.pack([1], np.array([len(ids)]), ids, (words, states, places))
    for at in (0, 9, 30, len(raw) // 2, len(raw) - 1):
        with pytest.raises(rans.Corrupt):
            rans.unpack([raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :]], table)
    with pytest.raises(rans.Corrupt):
        rans.unpack([raw[:20]], table)
    other = rans.Table.of(np.bincount(ids)[::-1].copy())
    with pytest.raises(rans.Corrupt):
        rans.unpack([raw], other)


ODD = ["", None, "a\0 a a\0\0 x", "I'll don't 'S Σας ΟΔΟΣ Σ İi ﬁ ́x \x1cy\x85z  é Å ª² ½ 日本語 \U0001f600\U0001f600", "x" * 5000 + " y", "<|endoftext|> # #", "﻿ a​b", "\x0b\x0c\r\n\t  ", "exactly16bytes!! exactly17bytes!!!"]


def test_words_encode_as_whole_texts():
    whole, words = (token_output.WordEncoder(tokenizer_path(), x) for x in (False, True))
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("aB é'\n\0.,!\t日ß́　sS9") for _ in range(rng.randint(0, 80))) for _ in range(500)]
    for part in (texts, texts[::-1], []):
        (a, n), (b, m) = (e.encode(pa.array(part, pa.large_string())) for e in (whole, words))
        assert a.tolist() == b.tolist() and n.tolist() == m.tolist()


def plain_tokens(rows):
    from tokenizers import Tokenizer

    t, at, out = Tokenizer.from_file(tokenizer_path()), 0, []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


@pytest.mark.parametrize("block, by_words", [(64, True), (1 << 15, True), (300, False)])
def test_token_files_round_trip(spark, tmp_path, monkeypatch, block, by_words):
    monkeypatch.setattr(token_output, "BLOCK_IDS", block)
    rng = random.Random(block)
    rows = [(i * 3 - 60, ODD[i % len(ODD)] if i % 3 else "word é " * rng.randint(0, 60)) for i in range(150)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    folder = f"file://{tmp_path}/t"
    manifest = token_output.write_tokens(df, folder, tokenizer_path(), 2, by_words)
    got = sorted(tuple(r) for r in token_output.read_tokens(spark, folder, with_ids=True).collect())
    assert got == plain_tokens(sorted(rows, key=lambda r: r[0]))
    files = {r["file"]: r for r in manifest.collect()}
    starts = sorted((r["file"], r["part"], r["block"]) for r in manifest.collect())
    assert starts == sorted(starts, key=lambda x: x[1:]) and set(files) == {f for f in os.listdir(tmp_path / "t") if f.endswith(".rans")}


def test_token_cases(spark, tmp_path):
    rows = [(None, "a b"), (None, None), (4, "same"), (4, "same"), (4, "other"), (-1, "w " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(token_output.encode_corpus(df, tokenizer_path(), 2, True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, -1, 4, 4, 4] and got[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in itertools.pairwise(got))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, n, c) for i, _, n, c, _ in plain_tokens(rows))
    assert token_output.encode_corpus(df.where("false"), tokenizer_path(), 2, True).count() == 0
    folder = f"file://{tmp_path}/hurt"
    name = token_output.write_tokens(df, folder, tokenizer_path(), 2, True).first()["file"]
    path = tmp_path / "hurt" / name
    raw = path.read_bytes()
    path.write_bytes(raw[:-1] + bytes([raw[-1] ^ 4]))
    with pytest.raises(Exception, match="damaged"):
        token_output.read_tokens(spark, folder).collect()


# --- conversation repair ---

LETTERS = set(" \t\n\x0b\x0c\r")


def plain_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        shown = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        out[conv] += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def plain_repair(rows, insert=5):
    """By exhaustive search with memory over (row, state), costs and edits together."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))

    @functools.cache
    def best(i, state, inserts):
        """(cost, edits, kept texts) from row i on in a state: '', s, u, a."""
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        step = "a" if state == "u" else "u"
        full = {"u": "user", "a": "assistant"}[step]
        if inserts < 3:
            c, e, k = best(i, step, inserts + 1)
            found.append((c + insert, "I" + e, ((full, ""), *k)))
        if i < len(rows):
            _, role, text = rows[i]
            c, e, k = best(i + 1, state, 0)
            found.append((c + 2, "D" + e, k))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                c, e, k = best(i + 1, step, 0)
                found.append((c + 1 + more, "R" + e, ((full, text), *k)))
                ini = role[:1]
                if (state, ini) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    c, e, k = best(i + 1, ini, 0)
                    found.append((c + more, "K" + e, ((role, text), *k)))
        return min(found, key=lambda x: x[:2], default=(10**9, "", ()))

    cost, edits, kept = best(0, "", 0)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return (gaps, *[faults.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, edits, sha("\n".join(f"{r}:{t}" for r, t in kept)))


def random_conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        start = rng.randint(0, 3)
        for turn in range(start, start + rng.choice([1, 2, 3, 5, 8, 12, 20])):
            role = ("user", "assistant")[(turn - start) % 2] if rng.random() < 0.7 else rng.choice(["user", "assistant", "system", "tool", "", None, "useful"])
            text = rng.choice(["Yes.", "No!", "cut off", "Why?  \n", " \t", "", None, f"own {turn}.", f"own {turn}", "é."])
            if rng.random() < 0.9:
                rows.append((conv if conv else None, turn if turn != 2 or conv % 5 else None, role, text))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_repair_equals_exhaustive_search(spark, monkeypatch, seed):
    monkeypatch.setattr(conversation_repair, "CHUNK_ROWS", [40, 1 << 17, 7][seed])
    monkeypatch.setattr(conversation_repair, "CELLS", [1 << 21, 64, 1 << 21][seed])
    rows = random_conversations(seed, 150)
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).repartition(6)
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.repair_conversations(conversation_repair.damaged(df)).collect()}
    assert got == {c: plain_repair(x) for c, x in plain_damage(rows).items()}
    assert {o for r in got.values() for o in r[6]} == set("DKR") and any(not r[6] for r in got.values())


@pytest.mark.parametrize("insert", [1, 2, 3])
def test_cheaper_inserts_equal_exhaustive_search(monkeypatch, insert):
    """At the contract's costs no insert is ever cheapest, so the machine is held against the search with others, too."""
    monkeypatch.setattr(conversation_repair, "INSERT", insert)
    convs = [rows for rows in plain_damage(random_conversations(insert, 300)).values()]
    convs = [sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)) for rows in convs]
    role, must, cut = [], [], []
    for rows in convs:
        seen = set()
        for _, r, t in rows:
            body = t.strip(" \t\n\x0b\x0c\r")
            must.append(not body or (r, t) in seen)
            cut.append(not must[-1] and body[-1] not in ".!?")
            role.append("sua".find(r[:1]) + 1 if r else 0)
            seen.add((r, t))
    cost, edits = conversation_repair.repair(np.array([len(x) for x in convs]), np.array(role, np.int8), np.array(must), np.array(cut))
    want = [plain_repair(x, insert) for x in convs]
    assert list(zip(cost.tolist(), edits)) == [w[5:7] for w in want]
    assert insert == 3 or any("I" in e for e in edits)


def test_repair_of_long_equal_and_empty_conversations(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(9000)] + [(2, t, "user", "again.") for t in range(3000)] + [(3, 0, "user", "w " * 200_000 + ".")] + [(c, t, r, "x.") for c in range(10, 200) for t, r in ((0, "user"), (1, "assistant"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in conversation_repair.repair_conversations(conversation_repair.damaged(df)).collect()}
    assert len(got) == 193 and len(got[1]["audit"]) > 8500 and got[2]["duplicate"] > 2500
    assert got[3]["audit"].count("K") + got[3]["audit"].count("I") >= 0
    clean = df.select("*", F.lit(False).alias("gone"))
    whole = {r["conv_id"]: r for r in conversation_repair.repair_conversations(clean).collect()}
    assert whole[1]["audit"] == "K" * 9000 and whole[1]["cost"] == 0 and whole[1]["repaired_sha256"] == sha("\n".join(f"{r}:{t}" for _, _, r, t in rows[:9000]))
    assert whole[2]["audit"] == "D" * 3000 and whole[2]["cost"] == 6000 and whole[2]["illegal"] == 2999
    assert whole[3]["audit"] == "D" and whole[3]["repaired_sha256"] == sha("")
    assert conversation_repair.repair_conversations(clean.where("false")).count() == 0
