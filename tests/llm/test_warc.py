"""WARC files as replicas: records and ranges from gzip members and plain files, and an audit of damaged ones."""

import gzip
import random
import time
import zlib

import pytest

from haystrata.llm import warc_fixity as W


def test_records_round_trip():
    rng = random.Random(1)
    for packed in (True, False):
        made = [(f"http://h/{i}", bytes(rng.randrange(256) for _ in range(rng.choice([0, 3, 500])))) for i in range(40)] + [("http://big", b"a\r\n\r\nWARC/1.1 b" * 40_000)]
        data = W.warc_bytes(made, packed)
        got = list(W.records_in(data))
        assert [(h["warc-target-uri"], p) for *_, h, p in got] == made
        assert got[0][0] == 0 and got[-1][1] == len(data) and all(x[1] == y[0] for x, y in zip(got, got[1:]))
        for a, b, *_, h, p in got:
            piece = gzip.decompress(data[a:b]) if packed else data[a:b]
            assert piece.endswith(p + b"\r\n\r\n") and h["content-length"] == str(len(p))
    assert list(W.records_in(b"")) == []
    began = time.process_time()
    assert len(list(W.records_in(W.warc_bytes([("u", b"x")] * 20_000)))) == 20_000
    assert time.process_time() - began < 30
    torn = W.warc_bytes([("a", b"1"), ("b", b"2" * 100)])[:-20]
    assert [h.get("warc-target-uri") for *_, h, _ in W.records_in(torn)] == ["a", None]


def test_audit_of_files(spark, tmp_path):
    rng = random.Random(2)
    records = {f"f{k}.warc.gz": [(f"http://h/{k}/{i}", rng.randbytes(rng.randint(1, 300))) for i in range(60)] for k in range(4)}
    for side in ("one", "two"):
        (tmp_path / side).mkdir()
        for name, rows in records.items():
            rows = list(rows)
            if side == "two" and name.startswith("f1"):
                del rows[20]
            if side == "two" and name.startswith("f2"):
                rows[5] = (rows[5][0], rows[5][1][:-1] + b"?")
            (tmp_path / side / name).write_bytes(W.warc_bytes(rows, name != "f3.warc.gz"))
    one, two = (W.read_warc(spark, str(tmp_path / side)) for side in ("one", "two"))
    assert one.count() == 240 and two.count() == 239
    same = W.compare(W.archived(one), W.archived(one))
    assert {r["status"] for r in same.collect()} == {"match"}
    found = W.compare(W.archived(one), W.archived(two), fan_out=4).where("status not in ('match', 'moved')").collect()
    assert sorted((r["id"], r["status"]) for r in found) == [(5, "altered"), (20, "missing")]


def test_files_of_one_name_in_several_folders_stay_apart(spark, tmp_path):
    for folder in ("a", "b/c"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "x.warc.gz").write_bytes(W.warc_bytes([(f"http://{folder}/{i}", b"p" * i) for i in range(5)]))
    for path in (str(tmp_path), f"file://{tmp_path}/", f"{tmp_path}/*"):
        rows = W.read_warc(spark, path).collect()
        names = {r["name"] for r in rows}
        assert len(rows) == 10 and len(names) == 2 and all(n.endswith("x.warc.gz") for n in names)
    one = W.archived(W.read_warc(spark, str(tmp_path)))
    assert one.select("file").distinct().count() == 2 and one.select("file", "id").distinct().count() == 10
    assert {r["name"] for r in W.read_warc(spark, str(tmp_path / "a" / "x.warc.gz")).collect()} == {"x.warc.gz"}


def whole_records(data):
    """records_in() with the whole file at hand."""
    out, packed, at = [], data[:2] == b"\x1f\x8b", 0
    parts = []
    while at < len(data):
        body = end = None
        if packed and data[at : at + 2] == b"\x1f\x8b":
            unpack = zlib.decompressobj(31)
            try:
                body = unpack.decompress(data[at:])
                end = len(data) - len(unpack.unused_data) if unpack.eof else None
            except zlib.error:
                end = None
        parts.append((at, end, body) if end is not None else (at, len(data), data[at:]))
        at = parts[-1][1]
    for a, b, body in parts:
        x = 0
        while x < len(body):
            head = body.find(b"\r\n\r\n", x)
            lines = body[x:head].decode("utf-8", "replace").split("\r\n") if head >= 0 else []
            h = {k.strip().lower(): v.strip() for k, _, v in (q.partition(":") for q in lines[1:])}
            n = h.get("content-length", "")
            good = bool(lines) and lines[0].startswith("WARC/") and n.isascii() and n.isdigit() and head + 4 + int(n) <= len(body)
            y = head + 4 + int(n) if good else len(body)
            payload = body[head + 4 : y] if good else body[x:]
            y += 4 * (body[y : y + 4] == b"\r\n\r\n")
            out.append((a, b, x, y, h if good else {}, payload) if packed else (a + x, a + y, a + x, a + y, h if good else {}, payload))
            x = y
    return out


@pytest.mark.parametrize("chunk", [1, 3, 64, 1 << 16])
def test_streams_equal_whole_files(monkeypatch, chunk):
    monkeypatch.setattr(W, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = [(f"http://h/{i}", rng.choice([b"", b"\r\n\r\n", b"WARC/1.0\r\n", rng.randbytes(rng.randint(0, 300))])) for i in range(12)]
    for packed in (True, False):
        data = W.warc_bytes(rows, packed)
        cases = [data, data[:-7], data + b"rest", data[:40], b"", b"\x1f", b"\x1f\x8b", data[: len(data) // 2] + b"?" + data[len(data) // 2 + 1 :], data.replace(b"Content-Length: 0", b"Content-Length: x", 1), W.warc_bytes(rows[:3], True) + W.warc_bytes(rows[3:6], False)]
        for case in cases:
            assert list(W.records_in(case)) == whole_records(case), (packed, len(case))


def test_a_task_holds_a_member_and_not_the_file():
    import resource

    big = W.warc_bytes([("http://h/0", b"x" * 1_000_000)])
    left = [400]

    def read(n):
        if not left[0]:
            return b""
        if not held[0]:
            left[0] -= 1
            held[0] = big
        out, held[0] = held[0][:n], held[0][n:]
        return out

    held = [b""]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert sum(1 for _ in W.records_of(read)) >= 399
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000  # kilobytes, of 400 MB unpacked
