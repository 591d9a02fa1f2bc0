import gzip
import hashlib
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from sensorlake.llm import warc
from sensorlake.scratch import scratch_path

SCHEMA = "page_id long, url string, html string"


def pages(spark, rows, more=""):
    return spark.createDataFrame(rows, SCHEMA + more)


def round_trip(spark, df, payload=True):
    path = scratch_path(spark, "archives")
    warc.write_archives(df, path, "page_id", "url", "html")
    return path, warc.read_archives(spark, path, payload=payload)


def brute(rows):
    largest = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 1000:
            largest[html] = max(largest.get(html, i), i)
    out = []
    for i, _, html in rows:
        data, original = (html or "").encode(), largest.get(html)
        again = original is not None and i != original
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", original if again else None))
    return sorted(out, key=repr)


def summary(found):
    number = lambda c: F.regexp_extract(c, r"record:(-?\d+)", 1).cast("long")
    rows = found.select(number("record_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"), "gap").collect()
    assert all(r["gap"] is None for r in rows)
    return sorted((tuple(r)[:5] for r in rows), key=repr)


ROWS = [(1, "http://a.b/c d\r\ne", "é" * 500), (2, None, "é" * 500), (3, "u", "é" * 499), (4, "u", "é" * 499), (5, "u", None), (6, "u", ""), (None, "u", "é" * 500),
        (None, None, "y" * 2000), (7, "u", "z" * 3_000_000), (7, "u", "z" * 3_000_000), (8, "u", "z" * 3_000_000), (9, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 30),
        (10, "u", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 30), (11, "u", "\n\x00\r\x1f")]


def test_equals_brute_force_with_nulls_ties_long_texts_and_clashing_columns(spark):
    clash = [(*r, "p", 1, "b") for r in ROWS]
    _, found = round_trip(spark, pages(spark, clash, ", p_payload string, id int, block string"))
    assert summary(found) == brute(ROWS)
    kept = {(r["record_id"], r["payload"].decode()) for r in found.where("record_type = 'response'").collect()}
    assert ("<urn:record:2>", "é" * 500) in kept and ("<urn:record:8>", "z" * 3_000_000) in kept and ("<urn:record:9>", ROWS[11][2]) in kept
    assert found.where("record_id = '<urn:record:1>'").first()["target_uri"] == "http://a.b/c%20d%0D%0Ae"


def test_large_groups_of_copies_and_streamed_files(spark, monkeypatch):
    rows = [(i, f"u{i}", "x" * 1500 if i % 3 else f"{i} " * 300) for i in range(600)]
    monkeypatch.setattr(warc, "WHOLE_FILE", 10_000)
    _, found = round_trip(spark, pages(spark, rows), payload=False)
    assert summary(found) == brute(rows) and found.where("payload IS NOT NULL").isEmpty()


def test_an_empty_table_has_no_records(spark):
    assert round_trip(spark, pages(spark, []))[1].collect() == []


def record(i, body, extra=b"", digest=None):
    digest = digest or hashlib.sha1(body).hexdigest()
    return (b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:%d>\r\nWARC-Block-Digest: sha1:%s\r\n%sContent-Length: %d\r\n\r\n" % (i, digest.encode(), extra, len(body))
            + body + b"\r\n\r\n")


def read(data):
    rows = list(warc.salvage(io.BytesIO(data), len(data)))
    at = 0
    for r in rows:  # records and gaps cover the file
        assert r["offset"] == at
        at += r["length"]
    assert at == len(data)
    return [r.get("record_id", "").removeprefix("<urn:x:").rstrip(">") if not r["gap"] else "gap" for r in rows]


def test_salvage_of_plain_records():
    a, b, c = (record(i, b"%d" % i * 50) for i in range(3))
    assert read(a + b + c) == ["0", "1", "2"] and read(b"") == []
    assert read(b"noise" + a + b"noise\n" + b + c[:-3]) == ["gap", "0", "gap", "1", "gap"]
    assert read(a + b.replace(b"1111", b"1211") + c) == ["0", "gap", "2"]  # a digest fails, the frame holds
    assert read(a + b.replace(b"Length: 50", b"Length: 5000") + c) == ["0", "gap", "2"]
    assert read(a + b.replace(b"Length: 50", b"Length: 4") + c) == ["0", "gap", "2"]
    assert read(a + b.replace(b"Length: 50", b"Length: x") + c) == ["0", "gap", "2"]
    assert read(a + b[:100] + c) == ["0", "gap", "2"]
    inner = record(7, a)  # a record inside another one is its payload, damaged or not
    assert read(inner + c) == ["7", "2"] and read(inner.replace(b"0000", b"0100") + c) == ["gap", "2"]


def test_salvage_of_members():
    a, b, c = (gzip.compress(record(i, random.Random(i).randbytes(3000).hex().encode())) for i in range(3))
    assert read(a + b + c) == ["0", "1", "2"]
    for at in (5, 40, 1500, len(b) - 6):  # damage in the time (harmless), the data and the checksum of a member
        assert read(a + b[:at] + bytes([b[at] ^ 255]) + b[at + 1:] + c) == ["0", "1" if at == 5 else "gap", "2"]
    assert read(a + b[:900] + c + b[:10]) == ["0", "gap", "2", "gap"]
    assert read(a + record(5, b"plain") + c + gzip.compress(record(6, b"x", digest="0" * 40)) + b) == ["0", "5", "2", "gap", "1"]


def test_random_damage_loses_only_what_it_touches():
    rng = random.Random(3)
    for packed in (False, True):
        parts = [record(i, rng.randbytes(rng.randint(0, 400))) for i in range(40)]
        parts = [gzip.compress(p) for p in parts] if packed else parts
        for _ in range(20):
            hit = sorted(rng.sample(range(40), 4))
            data = b"".join(p if i not in hit else p[:len(p) // 3] + rng.randbytes(rng.randint(1, 60)) + p[len(p) // 2:] for i, p in enumerate(parts))
            got = read(data)
            assert {str(i) for i in range(40) if i not in hit} <= set(got) and "gap" in got


def test_damaged_archives_through_spark(spark):
    rows = [(i, "u", f"{i} " * 400) for i in range(60)]
    path, _ = round_trip(spark, pages(spark, rows).coalesce(1))
    folder = path.removeprefix("file:")
    name = next(f for f in os.listdir(folder) if f.startswith("part-"))
    data = open(f"{folder}/{name}", "rb").read()
    at = data.index(b"<urn:record:30>")
    os.remove(f"{folder}/.{name}.crc")
    open(f"{folder}/{name}", "wb").write(data[:at] + b"lost" + data[at + 900:])
    found = warc.read_archives(spark, path).collect()
    ids = {int(r["record_id"][12:-1]) for r in found if not r["gap"]}
    assert ids == set(range(60)) - {30} and [r["length"] > 0 for r in found if r["gap"]] == [True]


@pytest.mark.parametrize("size", [0, 3, 11])
def test_short_rubbish_is_a_gap(size):
    assert read(b"WARC/1.1\r\n\r\nzz"[:size]) == (["gap"] if size else [])
