import io
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorlake.scratch import scratch_path
from sensorlake.sources import bags
from sensorlake.sources.points import WIRE, decode_points

SCHEMA = "bag string, topic string, type string, ts_ns long, payload binary"
MESSAGES = [(f"b{b}", topic, f"type/{topic[1:]}", 10**9 * i + 7 * b, bytes([b, i % 256]) * (20 + i % 5))
            for b in range(3) for i in range(300) for topic in ("/points", "/image")]


@pytest.fixture(scope="module")
def folders(spark):
    out = {}
    for kind in ("none", "bz2", "lz4"):
        out[kind] = scratch_path(spark, f"bags-{kind}")
        bags.write_bags(spark.createDataFrame(MESSAGES, SCHEMA), out[kind], kind, 2000)
    return out


def rows(df):
    return sorted((os.path.basename(r["bag"])[:-4], r["topic"], r["type"], r["ts_ns"], bytes(r["payload"])) for r in df.collect())


@pytest.mark.parametrize("kind", ["none", "bz2", "lz4"])
def test_written_bags_are_read_back(spark, folders, kind):
    got = bags.read_bags(spark, folders[kind], partitionBytes=5000)
    assert rows(got) == sorted(MESSAGES) and got.rdd.getNumPartitions() > (20 if kind == "none" else 2)
    assert got.where("ts <> ts_ns / 1e9").isEmpty()


def test_one_bag_several_paths_and_unknown_ones(spark, folders):
    one = f"{folders['none']}/b1.bag"
    assert rows(bags.read_bags(spark, one)) == sorted(m for m in MESSAGES if m[0] == "b1")
    assert bags.read_bags(spark, f"{one},{folders['none']}/b2.bag").count() == 1200
    assert bags.read_bags(spark, folders["none"], pattern="b2*").count() == 600
    with pytest.raises(Exception, match="nowhere"):
        bags.read_bags(spark, "/tmp/nowhere.bag").count()


def test_filters_choose_connections_chunks_and_messages(spark, folders):
    df = bags.read_bags(spark, folders["none"])
    some = df.where("topic = '/points' AND ts_ns BETWEEN 100000000000 AND 120000000000")
    want = sorted(m for m in MESSAGES if m[1] == "/points" and 100 * 10**9 <= m[3] <= 120 * 10**9)
    assert rows(some) == want
    assert rows(df.where("ts > 100.0 AND ts < 120.0 AND type IN ('type/image', 'x')")) == sorted(m for m in MESSAGES if m[1] == "/image" and 100 < m[3] / 1e9 < 120)
    assert rows(df.where("topic = '/points' AND topic = '/image'")) == [] == rows(df.where("topic = 'none'"))
    assert rows(df.where("topic LIKE '/po%' AND ts_ns < 5")) == sorted(m for m in MESSAGES if m[1] == "/points" and m[3] < 5)
    # counted: chunks that are not wanted are skipped, and the scan gives only wanted messages
    assert "Filter (" not in some._jdf.queryExecution().executedPlan().toString()  # nothing is left for Spark to filter by
    index = bags.read_index(f"{folders['none'].removeprefix('file:')}/b1.bag")
    wanted = bags.Wanted(low=100 * 10**9, high=120 * 10**9)
    assert 1 < len(wanted.chunks(index)) < len(index.chunks) / 5
    assert bags.Wanted(names={"bag": None, "topic": frozenset(["none"]), "type": None}).chunks(index) == []
    seen = {r["chunk"] for r in some.where(F.col("bag").endswith("b1.bag")).collect()}
    assert seen <= {at for at, _ in wanted.chunks(index)}


def test_reading_touches_only_the_wanted_chunks(folders, monkeypatch):
    reader = bags.BagReader([folders["none"]], "*.bag", 1 << 20)
    reader.wanted = bags.Wanted(low=100 * 10**9, high=101 * 10**9)
    read = []
    monkeypatch.setattr(bags, "chunk_messages", lambda bag, at, *rest: read.append(at) or iter(()))
    spans = reader.partitions()
    assert [list(reader.read(s)) for s in spans] == [[]] * 3
    assert 3 <= len(read) <= 6 and sum(len(bags.read_index(s.path).chunks) for s in spans) > 60


def test_a_chunk_without_index_records_is_walked_through(tmp_path):
    for indexed in (True, False):
        path = str(tmp_path / f"{indexed}.bag")
        body = io.BytesIO()
        writer = bags.BagWriter(body, "lz4", 300, indexed)
        for i in range(40):
            writer.add(f"/t{i % 3}", "k", 5 * 10**9 + i, b"x" * i)
        head = writer.close()
        data = bags.MAGIC + head + body.getvalue()[len(bags.MAGIC) + len(head):]
        assert len(bags.MAGIC + head) == 13 + bags.HEADER_SIZE
        open(path, "wb").write(data)
        reader = bags.BagReader([path], "*.bag", 400)
        reader.wanted = bags.Wanted(names={"bag": None, "topic": frozenset(["/t1"]), "type": None}, high=5 * 10**9 + 30)
        got = [r for s in reader.partitions() for b in reader.read(s) for r in b.to_pylist()]
        assert [(r["ts_ns"] - 5 * 10**9, len(r["payload"])) for r in got] == [(i, i) for i in range(1, 31, 3)]


def test_damaged_files_are_errors(tmp_path, folders):
    whole = open(f"{folders['none'].removeprefix('file:')}/b0.bag", "rb").read()
    for data, told in ((b"#ROSBAG V1.2\n", "format 2.0"), (whole[:5000].replace(b"index_pos=" + whole.split(b"index_pos=")[1][:8], b"index_pos=" + bytes(8)), "no index"),
                       (whole[:-3], "cut short")):
        path = tmp_path / "x.bag"
        path.write_bytes(data)
        with pytest.raises(ValueError, match=told):
            bags.read_index(str(path))
    with pytest.raises(ValueError, match="compression"):
        bags.unpacked(b"zip", b"", 0)


def test_empty_tables_and_empty_bags(spark, tmp_path):
    folder = str(tmp_path / "none")
    bags.write_bags(spark.createDataFrame([], SCHEMA), folder)
    os.makedirs(folder, exist_ok=True)
    assert bags.read_bags(spark, folder).collect() == []
    body = io.BytesIO()
    head = bags.BagWriter(body).close()
    (tmp_path / "none/empty.bag").write_bytes(bags.MAGIC + head)
    assert bags.read_bags(spark, folder).collect() == []


def test_points_of_bags(spark):
    def payload(i):
        p = np.zeros(i % 4, dtype=WIRE)
        p["x"], p["z"] = i, 0.5
        return struct.pack("<III", i, 1, 2) + struct.pack("<I", 3) + b"fid" + struct.pack("<QI", 0, len(p)) + bytes(4) + p.tobytes()

    messages = [("r", "/points", "cloud", 10**9 * i, payload(i)) for i in range(200)]
    folder = bags.bag_scratch(spark, spark.createDataFrame(messages, SCHEMA), chunk_bytes=1500)
    framed = bags.frames(bags.read_bags(spark, folder).where("topic = '/points' AND ts_ns >= 50000000000"))
    got = decode_points(framed).select("frame_index", "ts", "point_index", "x", "z").collect()
    assert sorted(tuple(r) for r in got) == [(i - 50, float(i), k, float(i), 0.5) for i in range(50, 200) for k in range(i % 4)]
