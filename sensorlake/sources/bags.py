"""Bag files (format 2.0): a data source that reads messages by chunk index, and a writer.

    spark.dataSource.register(BagSource)
    spark.read.format("bag").load("/recordings").where("topic = '/points' AND ts_ns BETWEEN 1 AND 2")

Conditions on bag, topic, type, ts_ns and ts choose bags, connections and chunks from the index of each bag before a chunk
is read, with spark.sql.python.filterPushdown.enabled set (`read_bags` sets it).
"""

from __future__ import annotations

import bz2
import re
import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from sensorlake.operators.buckets import row_numbers
from sensorlake.scratch import scratch_path

#: Format (fixed values): first line, codes of records, size of the padded first record.
MAGIC = b"#ROSBAG V2.0\n"
MESSAGE, BAG_HEADER, INDEX, CHUNK, CHUNK_INFO, CONNECTION = 2, 3, 4, 5, 6, 7
HEADER_SIZE = 4096

SCHEMA = "bag string, topic string, type string, ts_ns long, ts double, chunk long, payload binary"
_ARROW = pa.schema([("bag", pa.string()), ("topic", pa.string()), ("type", pa.string()), ("ts_ns", pa.int64()), ("ts", pa.float64()), ("chunk", pa.int64()), ("payload", pa.binary())])
#: Bytes of payload in a batch of rows.
BATCH_BYTES = 8 << 20


def _u32(data: bytes) -> int:
    return int.from_bytes(data, "little")


def stamp_ns(data: bytes) -> int:
    seconds, nanoseconds = struct.unpack("<II", data)
    return seconds * 1_000_000_000 + nanoseconds


def fields_of(header: bytes) -> dict[str, bytes]:
    out, at = {}, 0
    while at < len(header):
        n = _u32(header[at:at + 4])
        name, equals, value = header[at + 4:at + 4 + n].partition(b"=")
        if not equals or len(header) < at + 4 + n:
            raise ValueError("a damaged record header in a bag")
        out[name.decode()] = value
        at += 4 + n
    return out


def records(data: bytes, at: int = 0) -> Iterator[tuple[dict[str, bytes], bytes, int]]:
    """(header fields, data, place) of the records that follow each other in data."""
    while at < len(data):
        start, n = at, _u32(data[at:at + 4])
        size = _u32(data[at + 4 + n:at + 8 + n])
        end = at + 8 + n + size
        if end > len(data):
            raise ValueError("a bag record is cut short")
        yield fields_of(data[at + 4:at + 4 + n]), data[at + 8 + n:end], start
        at = end


@dataclass(frozen=True)
class Chunk:
    at: int
    start_ns: int
    end_ns: int
    #: messages by connection
    counts: tuple[tuple[int, int], ...]


@dataclass(frozen=True)
class Bag:
    """A bag's index: (topic, type) by connection, and its chunks in file order with where the last one ends."""

    path: str
    connections: dict[int, tuple[str, str]]
    chunks: tuple[Chunk, ...]
    end: int


def opened(uri: str):
    """A seekable file, from whatever file system pyarrow knows by its URI."""
    system, name = _system(uri)
    return system.open_input_file(name)


def _system(uri: str):
    uri = re.sub(r"^file:/+", "file:///", uri)
    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri else (pyarrow.fs.LocalFileSystem(), uri)


def read_index(path: str) -> Bag:
    """Reads the first record and what follows the chunks, whatever the size of the bag."""
    with opened(path) as file:
        size = file.size()
        if file.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is no bag of format 2.0")
        n = _u32(file.read(4))
        head = fields_of(file.read(n))
        at = _u32(head["index_pos"][:4]) | _u32(head["index_pos"][4:]) << 32
        if head["op"][0] != BAG_HEADER or not 0 < at <= size:
            raise ValueError(f"{path} has no index: its recording was not ended")
        file.seek(at)
        rest = file.read(size - at)
    connections, chunks = {}, []
    for fields, data, _ in records(rest):
        if fields["op"][0] == CONNECTION:
            connections[_u32(fields["conn"])] = (fields["topic"].decode(), fields_of(data).get("type", b"").decode())
        elif fields["op"][0] == CHUNK_INFO:
            pairs = struct.unpack(f"<{2 * _u32(fields['count'])}I", data)
            chunks.append(Chunk(int.from_bytes(fields["chunk_pos"], "little"), stamp_ns(fields["start_time"]), stamp_ns(fields["end_time"]),
                                tuple(zip(pairs[::2], pairs[1::2], strict=True))))
    return Bag(path, connections, tuple(sorted(chunks, key=lambda c: c.at)), at)


def unpacked(compression: bytes, data: bytes, size: int) -> bytes:
    if compression == b"none":
        return data
    if compression == b"bz2":
        return bz2.decompress(data)
    if compression == b"lz4":
        return pa.Codec("lz4").decompress(data, decompressed_size=size).to_pybytes()
    raise ValueError(f"unknown chunk compression: {compression.decode()}")


def chunk_messages(bag: Bag, at: int, after: bytes, wanted: set[int], low: int, high: int) -> Iterator[tuple[int, int, bytes]]:
    """(connection, time, payload) of a chunk's wanted messages from low to high, in file order.

    `after` starts with the chunk and holds its index records, if the bag has any; they say where the messages lie, so others
    are not looked at.  A chunk without index records is walked through.
    """
    n = _u32(after[:4])
    fields, size = fields_of(after[4:4 + n]), _u32(after[4 + n:8 + n])
    if fields["op"][0] != CHUNK:
        raise ValueError(f"no chunk at {at} of {bag.path}")
    data = unpacked(fields["compression"], after[8 + n:8 + n + size], _u32(fields["size"]))
    places, indexed = [], False
    for head, body, _ in records(after, 8 + n + size):
        if head["op"][0] != INDEX:
            break
        indexed = True
        if (conn := _u32(head["conn"])) in wanted:
            entries = np.frombuffer(body, dtype="<u4", count=3 * _u32(head["count"])).reshape(-1, 3).astype(np.int64)
            times = entries[:, 0] * 1_000_000_000 + entries[:, 1]
            some = (times >= low) & (times <= high)
            places += [(int(o), int(t), conn) for o, t in zip(entries[some, 2], times[some], strict=True)]
    if not indexed:
        for head, _, place in records(data):
            if head["op"][0] == MESSAGE and (conn := _u32(head["conn"])) in wanted and low <= (t := stamp_ns(head["time"])) <= high:
                places.append((place, t, conn))
    for place, t, conn in sorted(places):
        n = _u32(data[place:place + 4])
        size = _u32(data[place + 4 + n:place + 8 + n])
        yield conn, t, data[place + 8 + n:place + 8 + n + size]


@dataclass(frozen=True)
class Wanted:
    """What the pushed filters leave: names (None: all) and times in nanoseconds, ends included."""

    names: dict[str, frozenset[str] | None] = field(default_factory=lambda: dict.fromkeys(("bag", "topic", "type")))
    low: int = -(1 << 63)
    high: int = (1 << 63) - 1

    def with_filter(self, f: Filter) -> Wanted | None:
        """Narrowed by a filter, or None if it is of another kind."""
        if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in self.names:
            some = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
            had = self.names[f.attribute[0]]
            return replace(self, names={**self.names, f.attribute[0]: some if had is None else had & some})
        if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("ts_ns",):
            v = int(f.value)
            low = v + 1 if isinstance(f, GreaterThan) else v if isinstance(f, (GreaterThanOrEqual, EqualTo)) else self.low
            high = v - 1 if isinstance(f, LessThan) else v if isinstance(f, (LessThanOrEqual, EqualTo)) else self.high
            return replace(self, low=max(self.low, low), high=min(self.high, high))
        return None

    def by_seconds(self, f: Filter) -> Wanted | None:
        """Narrowed by a filter on ts, a microsecond wider than it says because doubles are rounded; Spark applies it again."""
        if f.__class__ not in (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual) or f.attribute != ("ts",) or not abs(f.value) < 9e9:
            return None
        ns = int(f.value * 1e9)
        low = ns - 1000 if not isinstance(f, (LessThan, LessThanOrEqual)) else self.low
        high = ns + 1000 if not isinstance(f, (GreaterThan, GreaterThanOrEqual)) else self.high
        return replace(self, low=max(self.low, low), high=min(self.high, high))

    def connections(self, bag: Bag) -> set[int]:
        allowed = lambda kind, value: self.names[kind] is None or value in self.names[kind]
        return {c for c, (topic, kind) in bag.connections.items() if allowed("topic", topic) and allowed("type", kind)}

    def chunks(self, bag: Bag) -> list[tuple[int, int]]:
        """(begin, end) in the file of the chunks that may hold wanted messages."""
        some = self.connections(bag)
        ends = [*[c.at for c in bag.chunks], bag.end][1:]
        return [(c.at, end) for c, end in zip(bag.chunks, ends, strict=True)
                if c.end_ns >= self.low and c.start_ns <= self.high and any(n and conn in some for conn, n in c.counts)]


@dataclass
class Span(InputPartition):
    path: str
    chunks: tuple[tuple[int, int], ...]


class BagReader(DataSourceReader):
    def __init__(self, paths: list[str], pattern: str, partition_bytes: int):
        self.paths, self.pattern, self.partition_bytes, self.wanted = paths, pattern, partition_bytes, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, IsNotNull):  # no column is ever null
                continue
            if exact := self.wanted.with_filter(f):
                self.wanted = exact
            else:
                self.wanted = self.wanted.by_seconds(f) or self.wanted
                yield f

    def bags(self) -> list[str]:
        found = []
        for path in self.paths:
            system, name = _system(path)
            info = system.get_file_info(name)
            if info.type == pyarrow.fs.FileType.NotFound:
                raise FileNotFoundError(path)
            files = [info] if info.is_file else system.get_file_info(pyarrow.fs.FileSelector(name, recursive=True))
            scheme = re.match(r"(\w+://[^/]*)?", path)[0] if not path.startswith("file:") else ""
            found += [scheme + f.path if scheme and not f.path.startswith("/") else f.path for f in files
                      if f.is_file and (info.is_file or fnmatch(f.base_name, self.pattern))]
        names = self.wanted.names["bag"]
        return sorted(p for p in found if names is None or p in names)

    def partitions(self) -> list[Span]:
        """Runs of wanted chunks of about partition_bytes; the index of each bag is all that is read."""
        with ThreadPoolExecutor(16) as pool:
            bags = list(pool.map(read_index, self.bags()))
        out = []
        for bag in bags:
            held, size = [], 0
            for begin, end in self.wanted.chunks(bag):
                held.append((begin, end))
                size += end - begin
                if size >= self.partition_bytes:
                    out.append(Span(bag.path, tuple(held)))
                    held, size = [], 0
            if held:
                out.append(Span(bag.path, tuple(held)))
        return out or [Span("", ())]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if not span.chunks:
            return
        bag = read_index(span.path)
        wanted = self.wanted.connections(bag)
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            conn, ns, chunk, payload = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([
                pa.array([bag.path] * len(rows)), pa.array([bag.connections[c][0] for c in conn]), pa.array([bag.connections[c][1] for c in conn]),
                pa.array(ns, pa.int64()), pa.array(np.array(ns, dtype=np.int64) / 1e9), pa.array(chunk, pa.int64()), pa.array(payload, pa.binary())], schema=_ARROW)

        with opened(span.path) as file:
            for begin, end in span.chunks:
                file.seek(begin)
                for conn, ns, payload in chunk_messages(bag, begin, file.read(end - begin), wanted, self.wanted.low, self.wanted.high):
                    rows.append((conn, ns, begin, payload))
                    size += len(payload)
                    if size >= BATCH_BYTES:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


class BagSource(DataSource):
    """Options: path (a bag, a folder with bags at any depth, or several with commas), pattern (default *.bag) and
    partitionBytes (of chunks in a partition, default 128 MB)."""

    @classmethod
    def name(cls) -> str:
        return "bag"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BagReader:
        return BagReader([p for p in self.options["path"].split(",") if p], self.options.get("pattern", "*.bag"), int(self.options.get("partitionBytes", 128 << 20)))


def read_bags(spark: SparkSession, path: str, **options) -> DataFrame:
    """Messages (bag, topic, type, ts_ns, ts, chunk, payload) of the bags at path; chunk is the place of the message's chunk in
    its bag.  Filters are pushed down to chunks, connections and single messages."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BagSource)
    return spark.read.format("bag").options(**options).load(path)


def frames(messages: DataFrame) -> DataFrame:
    """messages with frame_index, the number of the message in its bag and topic by time, as decode_points takes them: the
    messages of earlier chunks are counted first, so that no task numbers a whole bag."""
    return row_numbers(messages, ["bag", "topic"], "ts_ns", ["ts_ns", "chunk", "payload"], width=60 * 1_000_000_000).withColumn(
        "frame_index", F.col("nth") - 1).drop("nth")


# Writing


def _field(name: bytes, value: bytes) -> bytes:
    return struct.pack("<I", len(name) + 1 + len(value)) + name + b"=" + value


def _record(op: int, fields: list[tuple[bytes, bytes]], data: bytes = b"") -> bytes:
    head = b"".join(_field(k, v) for k, v in [(b"op", bytes([op])), *fields])
    return struct.pack("<I", len(head)) + head + struct.pack("<I", len(data)) + data


def _time(ns: int) -> bytes:
    return struct.pack("<II", *divmod(ns, 1_000_000_000))


class BagWriter:
    """Writes messages in the order in which they come, in chunks of about chunk_bytes; holds one chunk and the index."""

    def __init__(self, file, compression: str = "none", chunk_bytes: int = 768 << 10, indexed: bool = True):
        self.file, self.compression, self.chunk_bytes, self.indexed = file, compression, chunk_bytes, indexed
        self.at, self.connections, self.infos, self.data, self.entries = 0, {}, [], bytearray(), {}
        self._put(MAGIC + self._head(0, 0, 0))

    def _head(self, index: int, connections: int, chunks: int) -> bytes:
        fields = [(b"index_pos", struct.pack("<Q", index)), (b"conn_count", struct.pack("<I", connections)), (b"chunk_count", struct.pack("<I", chunks))]
        size = len(_record(BAG_HEADER, fields))
        return _record(BAG_HEADER, fields, b" " * (HEADER_SIZE - size))

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.at += len(data)

    def _connection(self, topic: str, kind: str) -> bytes:
        data = _field(b"topic", topic.encode()) + _field(b"type", kind.encode()) + _field(b"md5sum", b"*") + _field(b"message_definition", b"")
        return _record(CONNECTION, [(b"conn", struct.pack("<I", self.connections[topic, kind])), (b"topic", topic.encode())], data)

    def add(self, topic: str, kind: str, ns: int, payload: bytes) -> None:
        if (topic, kind) not in self.connections:
            self.connections[topic, kind] = len(self.connections)
            self.data += self._connection(topic, kind)
        conn = self.connections[topic, kind]
        self.entries.setdefault(conn, []).append((ns, len(self.data)))
        self.data += _record(MESSAGE, [(b"conn", struct.pack("<I", conn)), (b"time", _time(ns))], payload)
        if len(self.data) >= self.chunk_bytes:
            self.end_chunk()

    def end_chunk(self) -> None:
        if not self.entries:
            return
        times = [ns for entries in self.entries.values() for ns, _ in entries]
        self.infos.append((self.at, min(times), max(times), {c: len(e) for c, e in self.entries.items()}))
        raw = bytes(self.data)
        packed = {"none": lambda d: d, "bz2": bz2.compress, "lz4": lambda d: pa.Codec("lz4").compress(d).to_pybytes()}[self.compression](raw)
        self._put(_record(CHUNK, [(b"compression", self.compression.encode()), (b"size", struct.pack("<I", len(raw)))], packed))
        for conn, entries in self.entries.items() if self.indexed else ():
            body = b"".join(_time(ns) + struct.pack("<I", place) for ns, place in entries)
            self._put(_record(INDEX, [(b"ver", struct.pack("<I", 1)), (b"conn", struct.pack("<I", conn)), (b"count", struct.pack("<I", len(entries)))], body))
        self.data, self.entries = bytearray(), {}

    def close(self) -> bytes:
        """Ends the bag; returns the first record as it has to be, for the place after MAGIC."""
        self.end_chunk()
        index = self.at
        for topic, kind in self.connections:
            self._put(self._connection(topic, kind))
        for at, low, high, counts in self.infos:
            body = b"".join(struct.pack("<II", *x) for x in counts.items())
            self._put(_record(CHUNK_INFO, [(b"ver", struct.pack("<I", 1)), (b"chunk_pos", struct.pack("<Q", at)), (b"start_time", _time(low)),
                                           (b"end_time", _time(high)), (b"count", struct.pack("<I", len(counts)))], body))
        return self._head(index, len(self.connections), len(self.infos))


def write_bags(messages: DataFrame, folder: str, compression: str = "none", chunk_bytes: int = 768 << 10) -> None:
    """Writes messages(bag, topic, type, ts_ns, payload) as <folder>/<bag>.bag.

    A bag is one file and so one task, which streams over its rows in time order.  It is written beside its place and moved
    there when complete, so a task that runs again leaves a whole bag.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _system(folder)
        name, writer, file, body = None, None, None, None

        def end() -> None:
            head = writer.close()
            file.close()
            # the first record is known at the end only: copy behind it in pieces
            with system.open_input_stream(body) as source, system.open_output_stream(f"{body}.whole") as target:
                target.write(MAGIC + head)
                source.read(len(MAGIC) + len(head))
                while data := source.read(4 << 20):
                    target.write(data)
            system.delete_file(body)
            system.move(f"{body}.whole", f"{base}/{name}.bag")

        for batch in batches:
            columns = [batch.column(i) for i in range(5)]
            for i in range(batch.num_rows):
                bag, topic, kind, ns, payload = (c[i].as_py() for c in columns)
                if bag != name:
                    if writer is not None:
                        end()
                    name, body = bag, f"{base}/.{bag}-{np.random.default_rng().integers(1 << 62):x}"
                    system.create_dir(base)
                    file = system.open_output_stream(body)
                    writer = BagWriter(file, compression, chunk_bytes)
                writer.add(topic, kind, ns, payload)
        if writer is not None:
            end()
        yield from ()

    ordered = messages.select("bag", "topic", "type", F.col("ts_ns").cast("long"), "payload").repartition("bag").sortWithinPartitions("bag", "ts_ns", "topic")
    ordered.mapInArrow(run, "done boolean").write.format("noop").mode("overwrite").save()


def bag_scratch(spark: SparkSession, messages: DataFrame, **options) -> str:
    """Writes messages as bags of this application's scratch folder and returns the folder."""
    folder = scratch_path(spark, "bags")
    write_bags(messages, folder, **options)
    return folder
