"""Best-fit packing of token pieces into sequences, after Martello-Toth dominance reduction.

Documents are tokenised and cut into pieces of at most `capacity` tokens (only longer documents are cut;
their first piece is the shorter one).  Which documents have a length does not matter for packing, so the
instance is the histogram of lengths: at most `capacity` counts, whatever the number of documents.  On it

1. *reduction* fixes sets that provably dominate every other set with the same item: the item alone if
   nothing fits beside it; with one item that fills the rest exactly; with the largest item that fits if
   no two fit together;
2. *best fit*, longest first, puts the remainder into the fullest sequences that have room, whole counts
   at a time.

Both steps give sequence patterns with multiplicities.  The pieces of a length are numbered (in salted
groups, whose sizes give the offsets, so no length has to meet in one task) and look up their sequence in
a table of ranges, which like the histogram grows with the capacity only.

Edge cases: a null text is empty; an empty document is its end token alone; repeated rows are packed
each; an empty table gives an empty result; ids may repeat (the row's own piece numbers tell them apart); texts of
any length are tokenised whole; other columns are not read.
"""

from __future__ import annotations

import base64
import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorlake.scratch import stored

CAPACITY, END = 1024, 2
#: Parts that the pieces of one length are numbered in.
SALTS = 64
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer(path: str):
    """text -> ids for a byte-level BPE in the `tokenizers` file at path.

    A .tiktoken file of the same name holds the same vocabulary as ranks; it gives the same ids several
    times as fast and is used for texts without a special token's string; texts that it cannot match go through `tokenizers`.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=merges, special_tokens={})
    special = [t.content for t in slow.get_added_tokens_decoder().values()]

    def encode(text: str):
        if any(s in text for s in special):
            return slow.encode(text, add_special_tokens=False).ids
        try:
            return fast.encode_ordinary(text)
        except BaseException as panic:  # its pattern overflows a stack on some 1,000,000 white space characters in a row
            if type(panic).__name__ != "PanicException":
                raise
            return slow.encode(text, add_special_tokens=False).ids

    return encode


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
NAMES = [c.split()[0] for c in PIECE.split(", ")]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of each document with a checksum of their token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = np.array([*encode(text.as_py() or ""), end], dtype="<u4")
                    cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append((doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                                 names=NAMES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE)


class _Counts:
    """A multiset of lengths with ordered access to those that are left."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.order = sorted(self.n)

    def add(self, length: int, times: int) -> None:
        if length not in self.n:
            insort(self.order, length)
        self.n[length] = self.n.get(length, 0) + times
        if not self.n[length]:
            del self.n[length]
            del self.order[bisect_left(self.order, length)]

    def largest_upto(self, limit: int) -> int | None:
        i = bisect_left(self.order, limit + 1)
        return self.order[i - 1] if i else None

    def two_fit(self, room: int) -> bool:
        if not self.order:
            return False
        a = self.order[0]
        second = a if self.n[a] > 1 else self.order[1] if len(self.order) > 1 else None
        return second is not None and a + second <= room


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Patterns (lengths, multiplicity) that dominate all other sets with their first item, and what is left."""
    left, fixed = _Counts(counts), []
    for item in sorted(counts, reverse=True):
        while n := left.n.get(item, 0):
            room = capacity - item
            left.add(item, -1)  # the others
            partner = left.largest_upto(room)
            dominates = partner is None or partner == room or not left.two_fit(room)
            left.add(item, 1)
            if not dominates:
                break
            if partner is None:
                times = n if item > room else 1
                fixed.append(((item,), times))
            else:
                times = n // 2 if partner == item else min(n, left.n[partner])
                fixed.append(((item, partner), times))
                left.add(partner, -times)
            left.add(item, -times)
    return fixed, dict(left.n)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: items of one length go together into the fullest open
    sequences with room.  A pattern's lengths are a linked list, so that growing it is cheap."""
    open_: dict[int, list[list]] = defaultdict(list)  # room left -> [pattern, multiplicity]
    rooms: list[int] = []
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                fit = capacity // length  # new sequences hold as many of this length as fit
                full, over = divmod(n, fit)
                groups = [(fit, full)] * bool(full) + [(over, 1)] * bool(over)
                n = 0
                for each, times in groups:
                    pattern = None
                    for _ in range(each):
                        pattern = (length, pattern)
                    _put(open_, rooms, capacity - each * length, pattern, times)
                continue
            room = rooms[i]
            group = open_[room][-1]
            k = min(n, group[1])
            group[1] -= k
            n -= k
            pattern = (length, group[0])
            if not group[1]:
                open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    del rooms[i]
            _put(open_, rooms, room - length, pattern, k)
    out = []
    for groups in open_.values():
        for pattern, times in groups:
            lengths = []
            while pattern:
                lengths.append(pattern[0])
                pattern = pattern[1]
            out.append((tuple(reversed(lengths)), times))
    return out


def _put(open_: dict, rooms: list[int], room: int, pattern, times: int) -> None:
    if room not in open_:
        insort(rooms, room)
    open_[room].append([pattern, times])


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    fixed, left = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(left, capacity)


def ranges(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first, last, sequence of first, offset): pieces first..last of a length go to consecutive sequences."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            out.append((length, used[length], used[length] + times - 1, sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return out


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    return place(stored(pieces(docs, path, capacity, end), "pieces"), capacity)


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces."""
    # Most pieces of long documents are full, all of one length: they are numbered in more parts where there are more tasks.
    full = max(SALTS, 4 * int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = F.when(F.col("length") == capacity, F.lit(full)).otherwise(F.lit(SALTS))
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), parts).cast("int"))
    sizes = cut.groupBy("length", "salt").count().collect()  # at most capacity * SALTS + full rows
    counts: dict[int, int] = defaultdict(int)
    offsets = []
    for length, salt, n in sorted(sizes):
        offsets.append((length, salt, counts[length]))
        counts[length] += n
    rows = cut.sparkSession.createDataFrame(offsets, "length long, salt int, before long")
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = cut.withColumn("nth", nth).join(F.broadcast(rows), ["length", "salt"])
    ranked = ranked.select(*NAMES, (F.col("before") + F.col("nth")).alias("rank"))
    table = np.array(sorted((length << 44 | last, first, sequence, offset) for length, first, last, sequence, offset
                            in ranges(plan(dict(counts), capacity))), dtype=np.int64).reshape(-1, 4)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            own = table[np.searchsorted(table[:, 0], length << 44 | rank)]
            columns = [batch.column(c) for c in NAMES] + [pa.array(own[:, 2] + rank - own[:, 1]), pa.array(own[:, 3])]
            yield pa.RecordBatch.from_arrays(columns, names=[*NAMES, "sequence_id", "offset"])

    return ranked.mapInArrow(look_up, f"{PIECE}, sequence_id long, offset long")
