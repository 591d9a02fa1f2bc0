"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles.

A test item Q with n distinct shingles leaks into a document D if ``|Q & D| * den >= num * n``, however
long D is.  Then D lacks at most ``n - need`` of Q's shingles (need = ceil(n * num / den)), so among the
``n - need + 1`` smallest shingle hashes of Q (its bottom-k MinHash) at least one is in D: looking these
up finds every leak, without the misses of a fixed-length signature when D is much larger than Q.
Items are partitioned by size (powers of two).  Each partition has its own sketch size and its own
largest sketch value; a document looks up only shingles up to that value, and only in partitions whose
items are small enough to fit into it.  Candidates are verified on the shingles themselves, not their hashes.

A benchmark whose sketches and texts are small (both are counted) travels with the tasks and the search
has no shuffle; a larger one is joined on the sketch values.

Shingles are k consecutive words, A-Z lower-cased; an item of fewer than k words is looked up as one
sequence of all its words.

Edge cases: null or wordless texts and items match nothing; repeated rows of an item or a document give
one pair per (doc_id, item_id), where different texts under one id count separately in n and the fuller
match is reported; rows without id are left out; an empty benchmark or table gives no pairs; other columns are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.llm.kernels import U64, chunks, sequence_hashes, signed
from sensorlake.scratch import stored

#: Bounds on what may travel with the tasks.
MAX_SKETCH, MAX_ITEM_BYTES = 1_000_000, 32 << 20
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_UPPER = bytes(range(65, 91))
_FOLD = bytes.maketrans(_UPPER, _UPPER.lower())


def shingles(text: str | bytes, k: int) -> set[bytes]:
    """Distinct shingles of k words as bytes (words joined by one space)."""
    raw = text.encode() if isinstance(text, str) else text
    words = _WORD.findall(raw.translate(_FOLD))
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


def length_of(text: str, k: int) -> int:
    """Words of an item's shingles: k, or all its words if they are fewer."""
    return min(k, len(_WORD.findall(text.encode())))


def need(n: int, num: int, den: int) -> int:
    return -(-n * num // den)


def sketches(items: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(t, item_id, k, n, class): the smallest shingle hashes of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for chunk in chunks(batch.column(1)):
                words = chunk.word_hashes(lower=True)
                for i in range(chunk.n_docs):
                    own = words[chunk.word_bounds[i] : chunk.word_bounds[i + 1]]
                    size = min(k, len(own))
                    grams = np.unique(sequence_hashes(own, size)) if size else own
                    n = len(grams)
                    for t in signed(grams[: n - need(n, num, den) + 1]).tolist() if n else ():
                        out.append((t, ids[chunk.first_row + i], size, n, n.bit_length()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[j] for r in out], pa.int64()) for j in range(5)], names=["t", "item_id", "k", "n", "class"])

    return items.mapInArrow(run, "t long, item_id long, k long, n long, class long")


class Lookup:
    """The sketches of all items, by shingle length and size partition."""

    def __init__(self, rows: np.ndarray, num: int, den: int):
        self.parts = []
        for k, c in sorted({(int(r[2]), int(r[4])) for r in rows}):
            own = rows[(rows[:, 2] == k) & (rows[:, 4] == c)]
            values = own[:, 0].view(U64)
            by = np.argsort(values, kind="stable")
            least = min(need(int(n), num, den) for n in own[:, 3])
            self.parts.append((k, least, values[by][-1], values[by], own[by, 1]))

    def hits(self, chunk) -> dict[int, set[int]]:
        """Candidate items of each document of the chunk (by its place in the chunk)."""
        words = chunk.word_hashes(lower=True)
        sizes, found = np.diff(chunk.word_bounds), {}
        grams = {k: sequence_hashes(words, k) for k in {p[0] for p in self.parts}}
        for k, least, largest, values, items in self.parts:
            own = grams[k]
            at = np.flatnonzero(own <= largest)
            left = np.searchsorted(values, own[at])
            hit = values[np.minimum(left, len(values) - 1)] == own[at]
            at, left = at[hit], left[hit]
            doc = np.searchsorted(chunk.word_bounds, at, side="right") - 1
            inside = (at + k <= chunk.word_bounds[doc + 1]) & (sizes[doc] - k + 1 >= least)
            for d, i in zip(doc[inside].tolist(), left[inside].tolist(), strict=True):
                value = values[i]
                while i < len(values) and values[i] == value:
                    found.setdefault(d, set()).add(int(items[i]))
                    i += 1
        return found


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(4)], names=PAIR)


PAIR = ["doc_id", "item_id", "n_shingles", "n_common"]
PAIR_SCHEMA = ", ".join(f"{c} long" for c in PAIR)


def leaks(docs: DataFrame, items: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100),
          max_sketch: int = MAX_SKETCH) -> DataFrame:
    """(doc_id, item_id, n_shingles of the item, n_common) for every leak."""
    num, den = threshold
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    items = items.select(F.col("item_id").cast("long"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    sketch = stored(sketches(items, k, num, den), "sketches")
    entries = sketch.count()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pairs = _carried(docs, items, sketch, k, num, den) if entries <= max_sketch and size <= MAX_ITEM_BYTES else \
        _joined(docs, items, sketch, k, num, den)
    return pairs.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n_shingles", "n_common"), F.col("n_common") / F.col("n_shingles")).alias("m")).select(
        "doc_id", "item_id", "m.n_shingles", "m.n_common")


def _carried(docs: DataFrame, items: DataFrame, sketch: DataFrame, k: int, num: int, den: int) -> DataFrame:
    rows = sketch.toPandas().to_numpy(dtype=np.int64).reshape(-1, 5)  # at most max_sketch rows
    texts: dict[int, list[str]] = {}
    for item, text in items.collect():  # at most MAX_ITEM_BYTES
        texts.setdefault(item, []).append(text)
    sent = docs.sparkSession.sparkContext.broadcast((Lookup(rows, num, den), texts))  # bounded by max_sketch and MAX_ITEM_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, texts = sent.value
        sets = {i: [(n, shingles(t, n)) for t in ts if (n := length_of(t, k))] for i, ts in texts.items()}
        for batch in batches:
            ids, out = batch.column(0), []
            for chunk in chunks(batch.column(1)):
                for d, candidates in lookup.hits(chunk).items():
                    raw, own = chunk.data[chunk.bounds[d] : chunk.bounds[d + 1]].tobytes(), {}
                    for item in sorted(candidates):
                        for n, wanted in sets[item]:
                            if n not in own:
                                own[n] = shingles(raw, n)
                            common = len(wanted & own[n])
                            if common * den >= num * len(wanted):
                                out.append((ids[chunk.first_row + d].as_py(), item, len(wanted), common))
            yield _emit(out)

    return docs.mapInArrow(run, PAIR_SCHEMA)


def _joined(docs: DataFrame, items: DataFrame, sketch: DataFrame, k: int, num: int, den: int) -> DataFrame:
    sized = sketch.select("k", "class", "n", "t", F.expr("CASE WHEN t < 0 THEN 1 ELSE 0 END").alias("high"))
    sized = sized.groupBy("k", "class").agg(F.max(F.struct("high", "t")).alias("m"), F.min("n").alias("n")).select("k", "class", "n", F.col("m.t").alias("largest"))
    bounds = [(r.k, r["class"], need(r.n, num, den), r.largest) for r in sized.orderBy("k", "class").collect()]  # k times the logarithm of the largest item

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column(1)):
                words = chunk.word_hashes(lower=True)
                grams, sizes = {k: sequence_hashes(words, k) for k in {b[0] for b in bounds}}, np.diff(chunk.word_bounds)
                for k, part, least, largest in bounds:
                    own = grams[k]
                    at = np.flatnonzero(own <= np.array([largest]).view(U64)[0])
                    doc = np.searchsorted(chunk.word_bounds, at, side="right") - 1
                    keep = (at + k <= chunk.word_bounds[doc + 1]) & (sizes[doc] - k + 1 >= least)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(own[at[keep]])), pa.array(np.full(int(keep.sum()), part)), pa.array(ids[chunk.first_row + doc[keep]])],
                        names=["t", "class", "doc_id"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, item, text, passage in zip(*(batch.column(i) for i in range(4)), strict=True):
                n = length_of(passage.as_py(), k)
                wanted = shingles(passage.as_py(), n)
                common = len(wanted & shingles(text.as_py(), n))
                if common * den >= num * len(wanted):
                    out.append((doc.as_py(), item.as_py(), len(wanted), common))
            yield _emit(out)

    found = docs.mapInArrow(entries, "t long, class long, doc_id long").join(sketch.select("t", "class", "item_id").distinct(), ["t", "class"])
    pairs = found.select("doc_id", "item_id").distinct()
    both = pairs.join(items.withColumnRenamed("text", "passage"), "item_id").join(docs, "doc_id")
    return both.select("doc_id", "item_id", "text", "passage").mapInArrow(verify, PAIR_SCHEMA)


def without_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without the documents that hold an item; rows without id stay."""
    return docs.join(leaks(docs, items, **options).select("doc_id").distinct(), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
