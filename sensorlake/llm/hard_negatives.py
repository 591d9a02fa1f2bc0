"""Hard-negative mining by a secondary sort: scores in (anchor, descending score, id) order, read once by a stream."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorlake.scratch import forget, scratch_path, stored

#: Components of the anchors that are broadcast at once (8 bytes each).
BLOCK_COMPONENTS = 1 << 21
#: A task scores so many rows against so many anchors at once.
TILE = 1 << 10
#: A score beyond a long counts as the largest or smallest of these.
MOST = (1 << 63) - 1
#: Where all scores are below, a score and a place fit into one long.
SMALL = 1 << 42

SCORED = "anchor_id long, score long, kind int, id long"


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, v) of the rows that take part; v holds floor(scale * x) as doubles."""
    known = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                        F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    known = known.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    once = known.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r"))
    return once.select("id", "r.label", F.col("r.v").alias("v")).mapInArrow(_floored(scale), "id long, label long, v array<double>")


def _floored(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(2)
            ends = pa.array(np.asarray(v.offsets) - v.offsets[0].as_py(), pa.int32())
            whole = np.floor(np.minimum(np.maximum(v.flatten().to_numpy() * float(scale), -1e300), 1e300))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(whole))], names=["id", "label", "v"])

    return run


def matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """The vectors as rows of `width` numbers: shorter ones end in zeros, what lies beyond meets only zeros."""
    lengths = np.diff(np.asarray(vectors.offsets))
    out = np.zeros((len(vectors), width))
    flat, row = vectors.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(vectors)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row[place < width], place[place < width]] = flat[place < width]
    return out


def part_of(anchor: int) -> int:
    """Spreads anchor ids over partitions, also where all are multiples of one number."""
    return (anchor * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 32


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a with those of b, as longs."""
    if a.shape[1] == 0:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 1 << 52:  # doubles add such whole numbers exactly
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, -MOST, MOST).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of scores, the k allowed columns of highest score, ties by smaller id: (row, score, id), unordered.

    ids ascend.
    """
    n = scores.shape[1]
    if n <= k:
        row, col = np.nonzero(allowed)
    elif np.abs(scores).max(initial=0) < SMALL and n < 1 << 20:
        lowest = np.iinfo(np.int64).min
        keys = np.where(allowed, (scores << 20) + (n - 1 - np.arange(n)), lowest)
        col = np.argpartition(keys, n - k, axis=1)[:, n - k:]
        row = np.repeat(np.arange(len(scores)), k)
        some = np.take_along_axis(keys, col, 1).ravel() != lowest
        row, col = row[some], col.ravel()[some]
    else:
        order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores, ~allowed), axis=-1)[:, :k]
        row, col = np.repeat(np.arange(len(scores)), order.shape[1]), order.ravel()
        row, col = row[allowed[row, col]], col[allowed[row, col]]
    return row, scores[row, col], ids[col]


class Leaders:
    """The k best (score, id) of every list, over all tiles that a task has seen."""

    def __init__(self, k: int):
        self.k, self.of, self.score, self.id = k, *(np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        of, score, ids = np.concatenate([self.of, of]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, of))
        of = of[order]
        start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, dtype=np.int64)
        nth = np.arange(len(of)) - np.repeat(start, np.diff(np.r_[start, len(of)]))
        self.of, self.score, self.id = of[nth < self.k], score[order][nth < self.k], ids[order][nth < self.k]


def _leaders(anchors, windows, k: int):
    """Scores a task's rows against a block of anchors; emits of each anchor the task's k best rows of its label, or with
    windows (anchor, lowest and highest score) the k best rows of other labels in each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_id, a_label, a = anchors.value
        kind = 0 if windows is None else 1
        of, low, high = windows.value if kind else (np.arange(len(a_id)), None, None)
        starts = range(0, len(a_id), TILE)
        lists = [Leaders(k) for _ in starts]
        for batch in batches:
            ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row in range(0, len(ids), TILE):
                own = row + np.argsort(ids[row:row + TILE], kind="stable")
                tile = matrix(batch.column(2).take(pa.array(own)), a.shape[1])
                for start, leaders in zip(starts, lists, strict=True):
                    some = slice(start, start + TILE)
                    scores, same = products(a[some], tile), a_label[some, None] == labels[None, own]
                    if not kind:
                        at, score, found = best(scores, ids[own], same & (a_id[some, None] != ids[None, own]), k)
                        leaders.add(at + start, score, found)
                        continue
                    mine = np.flatnonzero((of >= start) & (of < start + TILE))
                    for part in np.array_split(mine, -(-len(mine) // TILE)) if len(mine) else ():
                        one, other = scores[of[part] - start], ~same[of[part] - start]
                        at, score, found = best(one, ids[own], other & (one >= low[part, None]) & (one <= high[part, None]), k)
                        leaders.add(part[at], score, found)
        for leaders in lists:
            out = np.unique(np.stack([a_id[of[leaders.of]], leaders.score, leaders.id]), axis=1) if len(leaders.of) else np.zeros((3, 0), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1]), pa.array(np.full(out.shape[1], kind, dtype=np.int32)), pa.array(out[2])],
                                             names=["anchor_id", "score", "kind", "id"])

    return run


def emitted(records: Iterator[tuple], negatives: int, low: int, high: int) -> Iterator[tuple]:
    """Rows of one partition of ((anchor, -score, kind, id), None) in key order.

    A positive (kind 0) opens a window, which takes the next `negatives` rows of other labels with a score s of
    low * p <= 100 * s <= high * p.  Of an anchor only the open windows are held.  A positive comes before every negative of
    its window, for these score no higher, and at an equal score kind 0 sorts first.
    """
    for anchor, rows in groupby((key for key, _ in records), key=lambda key: key[0]):
        opened: list[list[int]] = []
        last = None
        for key in rows:
            if key == last:  # a negative that a task has found for two windows
                continue
            last = key
            score, kind, found = -key[1], key[2], key[3]
            if kind == 0:
                opened.append([score, found, 0])
                continue
            for window in opened:
                if window[2] < negatives and low * window[0] <= 100 * score <= high * window[0]:
                    window[2] += 1
                    yield anchor, window[1], window[2], found, window[0], score
            opened = [w for w in opened if w[2] < negatives and low * w[0] <= 100 * score]


def _blocks(anchors: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The anchors in blocks of about BLOCK_COMPONENTS components, each small enough for the driver and a broadcast."""
    size = anchors.agg(F.sum(F.size("v") + 8)).first()[0] or 0
    n = -(-size // BLOCK_COMPONENTS)
    for b in range(n):
        own = anchors if n == 1 else anchors.where(F.pmod(F.xxhash64("id"), F.lit(n)) == b)
        found = own.toArrow().combine_chunks().sort_by("id")
        if found.num_rows:
            vectors = found["v"].combine_chunks()
            vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
            yield found["id"].to_numpy(), found["label"].to_numpy(), matrix(vectors, int(np.diff(np.asarray(vectors.offsets)).max()))


def mine(rows: DataFrame, is_anchor, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5,
         negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that is_anchor (a condition on the
    column `id`) chooses.

    A row's score is the inner product of its floor(scale * x) with the anchor's.  An anchor's positives are the first
    `positives` other rows of its label by descending score, then id; each takes the first `negatives` rows of other labels
    that score from low to high hundredths of it, so a positive of negative score takes none.

    The anchors are broadcast in blocks of bounded size and all rows are scored against each block where they lie, in tiles.  A
    first pass finds the positives and so the windows of each anchor; in the second a task emits only the rows that can be
    among the first `negatives` of a window, its own best ones.  That is the combiner: what is shuffled are a few scores for
    each anchor and task, whatever share of the rows a label or a vector holds.  They are packed into keys (anchor,
    descending score, kind, id), sorted by repartitionAndSortWithinPartitions, and a stream over each partition opens the
    windows and emits the negatives without holding an anchor's rows.

    Rows with a null id, label or vector or with a null or non-finite component take no part.  Rows of one id count once, as
    that of the smallest label, then vector.  Vectors of other lengths than the anchor's count as filled up with zeros, and
    empty ones score 0.  Scores are exact; beyond a long they count as its bounds.  Other columns are ignored, whatever
    their names; an empty table gives no rows.
    """
    if not 0 <= low <= high <= 100:
        raise ValueError("low and high are hundredths of a positive's score, at most 100")
    spark = rows.sparkSession
    vectors = stored(whole_vectors(rows, id_col, vector_col, label_col, scale), "vectors")
    anchors = stored(vectors.where(is_anchor), "anchors")
    found = scratch_path(spark, "scores")
    spark.createDataFrame([], SCORED).write.parquet(found)
    for a_id, a_label, a in _blocks(anchors):
        block = spark.sparkContext.broadcast((a_id, a_label, a))
        near = vectors.mapInArrow(_leaders(block, None, positives), SCORED)
        nth = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id"))
        first = stored(near.withColumn("nth", nth).where(F.col("nth") <= positives), "positives")
        first.drop("nth").write.mode("append").parquet(found)
        held = first.select("anchor_id", "score").where("score >= 0").distinct().toArrow()  # of one block of anchors
        score = held["score"].to_pylist()
        spans = spark.sparkContext.broadcast((
            np.searchsorted(a_id, held["anchor_id"].to_numpy()), np.array([-(-low * s // 100) for s in score], dtype=np.int64),
            np.array([high * s // 100 for s in score], dtype=np.int64)))
        vectors.mapInArrow(_leaders(block, spans, negatives), SCORED).write.mode("append").parquet(found)
        block.destroy()
        spans.destroy()
        forget(first)
    forget(vectors, anchors)
    scored = spark.read.schema(SCORED).parquet(found)
    keyed = scored.rdd.map(lambda r: ((r[0], -r[1], r[2], r[3]), None))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionAndSortWithinPartitions(n, lambda key: part_of(key[0]))
    mined = ordered.mapPartitions(lambda records: emitted(records, negatives, low, high))
    return spark.createDataFrame(
        mined, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long", verifySchema=False)
