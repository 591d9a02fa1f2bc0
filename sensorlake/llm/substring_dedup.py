"""Substring deduplication with a log-structured fingerprint index.

A window is `window` consecutive words of one document.  A word goes if a window that covers it has a
word sequence that also starts earlier: in an earlier batch, or in this batch at a smaller
(doc_id, start).  Windows are judged on the input, not on what is left.

Fingerprints are winnowed: of the hashes of the `gram`-word runs inside a window the leftmost minimum is
kept, so equal windows share a fingerprint and only about two in ``window - gram + 2`` positions are
indexed.  The index holds sorted immutable runs of (fingerprint, document) in hash buckets, and every
new batch goes through these steps:

1. its fingerprints are written as a run of their own;
2. the run is merge-joined, bucket by bucket, with itself and the older runs: a fingerprint found twice
   is a hit;
3. verification: documents with hits (of this batch and, from the content store, of older ones) list
   the windows under the hits; windows are equal if fingerprint and window hash (two independent 64-bit
   hashes over keyed hashes of the words) agree.  The earliest of each is a partial aggregate and goes back
   to the rows by `join_groups`, so a passage that a third of all documents share is no task's burden.  A
   batch reads the whole content store, without a shuffle;
4. fingerprints that only cover repeated windows become tombstones, and when `fan` runs share a level
   they are merged into one run of the next level, without the rows under tombstones.

Edge cases: null and short texts (fewer words than a window) have no windows and stay whole (null: empty);
equal rows of one doc_id are one document, so they lose the same words and each gives a row (different
texts under one doc_id share the places that are repeated in either); rows without id are left out; an
empty batch changes nothing; other columns are not read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.llm.kernels import chunks, sequence_hashes, signed, winnow
from sensorlake.operators.skew import join_groups
from sensorlake.scratch import BucketedTable, forget, stored

WINDOW, GRAM, FAN = 20, 8, 2


@dataclass
class Run:
    level: int
    rows: BucketedTable
    tombs: DataFrame | None


def fingerprints(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(a, doc_id, n): the winnowed fingerprints of each document and in how many places it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column(1)):
                at, doc, place, grams = winnow(chunk, window, gram)
                first = np.ones(len(at), dtype=bool)
                first[1:] = place[1:] != place[:-1]
                pairs = np.empty(int(first.sum()), dtype=[("d", np.int64), ("a", np.uint64)])
                pairs["d"], pairs["a"] = doc[first], grams[place[first]]
                pairs, n = np.unique(pairs, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.ascontiguousarray(pairs["a"]))), pa.array(ids[chunk.first_row + pairs["d"]]), pa.array(n)],
                    names=["a", "doc_id", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "a long, doc_id long, n long")


def windows_under(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(a, w, doc_id, start) of the windows of docs(doc_id, text, hits) whose fingerprint is among hits; with t if docs has it."""
    names = ["doc_id", *(["t"] if "t" in docs.columns else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 3)[:len(names)]]
            for chunk in chunks(batch.column(1)):
                at, doc, place, grams = winnow(chunk, window, gram)
                anchors = signed(grams)[place] if len(at) else at
                other = signed(sequence_hashes(chunk.word_hashes(1), window, 1))
                edges = np.searchsorted(doc, np.arange(chunk.n_docs + 1))
                keep = np.zeros(len(at), dtype=bool)
                for i in range(chunk.n_docs):
                    hits = batch.column(2)[chunk.first_row + i].values
                    keep[edges[i] : edges[i + 1]] = np.isin(anchors[edges[i] : edges[i + 1]], hits.to_numpy(zero_copy_only=False))
                at, doc = at[keep], doc[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors[keep]), pa.array(other[at] if len(at) else at), pa.array(at - chunk.word_bounds[doc]),
                     *[pa.array(x[chunk.first_row + doc]) for x in own]],
                    names=["a", "w", "start", *names])

    return docs.select("doc_id", "text", "hits", *names[1:]).mapInArrow(run, "a long, w long, start long" + "".join(f", {n} long" for n in names))


OUT = "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start:long,stop:long>>, covered array<long>"


def cut(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Removes the words under the repeated windows of docs(doc_id, text, starts; null: none).

    kept: the other words joined by one space; removed: spans of words; covered: fingerprints all of
    whose windows are repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                known = []
                rows = [one(chunk, i, batch.column(2)[chunk.first_row + i].values, known) for i in range(chunk.n_docs)]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.list_(pa.int64())]
                columns = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first_row, chunk.n_docs), *columns],
                                                 names=[c.split()[0] for c in OUT.split(", ")])

    def under(chunk, known: list) -> tuple[np.ndarray, np.ndarray]:
        """First words of the chunk's windows and their fingerprints, computed once."""
        if not known:
            at, _, place, grams = winnow(chunk, window, gram)
            known += [at, signed(grams)[place] if len(at) else at]
        return known[0], known[1]

    def one(chunk, i: int, starts, known: list) -> tuple:
        lo, hi = chunk.word_bounds[i], chunk.word_bounds[i + 1]
        first, last, n = chunk.starts[lo:hi], chunk.ends[lo:hi], int(hi - lo)
        gone, spans, covered = np.zeros(n, dtype=bool), [], []
        if starts is not None and len(starts):
            starts = np.unique(starts.to_numpy(zero_copy_only=False))
            starts = starts[starts + window <= n]
            change = np.zeros(n + 1, dtype=np.int64)
            np.add.at(change, starts, 1)
            np.add.at(change, starts + window, -1)
            gone = np.cumsum(change)[:n] > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            spans = [{"start": a, "stop": b} for a, b in edge.reshape(-1, 2).tolist()]
            at, anchors = under(chunk, known)
            own = slice(*np.searchsorted(at, (lo, hi)))
            fresh = ~np.isin(at[own] - lo, starts)
            covered = np.setdiff1d(anchors[own], anchors[own][fresh]).tolist()
        kept = b" ".join(chunk.data[a:b].tobytes() for a, b in zip(first[~gone].tolist(), last[~gone].tolist(), strict=True))
        return n, int(gone.sum()), kept.decode(), spans, covered

    return docs.select("doc_id", "text", "starts").mapInArrow(run, OUT)


class FingerprintIndex:
    """See the module's docstring.  buckets: parts of every run; give it the partitions of a large shuffle.

    With `at`, a folder that driver and executors share, the index outlives the session: every batch ends with a new
    manifest there, and `FingerprintIndex.reopen(spark, at)` goes on from the last one.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, window: int = WINDOW, gram: int = GRAM, fan: int = FAN,
                 at: str | None = None):
        self.spark, self.window, self.gram, self.fan, self.at = spark, window, gram, fan, at
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[Run] = []
        self.contents: list[BucketedTable] = []
        self.version = 0

    def _table(self, df: DataFrame, name: str, key: str) -> BucketedTable:
        return BucketedTable(df, name, key, self.buckets, at=self.at and f"{self.at}/{name}-{uuid.uuid4().hex}")

    def ingest(self, docs: DataFrame) -> DataFrame:
        """Deduplicates a batch of new documents against the index and each other, and adds them to it."""
        docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL")
        content = self._table(docs, "content", "doc_id")
        new = self._table(fingerprints(content.read(), self.window, self.gram), "run", "a")
        hits = self._hits(new)
        result, used = self._verify(content, new, hits)
        result = stored(result, "deduplicated")
        hits.drop()
        used[0].drop()
        forget(*used[1:])
        tombs = result.select("doc_id", F.explode("covered").alias("a"))
        if self.at:
            path = f"{self.at}/tombs-{uuid.uuid4().hex}"
            tombs.write.parquet(path)
            tombs = self.spark.read.schema(tombs.schema).parquet(path)
            tombs.scratch_path = path
        else:
            tombs = stored(tombs, "tombs")
        self.runs.append(Run(0, new, tombs))
        self.contents.append(content)
        dead = self._compact()
        if self.at:
            self._write_manifest()
        for run in dead:
            run.rows.drop()
            if run.tombs is not None:
                forget(run.tombs)
        return result.drop("covered")

    def _hits(self, new: BucketedTable) -> BucketedTable:
        own = new.read().groupBy("a").agg(F.sum("n").alias("n"))
        found = own.where("n > 1").select("a")
        for run in self.runs:
            found = found.unionByName(own.select("a").join(run.rows.read().select("a"), "a", "left_semi"))
        return BucketedTable(found.distinct(), "hits", "a", self.buckets)

    def _verify(self, content: BucketedTable, new: BucketedTable, hits: BucketedTable) -> tuple[DataFrame, list]:
        """The result and the tables that it reads."""
        parts = [t.read().join(hits.read(), "a", "left_semi").select("a", "doc_id") for t in [new, *(r.rows for r in self.runs)]]
        wanted = parts[0]
        for part in parts[1:]:
            wanted = wanted.unionByName(part)
        wanted = BucketedTable(wanted.groupBy("doc_id").agg(F.collect_set("a").alias("hits")), "wanted", "doc_id", self.buckets)
        # the texts of an id are told apart by a hash, where ids of the batch have several rows at all
        mixed = not content.read().groupBy("doc_id").count().where("count > 1").isEmpty()
        tag = {"t": F.xxhash64("text")} if mixed else {}
        listed = None
        for table, age in [(content, 1)] + [(c, 0) for c in self.contents]:
            part = windows_under(table.read().join(wanted.read(), "doc_id").withColumns(tag), self.window, self.gram).withColumn("age", F.lit(age))
            listed = part if listed is None else listed.unionByName(part)
        windows = stored(self._order(listed, content), "windows")
        firsts = stored(windows.groupBy("a", "w").agg(F.min("at").alias("first"), F.count("*").alias("c")).where("c > 1"), "first-windows")
        repeated = join_groups(windows.where("age = 1"), firsts, ["a", "w"], "c").where("at <> first")
        start = F.struct("t", "start") if mixed else F.col("start")
        texts = content.read().join(repeated.groupBy("doc_id").agg(F.collect_list(start).alias("starts")), "doc_id", "left")
        if mixed:
            texts = texts.withColumns(tag).withColumn("starts", F.transform(F.filter("starts", lambda x: x["t"] == F.col("t")), lambda x: x["start"]))
        return cut(texts, self.window, self.gram), [wanted, windows, firsts]

    def _order(self, windows: DataFrame, content: BucketedTable) -> DataFrame:
        """Adds at, a number that orders windows by (age, doc_id, start)."""
        tables = [content, *self.contents]
        stats = [t.read().agg(F.min("doc_id"), F.max("doc_id"), F.max(F.octet_length("text"))).first() for t in tables]
        low, high = (f((s[i] for s in stats if s[i] is not None), default=0) for i, f in ((0, min), (1, max)))
        length = max((s[2] for s in stats if s[2] is not None), default=0) + 1
        width = high - low + 1
        kind = "long" if 2 * width * length < 1 << 63 else "decimal(38,0)"
        at = f"((CAST(age AS {kind}) * {width}{'L' if kind == 'long' else ''} + (doc_id - {low}L)) * {length}L + start)"
        return windows.select("*", F.expr(f"CAST({at} AS {kind})").alias("at"))

    def _compact(self) -> list[Run]:
        """Merges the runs of a level that has `fan` of them, without the rows under tombstones; the runs that are merged."""
        level, dead = 0, []
        while len(same := [r for r in self.runs if r.level == level]) >= self.fan:
            rows = None
            for run in same:
                part = run.rows.read()
                part = part.join(run.tombs, ["a", "doc_id"], "left_anti") if run.tombs is not None else part
                rows = part if rows is None else rows.unionByName(part)
            merged = Run(level + 1, self._table(rows, "run", "a"), None)
            self.runs = [r for r in self.runs if r.level != level] + [merged]
            dead += same
            level += 1
        return dead

    def _write_manifest(self) -> None:
        """A new file, so that a driver that dies half-way leaves the last whole one."""
        self.version += 1
        describe = lambda t: {"path": t.path, "schema": t.schema}
        manifest = {"window": self.window, "gram": self.gram, "fan": self.fan, "buckets": self.buckets,
                    "runs": [{"level": r.level, **describe(r.rows), "tombs": r.tombs.scratch_path if r.tombs is not None else None} for r in self.runs],
                    "contents": [describe(c) for c in self.contents]}
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{self.at}/manifests/{self.version:09d}")

    @classmethod
    def reopen(cls, spark: SparkSession, at: str) -> FingerprintIndex:
        """The index that another session has left in the folder `at`."""
        last = spark.read.text(f"{at}/manifests/*").select(F.input_file_name().alias("f"), "value").orderBy(F.desc("f")).first()
        known = json.loads(last.value)
        index = cls(spark, known["buckets"], known["window"], known["gram"], known["fan"], at)
        index.version = int(last.f.split("/")[-2])
        table = lambda x, name, key: BucketedTable(None, name, key, index.buckets, spark, x["path"], x["schema"])
        for run in known["runs"]:
            tombs = None
            if run["tombs"]:
                tombs = spark.read.schema("doc_id long, a long").parquet(run["tombs"])
                tombs.scratch_path = run["tombs"]
            index.runs.append(Run(run["level"], table(run, "run", "a"), tombs))
        index.contents = [table(c, "content", "doc_id") for c in known["contents"]]
        return index

    def close(self) -> None:
        """Takes the tables' names out of the catalog; deletes the files of an index without a folder of its own."""
        for table in [*(r.rows for r in self.runs), *self.contents]:
            table.unregister() if self.at else table.drop()


def exact_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, original): documents whose text equals that of a smaller doc_id, among the ids that have one row."""
    hashed = stored(docs.select("doc_id", F.md5("text").alias("h"), F.octet_length("text").alias("size")), "text-hashes")
    again = stored(hashed.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"), "repeated-ids")
    single = hashed.where("h IS NOT NULL")
    if not again.isEmpty():
        single = stored(single.join(again, "doc_id", "left_anti"), "single-ids")
    firsts = stored(single.groupBy("h", "size").agg(F.min("doc_id").alias("original"), F.count("*").alias("c")).where("c > 1"), "first-texts")
    copies = stored(join_groups(single, firsts, ["h", "size"], "c").where("doc_id <> original").select("doc_id", "original"), "copies")
    forget(hashed, again, firsts)
    return copies


def deduplicate(docs: DataFrame, batches: int = 3, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, removed) of every document: docs go into a new index in `batches`
    batches of rising doc_id.  A copy of an earlier text loses all its words if they fill a window, so
    copies stay out of the index.  Every row with an id gives a row: ids with several rows go through the index, where equal rows of an
    id are one document, neither the earlier one, and each text of an id loses its own repeated windows."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL")
    copies = exact_copies(docs)
    edges = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)])).first()[0] or []
    index, results = FingerprintIndex(spark, window=window, gram=gram), []
    low = None
    for high in [*sorted(set(edges)), None]:
        part = docs if low is None else docs.where(F.col("doc_id") > low)
        part = part if high is None else part.where(F.col("doc_id") <= high)
        results.append(index.ingest(part.join(copies, "doc_id", "left_anti")))
        low = high
    index.close()
    unique = results[0]
    for part in results[1:]:
        unique = unique.unionByName(part)
    sizes = unique.join(copies.select("original").distinct(), unique.doc_id == F.col("original"), "left_semi").select(
        F.col("doc_id").alias("original"), "n_words", F.when(F.col("n_words") < window, F.col("kept")).alias("kept"))
    again = copies.join(sizes, "original").select(
        "doc_id", "n_words", F.when(F.col("n_words") >= window, F.col("n_words")).otherwise(0).alias("n_removed"),
        F.coalesce("kept", F.lit("")).alias("kept"),
        F.expr(f"CASE WHEN n_words >= {window} THEN array(named_struct('start', 0L, 'stop', n_words)) ELSE array() END").alias("removed"))
    return unique.unionByName(again)
