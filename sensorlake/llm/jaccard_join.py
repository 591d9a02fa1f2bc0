"""Exact n-gram Jaccard join and its connected components, by filtering under several global orders.

Documents become sets of distinct k-word shingles (A-Z lower-cased).  The steps, all on Spark:

1. *Classes.*  Documents with the same set meet in one representative, the smallest id.
2. *Pivots.*  Under each of a few hash orders a representative meets, of the documents that share its first
   shingle, the one with the fewest infrequent shingles (the centre of a group of near copies); it is
   compared with those that it meets twice or more.  That is linear in the documents, whatever the size of
   a group of near copies, and leaves most of such a group in one provisional component.
3. *Prefix join.*  If ``|A & B| * den >= num * |A | B|`` then A and B share a shingle among the first
   ``n - ceil(n * num / den) + 1`` of each under *every* global order.  Shingles are joined under the
   first order; only pairs from different provisional components go on (a shingle whose documents
   all lie in one component yields none) that can still overlap enough from their first common shingle
   on, the prefixes under the other orders have to meet too, and what is left is verified on the words of
   both texts.  Frequent shingles, found in a hash sample of the documents, stand last in all orders; that
   list only steers the order, never the result.
4. *Components* of all verified links.  Pairs inside a provisional component are already connected,
   so no component is lost by not comparing them.

Candidates come from 64-bit shingle hashes over keyed word hashes, equal sets from a 128-bit digest of these;
links are verified on words.

Edge cases: null or wordless text has an empty set, links with nothing and is its own component; a text
of fewer than k words is one shingle; an empty table gives an empty result; rows that repeat an id with its
text each give the same row; rows without id are left out; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.llm.kernels import CHUNK_BYTES, U64, chunks, exact_sets, mix64, shingle_sets, signed, whole
from sensorlake.operators.components import connected_components
from sensorlake.operators.skew import join_groups
from sensorlake.scratch import forget, stored

PIVOT_ORDERS = 6
SMALL_IDS = 2_000_000  # ids that may be broadcast (16 MB); beyond, the join is shuffled
SAMPLE_EVERY = 16  # one document in so many is looked at for frequent shingles
FREQUENT = 8  # documents of that sample that make a shingle frequent
MAX_FREQUENT = 200_000  # most frequent shingles that are put last


def order_hash(shingles: np.ndarray, order: int) -> np.ndarray:
    return shingles if order == 0 else mix64(shingles ^ U64(0x9E3779B97F4A7C15 * order % (1 << 64)))


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-n * num // den) + 1


def prefix(shingles: np.ndarray, order: int, frequent: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first shingles of a set under one global order: the infrequent by their hash, then the rest."""
    if not len(shingles):
        return shingles
    rank = order_hash(shingles, order)
    by = np.lexsort((rank, is_frequent(shingles, frequent))) if len(frequent) else np.argsort(rank)
    return shingles[by[: prefix_length(len(shingles), num, den)]]


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for chunk in chunks(batch.column(1)):
            sets = list(shingle_sets(chunk, k))
            yield ids[chunk.first_row : chunk.first_row + len(sets)], sets


def is_frequent(shingles: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.zeros(len(shingles), dtype=bool)
    return frequent[np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)] == shingles


def signatures(docs: DataFrame, k: int, frequent: Broadcast) -> DataFrame:
    """(id, n, own, two halves of a digest of the set, its first shingle under each pivot order) of each document;
    own: its infrequent shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches, k):
            filled = [s if len(s) else np.zeros(1, dtype=U64) for s in sets]
            flat = np.concatenate(filled)
            cuts = np.cumsum([0] + [len(s) for s in filled])[:-1]
            halves = np.frombuffer(b"".join(blake2b(s.tobytes(), digest_size=16).digest() for s in sets), dtype=np.int64).reshape(-1, 2)
            columns = [np.minimum.reduceat(order_hash(flat, i), cuts) for i in range(PIVOT_ORDERS)]
            own = np.add.reduceat((~is_frequent(flat, frequent.value)).astype(np.int64), cuts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array([len(s) for s in sets], pa.int64()), pa.array(own), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())]
                + [pa.array(signed(c)) for c in columns], names=names)

    names = ["id", "n", "own", "f1", "f2"] + [f"m{i}" for i in range(PIVOT_ORDERS)]
    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def frequent_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """The most frequent shingles of a hash sample of the documents, at most MAX_FREQUENT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, k):
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(sets)))], names=["t"])

    sample = docs.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE_EVERY)) == 0)
    counts = sample.mapInArrow(run, "t long").groupBy("t").count().where(F.col("count") >= FREQUENT)
    top = counts.orderBy(F.desc("count"), "t").limit(MAX_FREQUENT).select("t").toPandas()["t"]
    return np.sort(top.to_numpy(dtype=np.int64).view(U64))


def chosen(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Rows of df whose column is among the written, distinct ids: broadcast if they are few, else shuffled."""
    small = ids.count() <= SMALL_IDS
    return df.join(F.broadcast(ids) if small else ids, column, "left_semi")


def met_under(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int, orders: int, frequent: Broadcast) -> DataFrame:
    """Of the written pairs (a, b), those whose prefixes meet under each of the orders 1 to orders - 1 too.

    Each document sends the lower halves of its prefix hashes: a false agreement only lets a pair pass.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches, k):
            own = [[np.sort(prefix(s, o, frequent.value, num, den).astype(np.uint32)).tobytes() for o in range(1, orders)] for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(own, pa.list_(pa.binary()))], names=["id", "p"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("pa"), batch.column("pb"), strict=True):
                both = [[np.frombuffer(v.as_buffer(), dtype=np.uint32) for v in z] for z in (x, y)]
                keep.append(all(np.intersect1d(u, v).size for u, v in zip(*both, strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    digests = chosen(docs, ids_of(pairs)).mapInArrow(digest, "id long, p array<binary>")
    both = pairs.join(digests.select(F.col("id").alias("b"), F.col("p").alias("pb")), "b")
    both = both.join(digests.select(F.col("id").alias("a"), F.col("p").alias("pa")), "a")
    return both.select("a", "b", "pa", "pb").mapInArrow(meet, "a long, b long")


def ids_of(pairs: DataFrame) -> DataFrame:
    return stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")


def verified(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Of the written pairs (a, b), those whose whole sets are similar enough, by the words themselves."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.add(pc.binary_length(batch.column("ta")), pc.binary_length(batch.column("tb"))).to_numpy(zero_copy_only=False)
            part = np.cumsum(sizes) // CHUNK_BYTES
            for at in np.unique(part, return_index=True)[1].tolist():
                rows = batch.slice(at, int((part == part[at]).sum()))
                a = rows.column("a").to_numpy()
                new = np.concatenate([[True], a[1:] != a[:-1]])  # rows of one a follow each other, mostly
                texts = pa.concat_arrays([rows.column("ta").filter(pa.array(new)), rows.column("tb")])
                sets = list(exact_sets(whole(texts), k))
                left, right = np.cumsum(new) - 1, int(new.sum())
                keep = []
                for i in range(len(a)):
                    one, other = sets[left[i]], sets[right + i]
                    common = np.intersect1d(one, other, assume_unique=True).size
                    keep.append(common * den >= num * (len(one) + len(other) - common))
                yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    texts = chosen(docs, ids_of(pairs))  # compresses better than hashes do
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    both = both.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(similar, "a long, b long")


def close_sizes(x, y, num: int, den: int):
    """Sets of these sizes can be similar enough."""
    return (F.least(x, y) * den >= F.greatest(x, y) * num)


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                              threshold: tuple[int, int] = (80, 100), orders: int = 3) -> DataFrame:
    """(id, n_shingles, component_id) per document; see the module's docstring."""
    num, den = threshold
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, k))  # at most MAX_FREQUENT
    signature = stored(signatures(docs, k, frequent), "signatures")

    classes = stored(signature.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"), F.count("*").alias("c")), "classes")
    members = stored(join_groups(signature, classes, ["n", "f1", "f2"], "c", "left").select(
        "id", "n", "own", F.coalesce("rep", "id").alias("rep"), *[f"m{i}" for i in range(PIVOT_ORDERS)]), "members")
    reps = members.where("id = rep AND n > 0")

    first = reps.select("id", "n", "own", F.posexplode(F.array(*[f"m{i}" for i in range(PIVOT_ORDERS)])).alias("order", "m"))
    pivots = stored(first.groupBy("order", "m").agg(F.min(F.struct("own", "id", "n")).alias("p"), F.count("*").alias("c")).where("c > 1"), "pivots")
    tries = join_groups(first, pivots, ["order", "m"], "c").where((F.col("p.id") != F.col("id")) & close_sizes(F.col("n"), F.col("p.n"), num, den))
    tries = tries.groupBy(F.col("p.id").alias("a"), F.col("id").alias("b")).count().where("count >= 2").select("a", "b")
    tries = stored(tries, "pivot-pairs")
    forget(signature, classes, pivots)
    near = stored(verified(tries, docs, k, num, den), "pivot-links")
    provisional = connected_components(near)
    placed = stored(members.select("id", "n", "rep").join(
        provisional.withColumnRenamed("node", "id"), "id", "left").select(
        "id", "n", "rep", F.coalesce("component", "id").alias("component")), "placed")
    forget(members, tries)

    entries = stored(prefix_entries(docs, placed, k, num, den, frequent), "prefix-entries")
    pairs = prefix_pairs(entries, num, den)
    forget(entries)
    met = stored(met_under(pairs, docs, k, num, den, orders, frequent), "met-pairs")
    forget(pairs)
    far = stored(verified(met, docs, k, num, den), "links")
    forget(met)
    final = connected_components(near.unionByName(far)).withColumnRenamed("node", "rep")
    forget(near, far)
    return placed.select("id", "n", "rep").join(final, "rep", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def prefix_entries(docs: DataFrame, placed: DataFrame, k: int, num: int, den: int, frequent: Broadcast) -> DataFrame:
    """(t, id, pos, n, component): the prefix shingles of representatives under the first order, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, component = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "component"))
            for chunk in chunks(batch.column("text")):
                sets = list(shingle_sets(chunk, k))
                first = [prefix(s, 0, frequent.value, num, den) for s in sets]
                row = chunk.first_row + np.repeat(np.arange(len(sets)), [len(p) for p in first])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.concatenate(first))), pa.array(ids[row]), pa.array(np.concatenate([np.arange(len(p), dtype=np.int32) for p in first])),
                     pa.array(np.array([len(s) for s in sets], dtype=np.int64)[row - chunk.first_row]), pa.array(component[row])],
                    names=["t", "id", "pos", "n", "component"])

    reps = stored(placed.where("id = rep AND n > 0").select("id", "component"), "representatives")
    small = reps.count() <= SMALL_IDS
    texts = docs.join(F.broadcast(reps) if small else reps, "id").select("id", "component", "text")
    return texts.mapInArrow(run, "t long, id long, pos int, n long, component long")


def prefix_pairs(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs (a < b) of representatives in different provisional components whose prefixes under
    the first order meet and that can still overlap enough.

    A shingle's documents of its most frequent component meet only those of the others, so a group of near copies
    with a few strangers in it costs its size times the strangers.
    """
    mixed = entries.groupBy("t").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("t")
    mixed = stored(mixed, "mixed-shingles")
    mixed_entries = stored(entries.join(mixed, "t", "left_semi"), "mixed-entries")
    shares = mixed_entries.groupBy("t", "component").count().groupBy("t").agg(
        F.max_by("component", F.struct("count", "component")).alias("major"), F.sum("count").alias("c"))
    shares = stored(shares, "shares")
    here = stored(join_groups(mixed_entries, shares, ["t"], "c").withColumn("minor", F.col("component") != F.col("major")).drop("major"), "placed-entries")
    forget(mixed, mixed_entries, shares)
    left = here.where("minor")
    right = here.select("t", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"), F.col("pos").alias("pb"), F.col("minor").alias("mb"))
    # At the first common shingle of a pair everything before is not common.
    needed = num * (F.col("n") + F.col("nb"))
    enough = (F.least(F.col("n") - F.col("pos"), F.col("nb") - F.col("pb")) * (num + den)) >= needed
    met = left.join(right, "t").where(
        (~F.col("mb") | (F.col("id") < F.col("b"))) & (F.col("component") != F.col("cb")) & close_sizes(F.col("n"), F.col("nb"), num, den) & enough)
    pairs = stored(met.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct(), "prefix-pairs")
    forget(here)
    return pairs


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs without the documents that are not their component's smallest; rows without id stay."""
    found = near_duplicate_components(docs, **options)
    later = found.where("component_id <> doc_id").select("doc_id")
    return docs.join(later, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
