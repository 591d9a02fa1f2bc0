"""Exact quantiles of groups of any size, by histogram refinement.

A quantile with linear interpolation needs the values at one or two ranks.  Every round counts a group's values in equal
ranges, keeps for each wanted rank the range that holds it with its least and largest value, and cuts that range again until
one value is left.  Counts are partially aggregated, so a task holds counts and never a large group's values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorlake.operators.skew import HOT_KEYS
from sensorlake.scratch import forget, stored

#: Ranges that a round cuts a range into.
CUTS = 1024
#: Groups of up to so many rows are sorted by one task, whatever their share of the rows.
SORTED = 100_000


def _place(v: Column, lo: Column, hi: Column) -> Column:
    """The number of v's range between lo and hi; larger values never have a smaller number."""
    return F.when(hi > lo, F.least(F.floor((v / 2 - lo / 2) / (hi / 2 - lo / 2) * CUTS), F.lit(CUTS - 1))).otherwise(F.lit(0)).cast("int")


def quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, list[float]]], hot: int = HOT_KEYS, most: int = SORTED) -> DataFrame:
    """(keys, n, and for each name of wanted the list of quantiles of a column): as `percentile` gives them, with n the rows.

    Groups with more than `most` rows and more than one in `hot` of all rows are refined; those are at most `hot` groups, so
    their ranges are broadcast.  The other groups are sorted by their tasks.  Null and non-finite values do not count; a
    group without others has null quantiles.  df is read once a round and should be a written table or a cheap scan.
    """
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c).cast("double"))
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    rows = df.select(*keys, *[finite(c).alias(f"__v{i}") for i, c in enumerate(columns)])
    sizes = stored(rows.groupBy(*keys).agg(F.count("*").alias("n"), *[
        f(f"__v{i}").alias(f"__{n}{i}") for i in range(len(columns)) for f, n in ((F.count, "n"), (F.min, "lo"), (F.max, "hi"))]), "group-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    large = F.col("n") > max(most, total // hot)
    names = [f"__of{i}" for i in range(len(keys))]
    big = sizes.where(large).select(*[F.col(k).alias(o) for k, o in zip(keys, names, strict=True)], "*").drop(*keys)
    each = [F.percentile(f"__v{columns.index(c)}", F.array(*map(F.lit, qs))).alias(name) for name, (c, qs) in wanted.items()]
    sort = lambda some: some.groupBy(*keys).agg(F.count("*").alias("n"), *each)
    if big.isEmpty():
        return sort(rows)
    small = rows.join(F.broadcast(big.select(*names)), _all([F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, names, strict=True)]), "left_anti")
    return sort(small).unionByName(_refined(rows, sizes.where(large), keys, columns, wanted))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _refined(rows: DataFrame, sizes: DataFrame, keys: list[str], columns: list[str], wanted: dict[str, tuple[str, list[float]]]) -> DataFrame:
    key = F.struct(*keys)
    position = lambda i, q: (F.col(f"__n{i}") - 1) * F.lit(float(q))
    ranks = [(i, q, f) for i, q in sorted({(columns.index(c), float(q)) for c, qs in wanted.values() for q in qs}) for f in (F.floor, F.ceil)]
    starts = F.array(*[F.struct(F.lit(i).alias("i"), f(position(i, q)).cast("long").alias("rank"), F.col(f"__lo{i}").alias("lo"), F.col(f"__hi{i}").alias("hi"),
                                F.lit(0).cast("long").alias("below")) for i, q, f in ranks])
    spans = sizes.select(key.alias("key"), F.explode(starts).alias("s")).select("key", "s.*").where("lo IS NOT NULL").distinct()
    spans = stored(spans, "ranges")
    values = rows.select(key.alias("key"), F.posexplode(F.array(*[f"__v{i}" for i in range(len(columns))])).alias("i", "v")).where("v IS NOT NULL")
    while not spans.where("lo < hi").isEmpty():
        opened = F.broadcast(spans.where("lo < hi").select(F.col("key").alias("k"), F.col("i").alias("j"), "lo", "hi", "below").distinct())
        inside = values.join(opened, F.col("key").eqNullSafe(F.col("k")) & (F.col("i") == F.col("j")) & F.col("v").between(F.col("lo"), F.col("hi")))
        cells = inside.groupBy("k", "j", "lo", "hi", "below", _place(F.col("v"), F.col("lo"), F.col("hi")).alias("cell")).agg(
            F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("largest"))
        upto = Window.partitionBy("k", "j", "lo", "hi").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        cells = cells.withColumn("end", F.col("below") + F.sum("c").over(upto)).withColumnsRenamed({"lo": "from", "hi": "to"}).drop("below")
        same = F.col("key").eqNullSafe(F.col("k")) & (F.col("i") == F.col("j")) & (F.col("lo") == F.col("from")) & (F.col("hi") == F.col("to"))
        cut = spans.where("lo < hi").join(cells, same & (F.col("rank") < F.col("end")) & (F.col("rank") >= F.col("end") - F.col("c"))).select(
            "key", "i", "rank", F.col("least").alias("lo"), F.col("largest").alias("hi"), (F.col("end") - F.col("c")).alias("below"))
        step = stored(spans.where("lo >= hi").unionByName(cut), "ranges")
        forget(spans)
        spans = step
    found = spans.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("i", "rank"), "lo"))).alias("at"))
    told = sizes.join(found.withColumnRenamed("key", "k"), key.eqNullSafe(F.col("k")), "left")

    def value(i: int, q: float) -> Column:
        p = position(i, q)
        low, high = F.floor(p).cast("long"), F.ceil(p).cast("long")
        at = lambda r: F.try_element_at("at", F.struct(F.lit(i).alias("i"), r.alias("rank")))
        return F.when((low == high) | (at(low) == at(high)), at(low)).otherwise(at(low) * (high - p) + at(high) * (p - low))

    lists = {name: F.when(F.col(f"__n{columns.index(c)}") > 0, F.array(*[value(columns.index(c), q) for q in qs])).alias(name) for name, (c, qs) in wanted.items()}
    return told.select(*keys, "n", *lists.values())
