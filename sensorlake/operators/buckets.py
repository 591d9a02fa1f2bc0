"""Windows over one long recording as many tasks: time buckets with boundary summaries.

Rows are cut into buckets of `width` along the first order column, and windows run inside (keys, bucket).  What crosses a
boundary (the neighbouring row, the newest known value, the rows so far) comes from a summary with one row per bucket,
carried over the buckets of a key and joined back.  The summary is all that a key's window orders, so a recording of a year in
hourly buckets orders 8,760 rows, however many it holds.  Rows with a null order value come first, in a bucket of their own.

All functions keep the rows and columns of their input and add columns; `order` has to tell the rows of a key apart, as it
has to for any such window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: Default width, in units of the first order column (seconds).
WIDTH = 3600.0
_B = "__bucket"


def bucketed(df: DataFrame, by: str, width: float) -> DataFrame:
    return df.withColumn(_B, F.coalesce(F.floor(F.col(by) / F.lit(width)).cast("long"), F.lit(-(1 << 63))))


def _inside(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys, _B).orderBy(*order)


def _carried(df: DataFrame, keys: list[str], summary: list[Column], *steps: list[Column]) -> DataFrame:
    """df with the columns of the last step: windows over the summary, one row per bucket, joined to the bucket's rows."""
    own = [*keys, _B]
    buckets = df.groupBy(*own).agg(*summary)
    for columns in steps:
        buckets = buckets.select(*own, *columns)
    buckets = buckets.withColumnsRenamed({k: f"__of_{k}" for k in own})
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in own])
    return df.join(buckets, same, "left").drop(*[f"__of_{k}" for k in own])


def neighbours(df: DataFrame, keys: list[str], order: list[str], columns: list[str], width: float = WIDTH, before: str = "before", after: str = "after") -> DataFrame:
    """Adds structs of `columns` of the previous and of the next row of the key, null at its ends."""
    row, at, w, over = F.struct(*columns), F.struct(*order), _inside(keys, order), Window.partitionBy(*keys).orderBy(_B)
    inner = bucketed(df, order[0], width).withColumns({before: F.lag(row).over(w), after: F.lead(row).over(w)})
    out = _carried(inner, keys, [F.min_by(row, at).alias("__first"), F.max_by(row, at).alias("__last")],
                   [F.lag("__last").over(over).alias("__came"), F.lead("__first").over(over).alias("__comes")])
    return out.withColumns({before: F.coalesce(before, "__came"), after: F.coalesce(after, "__comes")}).drop("__came", "__comes", _B)


def observations(df: DataFrame, keys: list[str], order: list[str], observed: Column, columns: list[str], width: float = WIDTH,
                 before: str = "before", after: str = "after") -> DataFrame:
    """Adds structs of `columns` of the newest observed row up to each row and of the first one from it on."""
    cut = bucketed(df, order[0], width).withColumn("__seen", F.when(observed, F.struct(*columns)))
    at, over = F.struct(*order), Window.partitionBy(*keys).orderBy(_B)
    summary = [F.max_by("__seen", F.when(F.col("__seen").isNotNull(), at)).alias("__last"), F.min_by("__seen", F.when(F.col("__seen").isNotNull(), at)).alias("__first")]
    carry = [F.last("__last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("__came"),
             F.first("__first", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("__comes")]
    w = _inside(keys, order)
    inner = cut.withColumns({before: F.last("__seen", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
                             after: F.first("__seen", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    out = _carried(inner, keys, summary, carry)
    return out.withColumns({before: F.coalesce(before, "__came"), after: F.coalesce(after, "__comes")}).drop("__came", "__comes", "__seen", _B)


def row_numbers(df: DataFrame, keys: list[str], by: str, order: list[str], width: float = WIDTH, name: str = "nth") -> DataFrame:
    """Adds the number of each row in its key, from 1; order starts with `by`."""
    cut = bucketed(df, by, width)
    before = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    out = _carried(cut.withColumn(name, F.row_number().over(_inside(keys, order))), keys, [F.count("*").alias("__rows")],
                   [F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__so_far")])
    return out.withColumn(name, F.col(name) + F.col("__so_far")).drop("__so_far", _B)


def streaks(df: DataFrame, keys: list[str], order: list[str], hit: Column, width: float = WIDTH, name: str = "streak") -> DataFrame:
    """Adds the number of consecutive rows up to each one that are no hit (one with a null neither counts nor ends them)."""
    over, upto = Window.partitionBy(*keys).orderBy(_B), _inside(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    cut = bucketed(df, order[0], width).withColumn("__hit", hit)
    counted = cut.withColumn("__misses", F.count_if(~F.col("__hit")).over(upto))
    at_hit = F.when(F.col("__hit"), F.col("__misses"))  # misses of the bucket up to its hits
    counted = counted.withColumn("__base", F.max(at_hit).over(upto))
    out = _carried(counted, keys, [F.count_if(~F.col("__hit")).alias("__n"), F.max(at_hit).alias("__last")],
                   [F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__total"), "__last"],
                   [(F.col("__total") - F.coalesce(F.max(F.col("__total") + F.col("__last")).over(before), F.lit(0))).alias("__open")])
    return out.withColumn(name, F.col("__misses") - F.coalesce("__base", -F.col("__open"))).drop("__hit", "__misses", "__base", "__open", _B)


def histories(df: DataFrame, keys: list[str], order: list[str], value: str, k: int, width: float = WIDTH, name: str = "history") -> DataFrame:
    """Adds the list of the last k values that are not null among the last k rows, oldest first."""
    cut = bucketed(df, order[0], width)
    w, over = _inside(keys, order), Window.partitionBy(*keys).orderBy(_B)
    cell = F.struct(F.col(value).alias("v"))
    numbered = cut.withColumns({name: F.collect_list(cell).over(w.rowsBetween(-k + 1, 0)), "__back": F.row_number().over(Window.partitionBy(*keys, _B).orderBy(*[F.desc(c) for c in order]))})
    last = F.array_sort(F.collect_list(F.when(F.col("__back") <= k, F.struct((-F.col("__back")).alias("o"), cell.alias("c")))))
    earlier = F.flatten(F.collect_list("__tail").over(over.rowsBetween(-k, -1)))
    out = _carried(numbered, keys, [F.transform(last, lambda x: x["c"]).alias("__tail")], [earlier.alias("__came")])
    joined = F.concat(F.coalesce("__came", F.array().cast(numbered.schema[name].dataType)), F.col(name))
    tail = F.slice(joined, F.greatest(F.size(joined) - k + 1, F.lit(1)), k)
    return out.withColumn(name, F.filter(F.transform(tail, lambda x: x["v"]), lambda v: v.isNotNull())).drop("__came", "__back", _B)
