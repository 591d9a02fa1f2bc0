"""Bounded, repeatable samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_SPAN = 1 << 30


def bounded_sample(rows: DataFrame, label: str, key: str, n: int, max_labels: int) -> DataFrame:
    """At most n rows of each of the max_labels most frequent labels, chosen by a hash of key.

    A first cut at a hash threshold, from the labels' counts, leaves some 4 n rows of a label, so the
    ranking that follows has no large group whatever the size of rows.
    """
    counts = rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(max_labels)
    cuts = counts.select(F.col(label), F.least(F.lit(_SPAN), F.ceil(F.lit(4.0 * n * _SPAN) / F.col("count")) + 1).alias("cut"))
    near = rows.join(F.broadcast(cuts), label).where(F.pmod(F.xxhash64(key), F.lit(_SPAN)) < F.col("cut"))
    nth = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(key), key))
    return near.withColumn("nth", nth).where(F.col("nth") <= n).drop("nth", "cut")
