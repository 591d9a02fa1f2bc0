"""Relational forms of segmentation post-processing: per-query class scores joined with per-pixel mask scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def semantic(classes: DataFrame, masks: DataFrame, image: str) -> DataFrame:
    """(image, pixel, class_id, score): mask scores weighted by class scores, summed over the queries, best class per pixel.

    classes(image, query, class_id, p) without the class for nothing; masks(image, query, pixel, m).
    """
    votes = masks.join(classes, [image, "query"]).groupBy(image, "pixel", "class_id").agg(F.sum(F.col("p") * F.col("m")).alias("score"))
    return votes.groupBy(image, "pixel").agg(F.max_by("class_id", F.struct("score", -F.col("class_id"))).alias("class_id"), F.max("score").alias("score"))


def panoptic(classes: DataFrame, masks: DataFrame, image: str, least_score: float = 0.8, least_overlap: float = 0.8, things: tuple[int, ...] = ()) -> DataFrame:
    """(image, pixel, segment, class_id): confident queries compete for pixels by score times mask; a query that keeps
    too small a part of its own mask goes; queries of one stuff class share a segment; segments count from 1."""
    best = classes.groupBy(image, "query").agg(F.max_by("class_id", F.struct("p", -F.col("class_id"))).alias("class_id"), F.max("p").alias("p")).where(F.col("p") > least_score)
    scored = masks.join(best, [image, "query"]).withColumn("w", F.col("p") * F.col("m"))
    area = scored.where("m >= 0.5").groupBy(image, "query").agg(F.count("*").alias("area"))
    won = scored.groupBy(image, "pixel").agg(F.max_by(F.struct("query", "class_id", "m"), F.struct("w", -F.col("query"))).alias("b")).select(image, "pixel", "b.*").where("m >= 0.5")
    kept = won.groupBy(image, "query", "class_id").agg(F.count("*").alias("n")).join(area, [image, "query"]).where(F.col("n") >= least_overlap * F.col("area"))
    unit = F.when(F.col("class_id").isin(*things) if things else F.lit(False), F.col("query")).otherwise(F.lit(-1))
    named = kept.withColumn("__unit", unit)
    first = named.groupBy(image, "class_id", "__unit").agg(F.min("query").alias("__first"))
    ids = first.withColumn("segment", F.row_number().over(Window.partitionBy(image).orderBy("__first")))
    return won.join(named.join(ids, [image, "class_id", "__unit"]).select(image, "query", "segment"), [image, "query"]).select(image, "pixel", "segment", "class_id")


def remap_categories(annotations: DataFrame, categories: DataFrame, column: str = "category_id") -> DataFrame:
    """annotations with their category as a contiguous number from 0, in the order of the registry's ids.

    categories(id, ...) is a data set's registry, a small dimension; annotations of other categories are left out.
    """
    ids = categories.groupBy().agg(F.array_sort(F.collect_set("id")).alias("ids")).select(F.posexplode("ids").alias("__n", column))
    return annotations.join(F.broadcast(ids), column).withColumn(column, F.col("__n")).select(annotations.columns)


def instances(classes: DataFrame, masks: DataFrame, image: str, k: int = 100) -> DataFrame:
    """(image, query, class_id, score): the k best (query, class) of an image, times the mean mask score inside the mask."""
    inside = masks.groupBy(image, "query").agg((F.sum(F.when(F.col("m") > 0.5, F.col("m"))) / (F.count_if(F.col("m") > 0.5) + 1e-6)).alias("__q"))
    nth = F.row_number().over(Window.partitionBy(image).orderBy(F.desc("p"), "query", "class_id"))
    top = classes.withColumn("__n", nth).where(F.col("__n") <= k)
    return top.join(inside, [image, "query"]).select(image, "query", "class_id", (F.col("p") * F.coalesce("__q", F.lit(0.0))).alias("score"))
