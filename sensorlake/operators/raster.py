"""Point clouds to pictures, as aggregates by pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.functions.records import canvas, height_colour


def raster(points: DataFrame, keys: list[str], x_limits: tuple[float, float], y_limits: tuple[float, float], size: tuple[int, int],
           heights: tuple[float, float], depth: Column | None = None, clip: bool = True) -> DataFrame:
    """(keys, px, py, points, z, b, g, r): the pixels that points hit, each with the height and colour of the point in front.

    In front is the point of the largest depth, by default its height (a view from above); on ties the higher one.  Points
    beyond the limits go to the rim, or with clip=False nowhere.  One aggregate with partial sums: however many points a
    picture or a pixel has, no task holds them.  Points with a null or NaN coordinate are in no pixel.
    """
    ok = [F.col(c).isNotNull() & ~F.isnan(c) for c in "xyz"]
    seen = points.where(ok[0] & ok[1] & ok[2])
    if not clip:
        seen = seen.where(F.col("x").between(*x_limits) & F.col("y").between(*y_limits))
    px, py = canvas(F.col("x"), F.col("y"), x_limits, y_limits, size)
    front = F.max(F.struct((F.col("z") if depth is None else depth).alias("depth"), "z")).alias("front")
    cells = seen.select(*keys, px.alias("px"), py.alias("py"), "x", "y", "z").groupBy(*keys, "px", "py").agg(F.count("*").alias("points"), front)
    shown = cells.select(*keys, "px", "py", "points", F.col("front.z").alias("z"))
    return shown.withColumn("c", height_colour(F.col("z"), *heights)).select(*keys, "px", "py", "points", "z", "c.b", "c.g", "c.r")


def scanlines(pixels: DataFrame, keys: list[str], size: tuple[int, int], background: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """(keys, py, hex): the lines of each picture from raster's pixels, as hex digits of BGR bytes; lines without a pixel are left out.

    A line is bounded by the picture's width; `unhex` gives its bytes.
    """
    width, none = size[0], "".join(f"{v:02X}" for v in background)
    colour = F.concat(*[F.lpad(F.hex(F.col(c).cast("long")), 2, "0") for c in "bgr"])
    lines = pixels.select(*keys, "py", "px", colour.alias("c")).groupBy(*keys, "py").agg(F.map_from_entries(F.collect_list(F.struct("px", "c"))).alias("m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(none)))
    return lines.select(*keys, "py", F.array_join(every, "").alias("hex"))
