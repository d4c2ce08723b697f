"""Training sets: clipped and normalised labels by tile, and a deterministic split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators.detect import training_tiles
from ..operators.matching import locate_images
from ..vocab import CLASSES

FEW = 150


def class_id(label: Column) -> Column:
    return F.try_element_at(F.create_map(*(x for i, name in enumerate(CLASSES) for x in (F.lit(name), F.lit(i)))), label)


def usable_images(images: DataFrame, files: DataFrame) -> DataFrame:
    """The images that can be read and whose picture is among files (path, name, stem), with its `path`; files that cannot be parsed and images without a picture go."""
    read = images.where(F.col("corrupt").isNull())
    return read.join(locate_images(read.select(F.col("image").alias("name")).distinct(), files).withColumnRenamed("name", "image"), "image")


def samples(shapes: DataFrame, tile: int | None = None, overlap: int = 200) -> DataFrame:
    """(doc_id, name, tx, ty, lines): label lines of each tile, or whole image, that has any; lines and lone shapes are left out."""
    two = F.size("points") == 2
    corner = lambda i: F.get("points", F.lit(i))
    ring = F.when((F.col("geom") == "box") & two, g.box_ring(corner(0)["x"], corner(0)["y"], corner(1)["x"], corner(1)["y"])).otherwise(F.col("points"))
    kept = shapes.where(F.col("geom") != "polyline").select("doc_id", "image", "width", "height", "geom", "ord", class_id(F.col("label")).alias("cls"), ring.alias("ring")).where("cls is not null and size(ring) >= 3")
    images = kept.select("doc_id", "image", "width", "height").distinct()
    tiles = training_tiles(images, tile or 1 << 30, overlap)
    placed = kept.join(tiles, "doc_id")
    b = g.bounds(F.col("ring"))
    x, y, w, h = (F.col(c) for c in ("tx", "ty", "tw", "th"))
    touching = placed.where((b["x1"] > x) & (b["x0"] < x + w) & (b["y1"] > y) & (b["y0"] < y + h))
    clipped = touching.withColumn("piece", g.clamp_to(F.col("ring"), x, y, x + w, y + h)).where("piece is not null")
    line = F.struct("geom", "ord", g.label_line(F.col("cls"), F.col("piece"), w, h).alias("line"))
    gathered = clipped.groupBy("doc_id", "image", "tx", "ty").agg(F.transform(F.array_sort(F.collect_list(line)), lambda v: v["line"]).alias("lines"))
    stem = F.regexp_replace("image", "^.*/|\\.[^.]*$", "")
    numbered = gathered.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("ty", "tx")) - 1)
    return numbered.select("doc_id", (F.concat(stem, F.lit("_t"), F.col("n").cast("string")) if tile else stem).alias("name"), "tx", "ty", "lines")


def split(rows: DataFrame, name: str = "name", seed: str = "0", test: float = 0.1, val: float = 0.1) -> DataFrame:
    """rows with `split`: the first parts by the md5 of seed and name are test and val, at least one each, and the rest train.

    Ranks are taken in buckets of the hash, so no window holds all rows: counts of 4096 buckets give the rank at which
    each begins.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}-"), F.col(name).cast("string")))
    hashed = rows.withColumn("__md5", digest).withColumn("__b", F.conv(F.substring(digest, 1, 3), 16, 10).cast("int"))
    counts = hashed.groupBy("__b").agg(F.count("*").alias("__n"))
    starts = counts.select("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    ranked = hashed.join(F.broadcast(starts), "__b").withColumn("__at", F.col("__start") + F.row_number().over(Window.partitionBy("__b").orderBy("__md5", name)) - 1)
    part = lambda share: F.greatest(F.lit(1), F.floor(F.col("__all") * share))
    told = F.when(F.col("__at") < part(test), "test").when(F.col("__at") < part(test) + part(val), "val").otherwise("train")
    return ranked.withColumn("split", told).drop("__md5", "__b", "__start", "__all", "__at")


def class_counts(rows: DataFrame) -> DataFrame:
    """(cls, class, n, note) of all classes: how many label lines each has; few, or none."""
    classes = rows.sparkSession.createDataFrame(list(enumerate(CLASSES)), "cls int, class string")
    counted = rows.select(F.explode("lines").alias("line")).groupBy(F.substring_index("line", " ", 1).cast("int").alias("cls")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return F.broadcast(classes).join(counted, "cls", "left").select("cls", "class", n.alias("n"), F.when(n == 0, "none").when(n < FEW, "few").otherwise("").alias("note"))
