"""Annotation XML (CVAT 1.1) and JSON sources, and the contracts of external adapters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g
from ..functions.base import lookup
from ..functions.text import numbers
from ..vocab import ENGLISH

_ATTRIBUTE = "array<struct<_VALUE:string,_name:string>>"
IMAGE_XML = f"""_id int, _name string, _width double, _height double,
  box array<struct<_label:string,_xtl:double,_ytl:double,_xbr:double,_ybr:double,attribute:{_ATTRIBUTE}>>,
  polygon array<struct<_label:string,_points:string,attribute:{_ATTRIBUTE}>>,
  polyline array<struct<_label:string,_points:string,attribute:{_ATTRIBUTE}>>,
  _corrupt_record string"""
SHAPES = f"doc_id string, file string, image string, width double, height double, geom string, ord int, label string, points {g.POINTS}, attrs array<struct<name:string,value:string>>"

#: Contracts of adapters outside this engine: PDF text and vectors, OCR, detection models.
CONTRACTS = {
    "pages": "doc_id string, page_no int, width_pt double, height_pt double, text string",
    "text_blocks": "doc_id string, page_no int, block_ord int, text string, bbox array<double>",
    "draw_ops": "doc_id string, page_no int, op_ord int, kind string, x0 double, y0 double, x1 double, y1 double, color array<double>",
    "ocr_words": "doc_id string, cx double, cy double, text string, box array<double>",
    "ocr_numbers": "doc_id string, num_ord int, cx double, cy double, value double, box array<double>",
    "raw_detections": f"doc_id string, tile int, cls_id int, cls_name string, conf double, box array<double>, polygon {g.POINTS}",
    "station_meta": "doc_id string, type string, height_m double, transfer_lines int, project_all_doors_class_A boolean, is_shared_concourse boolean",
}


def contract(name: str) -> T.StructType:
    """The schema that an adapter's table must have."""
    return T.StructType.fromDDL(CONTRACTS[name])


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """One row for each image of the XML files under a path; doc_id is file and id, or name without one. Files that cannot be parsed give rows with `corrupt`."""
    raw = spark.read.format("xml").option("rowTag", "image").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("recursiveFileLookup", "true").schema(IMAGE_XML).load(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.coalesce("_id", F.lit(0)).alias("image_ord"),
        F.coalesce(F.col("_id").cast("string"), F.col("_name"), F.lit("0")).alias("image_key"),
        F.coalesce("_name", F.lit("")).alias("image"),
        F.coalesce("_width", F.lit(0.0)).alias("width"),
        F.coalesce("_height", F.lit(0.0)).alias("height"),
        "box",
        "polygon",
        "polyline",
        # with another column beside it, as the reader refuses queries for the corrupt record alone
        F.when(F.col("_name").isNull(), F.col("_corrupt_record")).alias("corrupt"),
    ).withColumn("doc_id", F.concat_ws("#", "file", F.col("image_key"))).drop("image_key")


def _attributes(item: Column) -> Column:
    """Names and trimmed values in order; null values become empty."""
    return F.transform(F.coalesce(item["attribute"], F.array().cast(_ATTRIBUTE)), lambda a: F.struct(F.coalesce(a["_name"], F.lit("")).alias("name"), F.trim(F.coalesce(a["_VALUE"], F.lit(""))).alias("value")))


def attr(name: str, attrs: Column | str = "attrs") -> Column:
    """The last value of an attribute; empty where it is absent."""
    column = F.col(attrs) if isinstance(attrs, str) else attrs
    return F.coalesce(F.try_element_at(F.filter(column, lambda a: a["name"] == name), F.lit(-1))["value"], F.lit(""))


def first_attr(*names: str, attrs: str = "attrs") -> Column:
    """The first of some attributes that is not blank; empty where all are."""
    return F.coalesce(*(F.when(F.trim(attr(n, attrs)) != "", attr(n, attrs)) for n in names), F.lit(""))


def first_images(images: DataFrame) -> DataFrame:
    """The first image that can be read of each file: a site scan looks at no other."""
    first = images.where(F.col("corrupt").isNull()).groupBy("file").agg(F.min("image_ord").alias("image_ord"))
    return images.where(F.col("corrupt").isNull()).join(first, ["file", "image_ord"], "left_semi")


def shapes_of(images: DataFrame) -> DataFrame:
    """One row for each shape: its geometry, its place within that geometry, label, points and attributes."""
    parts = []
    for geom in ("box", "polygon", "polyline"):
        rows = images.where(F.col("corrupt").isNull()).select("doc_id", "file", "image", "width", "height", F.posexplode(geom).alias("ord", "s"))
        s = F.col("s")
        points = F.array(g.point(s["_xtl"], s["_ytl"]), g.point(s["_xbr"], s["_ybr"])) if geom == "box" else g.parse_points(s["_points"])
        parts.append(rows.select("doc_id", "file", "image", "width", "height", F.lit(geom).alias("geom"), "ord", F.coalesce(s["_label"], F.lit("")).alias("label"), points.alias("points"), _attributes(s).alias("attrs")))
    return reduce(DataFrame.unionByName, parts)


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    return shapes_of(read_images(spark, path))


def english(shapes: DataFrame) -> DataFrame:
    """Chinese labels and attribute names renamed; what the map lacks stays."""
    named = lambda c: F.coalesce(lookup(ENGLISH, c), c)
    return shapes.withColumn("label", named(F.col("label"))).withColumn("attrs", F.transform("attrs", lambda a: F.struct(named(a["name"]).alias("name"), a["value"].alias("value"))))


def conversion_counts(shapes: DataFrame) -> DataFrame:
    """(kind, name, converted, unmapped, n) of labels and attribute names before english()."""
    labels = shapes.select(F.lit("label").alias("kind"), F.col("label").alias("name"))
    attrs = shapes.select(F.lit("attribute").alias("kind"), F.explode("attrs.name").alias("name"))
    known = lookup(ENGLISH, F.col("name")).isNotNull()
    return labels.unionByName(attrs).select("*", known.alias("converted"), (~known & F.col("name").rlike("[\\x{4e00}-\\x{9fff}]")).alias("unmapped")).groupBy("kind", "name", "converted", "unmapped").agg(F.count("*").alias("n"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, body) of JSON files, each a whole document."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("body"))


def numbers_of_words(words: DataFrame, least: float, most: float) -> DataFrame:
    """(doc_id, num_ord, cx, cy, value, box): the numbers within bounds that words (doc_id, word_ord, cx, cy, text, box) hold."""
    found = words.select("doc_id", "word_ord", "cx", "cy", "box", F.posexplode(numbers(F.col("text"), least, most)).alias("at", "value"))
    return found.select("doc_id", (F.col("word_ord") * 1_000 + F.col("at")).cast("int").alias("num_ord"), "cx", "cy", "value", "box")


def list_files(spark: SparkSession, path: str, *patterns: str) -> DataFrame:
    """(path, name, stem) of files under a path that fit one of some patterns, without their content."""
    read = lambda p: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", p).load(path).select("path")
    files = reduce(DataFrame.unionByName, map(read, patterns))
    name = F.substring_index("path", "/", -1)
    return files.select("path", name.alias("name"), F.regexp_replace(name, "\\.[^.]*$", "").alias("stem"))


def read_training_metrics(spark: SparkSession, path: str) -> DataFrame:
    """One row for each epoch of a training log in CSV, numbers as doubles and names trimmed."""
    raw = spark.read.option("header", "true").option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true").csv(path)
    return raw.select(*(F.col(f"`{c}`").try_cast("double").alias(c.strip()) for c in raw.columns))
