"""Sinks: annotation XML, JSON, training labels and texts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocab import CLASSES, ENUMS, LABELS


def write_annotations(shapes: DataFrame, path: str) -> None:
    """Shapes as annotation XML: a directory of <annotations> files with an <image> for each image.

    A `source` column, as candidates have it (auto or auto_review), becomes an attribute of each shape.
    """
    source = [F.col("source").alias("_source")] if "source" in shapes.columns else []
    number = lambda c: F.format_string("%.2f", c)
    at = lambda i: F.get("points", F.lit(i))
    attribute = F.transform("attrs", lambda a: F.struct(a["name"].alias("_name"), a["value"].alias("_VALUE"))).alias("attribute")
    listed = F.array_join(F.transform("points", lambda p: F.concat(number(p["x"]), F.lit(","), number(p["y"]))), ";").alias("_points")
    box = F.struct(F.col("label").alias("_label"), number(at(0)["x"]).alias("_xtl"), number(at(0)["y"]).alias("_ytl"), number(at(1)["x"]).alias("_xbr"), number(at(1)["y"]).alias("_ybr"), *source, attribute)
    drawn = F.struct(F.col("label").alias("_label"), listed, *source, attribute)

    def gathered(geom: str, item: Column) -> Column:
        held = F.array_sort(F.collect_list(F.when(F.col("geom") == geom, F.struct("ord", item.alias("item")))))
        return F.transform(held, lambda x: x["item"]).alias(geom)

    images = shapes.groupBy(F.col("image").alias("_name"), F.col("width").cast("int").alias("_width"), F.col("height").cast("int").alias("_height")).agg(gathered("box", box), gathered("polygon", drawn), gathered("polyline", drawn))
    images.write.format("xml").option("rootTag", "annotations").option("rowTag", "image").mode("overwrite").save(path)


def write_json(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


def write_training_labels(samples: DataFrame, path: str) -> None:
    """Label lines of samples (split, name, lines) as text, in a directory for each split."""
    samples.select("split", "name", F.array_join("lines", "\n").alias("value")).write.mode("overwrite").partitionBy("split", "name").text(path)


def training_config(root: str) -> str:
    """The data.yaml of a training set."""
    names = "\n".join(f"  {i}: {name}" for i, name in enumerate(CLASSES))
    return f"path: {root}\ntrain: images/train\nval: images/val\ntest: images/test\n\nnc: {len(CLASSES)}\nnames:\n{names}\n"


def label_template() -> str:
    """The vocabulary as a label template for the annotation tool."""
    kinds = {"box": "rectangle", "polygon": "polygon", "polyline": "polyline"}
    attribute = lambda a: {"name": a, "input_type": "select" if a in ENUMS else "text", "mutable": False, "values": list(ENUMS.get(a, ("",)))}
    return json.dumps([{"name": name, "type": kinds[spec.geom], "attributes": [attribute(a) for a in spec.attrs]} for name, spec in LABELS.items()], ensure_ascii=False, indent=2)
