"""Metres per pixel of a drawing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as tx
from ..sources.annotations import attr
from .groups import frequencies, mode_low
from .spatial import nearest_join

INCH = 0.0254


def upper_median(values: Column) -> Column:
    """The element in the middle of the sorted values, the upper one of two: an aggregate."""
    held = F.array_sort(F.collect_list(values))
    return F.get(held, F.floor(F.size(held) / 2).cast("int"))


def from_shapes(shapes: DataFrame) -> DataFrame:
    """(doc_id, scale, pairs): each written length by the length of the line nearest to it, and the upper median of those."""
    centre = g.mean_point(F.col("points"))
    dims = shapes.where(F.col("label").isin("dimension_val", "val_text") & (F.size("points") > 0)).select("doc_id", F.col("geom").alias("dim_geom"), F.col("ord").alias("dim_ord"), tx.length_metres(attr("text_content")).alias("metres"), centre.alias("at")).where("metres is not null")
    lines = shapes.where("geom = 'polyline' and size(points) >= 2").select("doc_id", F.col("ord").alias("line_ord"), g.length(F.col("points")).alias("px"), centre.alias("line_at")).where("px >= 20")
    apart = (F.col("line_at.x") - F.col("at.x")) * (F.col("line_at.x") - F.col("at.x")) + (F.col("line_at.y") - F.col("at.y")) * (F.col("line_at.y") - F.col("at.y"))
    paired = nearest_join(dims, lines, ["doc_id"], ["dim_geom", "dim_ord"], apart, ["line_ord"])
    return paired.groupBy("doc_id").agg(upper_median(F.col("metres") / F.col("nearest.px")).alias("scale"), F.count("*").alias("pairs"))


def from_pages(pages: DataFrame, width_px: str = "width_px") -> DataFrame:
    """(doc_id, page_no, ratio, m_per_pt, scale, dpi) by the 1:N that a page's text names most, the smaller of equals."""
    named = pages.select("doc_id", "page_no", "width_pt", width_px, F.explode(tx.ratios(F.col("text"))).alias("ratio"))
    chosen = mode_low(named, ["doc_id", "page_no", "width_pt", width_px], "ratio")
    per_point = F.col("ratio") / 72.0 * INCH
    return chosen.select("doc_id", "page_no", "ratio", per_point.alias("m_per_pt"), (per_point * F.col("width_pt") / F.col(width_px)).alias("scale"), F.round(F.col(width_px) / F.col("width_pt") * 72).cast("int").alias("dpi"))


def ratio_frequencies(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, ratio_freq): how often a page's text names each 1:N."""
    named = pages.select("doc_id", "page_no", F.explode(tx.ratios(F.col("text"))).alias("n"))
    return frequencies(named, ["doc_id", "page_no"], "n").withColumnRenamed("freq", "ratio_freq")


def resolve(manual: Column, written: Column) -> Column:
    """(scale, source): a positive manual scale, else that of the page's text, else missing."""
    return F.when(manual > 0, F.struct(manual.cast("double").alias("scale"), F.lit("manual").alias("source"))).when(written.isNotNull(), F.struct(written.alias("scale"), F.lit("pdf_vector_text").alias("source"))).otherwise(F.struct(F.lit(None).cast("double").alias("scale"), F.lit("missing").alias("source")))
