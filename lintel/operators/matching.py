"""Matching files and drawings by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def _best(pairs: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return pairs.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def best_by_name(left: DataFrame, right: DataFrame, least: int = 1) -> DataFrame:
    """(path, match, score): each left path with the right path whose normal stem fits best, the first path of equals.

    A name that holds the other scores 1000 and its length; else each character of the right name that the left one
    has scores one. Names meet by the characters that they share, which the sum of their counts turns into the score,
    so names without a common character never meet; a name without characters is held by every other.
    """
    names = lambda df, side: df.select(F.col("path").alias(side), F.lower(tx.normal_stem(F.col("path"))).alias(f"{side}_name"))
    letters = lambda side: F.filter(F.split(F.col(f"{side}_name"), ""), lambda c: c != "")
    none = F.array(F.lit(""))
    spread = lambda side, empty: F.explode(F.when(F.col(f"{side}_name") == "", empty).otherwise(F.concat(F.array_distinct(letters(side)), none))).alias("c")
    one = names(left, "l").select("l", "l_name", spread("l", none))
    # the blank stands for all names: only a name without characters meets others by it
    two = names(right, "r").select("r", "r_name", spread("r", none)).where((F.col("c") != "") | (F.col("r_name") == "")).withColumn("n", F.size(F.filter(letters("r"), lambda x: x == F.col("c"))))
    lone = names(left, "l").where("l_name = ''").select("l", "l_name").withColumn("c", F.lit("all"))
    every = names(right, "r").where("r_name <> ''").select("r", "r_name", F.lit("all").alias("c"), F.lit(0).alias("n"))
    shared = one.join(two, "c").unionByName(lone.join(every, "c")).groupBy("l", "l_name", "r", "r_name").agg(F.sum("n").cast("int").alias("n"))
    held = F.contains("l_name", F.col("r_name")) | F.contains("r_name", F.col("l_name"))
    scored = shared.withColumn("score", F.when(held, 1000 + F.length("r_name")).otherwise(F.col("n"))).where(F.col("score") >= least)
    return _best(scored, ["l"], [F.col("score").desc(), F.col("r")]).select(F.col("l").alias("path"), F.col("r").alias("match"), "score")


#: Characters of a gram by which a text and what it may hold meet.
_GRAM = 3


def _holding(texts: DataFrame, parts: DataFrame, text: str, part: str) -> DataFrame:
    """The rows of both sides where a text holds a part: they meet by the part's first gram, then the whole is sought."""
    n = F.length(text)
    grams = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substring(F.col(text), i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    spread = texts.withColumn("__g", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *(grams(k) for k in range(1, _GRAM + 1))))))
    return spread.join(parts.withColumn("__g", F.substring(part, 1, _GRAM)), "__g").where(F.contains(text, F.col(part))).drop("__g")


def locate_images(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(name, path): each wanted image name with a file: of its exact name, in an images folder first, or of its stem."""
    by_stem = wanted.select("name", tx.stem(F.col("name")).alias("stem"))
    found = by_stem.join(files.select("path", F.col("name").alias("file"), F.col("stem")), "stem")
    rank = F.when(F.col("file") == F.col("name"), F.when(F.col("path").contains("/images/"), 1).otherwise(0)).otherwise(2)
    return _best(found.where(F.lower("file").rlike("\\.(jpg|jpeg|png|bmp|tif|tiff)$")), ["name"], [rank, F.col("path")]).select("name", "path")


def first_containing(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, path): each left name with the first right row (path, body) whose text has the name or its stem.

    A text that has the name has its stem, so stems are sought.
    """
    wanted = left.select("name", tx.stem(F.col("name")).alias("stem"))
    found = _holding(right.select("path", "body"), wanted, "body", "stem").groupBy("name").agg(F.min("path").alias("path"))
    return left.join(found, "name", "left").select("name", "path").where("path is not null")


def drawing_to_annotation(drawings: DataFrame, annotations: DataFrame) -> DataFrame:
    """(path, match): the first annotation file of a drawing's station, and of its kind where some are."""
    told = lambda df, side: df.select(F.col("path").alias(side), tx.station_name(tx.stem(F.col("path"))).alias("station"), tx.drawing_kind(tx.stem(F.col("path"))).alias(f"{side}_kind"))
    pairs = told(drawings, "d").join(told(annotations, "a"), "station")
    other = F.when(F.col("d_kind") == F.col("a_kind"), 0).otherwise(1)
    return _best(pairs, ["d"], [other, F.col("a")]).select(F.col("d").alias("path"), F.col("a").alias("match"))


def values_to_numbers(findings: DataFrame, numbers: DataFrame) -> DataFrame:
    """Findings (doc_id, value_num, ...) with `box`: that of the read number (doc_id, num_ord, value, box) equal to two digits, else to one; the first of several.

    Numbers meet findings by their value in hundredths and in tenths. Each row of findings stays, equal ones too.
    """
    read = numbers.select("doc_id", "num_ord", "value", "box")
    places = F.explode(F.array(*(F.struct(F.lit(2 - d).alias("c"), F.round("value", d).alias("v")) for d in (2, 1)))).alias("at")
    by_value = read.select("doc_id", "num_ord", "box", places).groupBy("doc_id", "at").agg(F.min(F.struct("num_ord", "box")).alias("first"))
    side = lambda c, name: by_value.where(F.col("at.c") == c).select("doc_id", F.col("at.v").alias(f"__v{c}"), F.col("first.box").alias(name))
    keyed = findings.withColumn("__v0", F.round("value_num", 2)).withColumn("__v1", F.round("value_num", 1))
    found = keyed.join(side(0, "__two"), ["doc_id", "__v0"], "left").join(side(1, "__one"), ["doc_id", "__v1"], "left")
    return found.select(*findings.columns, F.coalesce("__two", "__one").alias("box"))


def results_of_images(images: DataFrame, results: DataFrame) -> DataFrame:
    """(image, result): each image name with the result of its name, else one whose name holds its stem, else the first by name."""
    wanted = images.select("image", tx.stem(F.col("image")).alias("stem"))
    named = results.select("name", "result")
    exact = wanted.join(named, F.col("image") == F.col("name")).select("image", F.lit(0).alias("rank"), "name", "result")
    held = _holding(named, wanted, "name", "stem").select("image", F.lit(1).alias("rank"), "name", "result")
    best = _best(exact.unionByName(held), ["image"], [F.col("rank"), F.col("name")]).select("image", "result")
    # one row, joined by a constant
    first = named.agg(F.min(F.struct("name", "result")).alias("f")).select(F.lit(0).alias("__k"), F.col("f.result").alias("first"))
    return wanted.withColumn("__k", F.lit(0)).join(F.broadcast(first), "__k").join(best, "image", "left").select("image", F.coalesce("result", "first").alias("result"))
