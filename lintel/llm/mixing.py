"""Mixing sources to target weights by hash-threshold histograms; DataFrame operations only.

Sizes are summed by source and hash bucket, running sums find the bucket in which a source's budget ends, only that
bucket is split again by the next bits of the hash, and documents are then taken by comparing their hash with the
threshold of their source. Nothing is sorted but histograms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import if_small, n_plain_words, settle

#: Bits of hash that one histogram resolves, and how many histograms refine each other.
BITS, LEVELS = 10, 3
WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_REPEATS = 2


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, target of each source, given (source, source_size).

    Sources in code-point order, null last, take the weights in turn. The budget is share_percent of all sizes; a
    source takes most times its size at most, and what that leaves goes to the others by weight until none is above.
    That is the level at which sum(min(cap, level * weight)) meets the budget: with sources ordered by cap / weight,
    the level after the k first are capped is (budget - their caps) / (weights of the rest), and the first that does
    not exceed the next ratio holds. The table has a row for each source; the windows see nothing else.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    ranked = sizes.select("source", "source_size", F.get(cycle, ((F.row_number().over(in_order) - 1) % len(weights)).cast("int")).cast("double").alias("w"), (F.lit(float(most)) * F.col("source_size")).alias("cap"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), zero)) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), zero))
    leveled = ranked.withColumn("budget", F.sum("source_size").over(everything) * (share_percent / 100.0)).withColumn("all_w", F.sum("w").over(everything)).withColumn("level", level).withColumn("place", F.row_number().over(by_ratio))
    first = F.struct(F.col("place"), F.col("level"))
    holds = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), first)).over(everything)["level"]
    return leveled.withColumn("holds", holds).select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("holds") * F.col("w"), F.col("cap"))).alias("target"))


def _part(h: Column, level: int) -> Column:
    """Bits of the 30-bit hash that the histograms up to level have seen."""
    return F.shiftright(h, BITS * (LEVELS - level - 1))


def _hash(key: Column, text: Column, seed: int) -> Column:
    """The first BITS * LEVELS bits of an md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(key.cast("string"), text, F.lit(""))))
    return F.shiftright(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), 32 - BITS * LEVELS)


def _copies(h: Column) -> Column:
    again = F.when(h < F.col("threshold"), F.lit(1)).otherwise(F.lit(0))
    return F.when(F.col("target") > F.col("source_size"), 1 + again).otherwise(again)


def thresholds(docs: DataFrame, key: str, text: str, source: str, weights: tuple[int, ...], share_percent: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(key, source, size, h) of each document, and (s, source_size, target, threshold) of each source."""
    slim = settle(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), n_plain_words(F.col(text)).alias("size"), _hash(F.col(key), F.col(text), seed).alias("h")), "mix-sizes")
    histogram = settle(slim.groupBy("source", _part(F.col("h"), 0).alias("part")).agg(F.sum("size").alias("size")), "mix-histogram")
    goal = settle(targets(histogram.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    over = F.when(F.col("target") > F.col("source_size"), F.col("target") - F.col("source_size")).otherwise(F.col("target"))
    #: base: size under the part that is being split; part: its bits so far
    edge = goal.withColumn("budget", over).withColumn("base", F.lit(0).cast("long")).withColumn("part", F.lit(0).cast("long"))
    for level in range(LEVELS):
        cells = histogram
        if level:
            inside = slim.withColumn("up", _part(F.col("h"), level - 1)).alias("d").join(if_small(edge.select(F.col("source").alias("s"), F.col("part").alias("up_at"))), F.col("source").eqNullSafe(F.col("s")) & (F.col("up") == F.col("up_at")))
            cells = inside.groupBy("source", _part(F.col("h"), level).alias("part")).agg(F.sum("size").alias("size"))
        order = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = cells.withColumn("upto", F.sum("size").over(order))
        at = edge.alias("e").join(sums.withColumnRenamed("source", "c_source").withColumnRenamed("part", "c_part"), F.col("source").eqNullSafe(F.col("c_source")), "left")
        fits = F.col("base") + F.col("upto") <= F.col("budget")
        first_over = F.min(F.when(~fits, F.struct(F.col("c_part"), F.col("upto"), F.col("size"))))
        edge = at.groupBy("source", "source_size", "target", "budget", "base", F.col("e.part").alias("was")).agg(first_over.alias("x"), F.max("c_part").alias("last"))
        found = F.col("x").isNotNull()
        last_cell = level == LEVELS - 1
        left, took = F.col("budget") - F.col("base") - (F.col("x.upto") - F.col("x.size")), F.col("x.size")
        # the smallest cell is taken whole if that ends nearer to the budget
        whole = F.when(left * 2 > took, F.lit(1)).otherwise(F.lit(0)) if last_cell else F.lit(0)
        beyond = (F.coalesce(F.col("last"), F.col("was") * F.lit(1 << BITS if level else 1)) + 1).cast("long")
        edge = settle(
            edge.select("source", "source_size", "target", "budget", F.when(found, F.col("base") + F.col("x.upto") - F.col("x.size")).otherwise(F.col("base")).alias("base"), F.when(found, F.col("x.c_part") + whole).otherwise(beyond).cast("long").alias("part")),
            "mix-edge",
        )
    return slim, edge.select(F.col("source").alias("s"), "source_size", "target", F.col("part").alias("threshold"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, seed: int = 0) -> DataFrame:
    """One row for each document: key, size, source, source_size, target and copies (0, 1 or 2 of it are taken).

    A source with a target under its size takes the documents under its threshold once; one with a higher target takes
    all once and those under the threshold again. A source's taken size ends within half a document, or group of rows
    with one key, of its target. The hash depends on key and seed alone, so reruns agree; rows with a null key are
    spread by their text. Null text has size 0, a null source is a source of its own, empty input gives an empty
    result, and equal keys are taken together.
    """
    slim, edge = thresholds(docs, key, text, source, weights, share_percent, seed)
    joined = slim.join(if_small(edge), F.col("source").eqNullSafe(F.col("s")))
    return joined.select(F.col("key").alias(key), "size", "source", "source_size", "target", _copies(F.col("h")).alias("copies"))


def take(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, seed: int = 0) -> DataFrame:
    """The mixed rows of docs, with its columns: a document taken twice stands twice. See mix() for odd rows.

    Thresholds join by source, so the texts are neither shuffled nor sorted.
    """
    edge = thresholds(docs, key, text, source, weights, share_percent, seed)[1]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    row = F.col("row")
    joined = rows.join(if_small(edge), row[source].eqNullSafe(F.col("s")))
    copies = _copies(_hash(row[key], row[text], seed))
    return joined.select("row", F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).select("row.*")
