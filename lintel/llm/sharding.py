"""Sharding by sampled splitters; DataFrame operations only.

Every record has a 52-bit key: 32 bits of its text's hash, so that equal texts stand together, then 20 bits of its
id's hash, so that a group too large for a range can be cut. Draws weighted by size give quantile splitters of many
narrow ranges; ranges that hold too many bytes are split again by quantiles of their own; and the running sizes along
the keys then decide the shard. Texts are read once, and only (key, id, size, checksum) rows are shuffled.
"""

from __future__ import annotations

import json
from itertools import accumulate, groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle

SHARDS = 24
ID_BITS = 20
#: Narrow ranges for each shard at least, bytes after which there are more of them, and the most in all: the splitters
#: that the driver sees are bounded by it, whatever the input.
RANGES, RANGE_BYTES, MOST_RANGES = 32, 1 << 30, 16_384
DRAWS = 16
#: A range with more than so many times the mean is split again, so many times at most; a range that is still fuller then costs a task time and changes no result.
OVERFULL, ROUNDS = 2.0, 16
#: A group of equal texts stays whole up to this part of a shard.
WHOLE = 1 / 16


def _literal(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _position(bounds: list[int], k: Column) -> Column:
    """How many of the sorted bounds are k or less: a binary search as a fold over powers of two."""
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    if not steps:
        return F.lit(0)
    array = _literal(bounds, "bigint")
    return F.aggregate(_literal(steps, "int"), F.lit(0), lambda at, s: F.when(F.get(array, at + s - 1) <= k, at + s).otherwise(at))


def _aligned(bounds: list[int]) -> list[int]:
    """Splitters moved to the start of their group, but for the later ones within one group, which is cut there."""
    out = []
    for group, own in groupby(sorted(set(bounds)), lambda b: b >> ID_BITS):
        out += [group << ID_BITS, *list(own)[1:]]
    return sorted(set(out))


def _draws(size: Column, k: Column, step: float) -> Column:
    """How often a record of this size is drawn if one draw stands for step bytes: its share, rounded by a hash."""
    chance = F.pmod(F.xxhash64(k, F.lit("draw")), F.lit(1 << 20)) / float(1 << 20)
    return F.floor(size / F.lit(step) + chance).cast("int")


def _quantiles(records: DataFrame, n: int, step: float) -> list[int]:
    drawn = records.select(F.explode(F.array_repeat("k", _draws(F.col("size"), F.col("k"), step))).alias("k"))
    row = drawn.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 20 * n).alias("q")).first() if n > 1 else None
    return [int(q) for q in row["q"]] if row and row["q"] else []


def _stats(slim: DataFrame, bounds: list[int]) -> dict:
    """Bytes, rows, least and largest key of each range that has rows."""
    by_range = slim.groupBy(_position(bounds, F.col("k")).alias("r"))
    return {r["r"]: r for r in by_range.agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).collect()}


def _ranges(slim: DataFrame, shards: int) -> tuple[list[int], list[tuple[int, int]], list[int]]:
    """Splitters of the narrow ranges, bytes and rows of each range, and the groups that splitters cut: none that is to stay whole."""
    total = slim.agg(F.sum("size")).first()[0] or 0
    n = min(MOST_RANGES, max(shards * RANGES, total // RANGE_BYTES))
    bounds = _aligned(_quantiles(slim, n, max(total / (n * DRAWS), 1e-9))) if total else []
    for round_ in range(ROUNDS + 1):
        stats = _stats(slim, bounds)
        full = [r for r in stats.values() if r["b"] > OVERFULL * total / n and r["lo"] < r["hi"]]
        if not full or round_ == ROUNDS or len(bounds) + len(full) > 2 * MOST_RANGES:
            break
        pieces = {r["r"]: min(64, 2 * int(r["b"] * n / total)) for r in full}
        inside = slim.withColumn("r", _position(bounds, F.col("k"))).where(F.col("r").isin(list(pieces)))
        drawn = inside.select("r", F.explode(F.array_repeat("k", _draws(F.col("size"), F.col("k"), total / (n * DRAWS * 4)))).alias("k"))
        found = drawn.groupBy("r").agg(F.percentile_approx("k", [i / 64 for i in range(1, 64)], 2000).alias("q")).collect()
        more = [int(x["q"][63 * i // pieces[x["r"]]]) for x in found for i in range(1, pieces[x["r"]])]
        # the largest key is a splitter at last, so that what draws do not tell apart still falls into two
        more += [int(r["hi"]) for r in full if not any(r["lo"] < b <= r["hi"] for b in more)]
        bounds = _aligned([*bounds, *more])
    inside = lambda b: b & ((1 << ID_BITS) - 1) > 0
    cut = sorted({b >> ID_BITS for b in bounds if inside(b)})
    if cut:
        group = F.shiftright("k", ID_BITS)
        sizes = {r["g"]: r["b"] for r in slim.where(F.array_contains(_literal(cut, "bigint"), group)).groupBy(group.alias("g")).agg(F.sum("size").alias("b")).collect()}
        cut = [g for g in cut if sizes.get(g, 0) > WHOLE * total / shards]
        whole = set(sizes) - set(cut)
        bounds = [b for b in bounds if not (inside(b) and b >> ID_BITS in whole)]
        stats = _stats(slim, bounds)
    order = range(len(bounds) + 1)
    return bounds, [(int(stats[r]["b"]), int(stats[r]["n"])) if r in stats else (0, 0) for r in order], cut


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row for each document: key, size, text_crc32, k, shard (0 to shards - 1), slot (0, 1, ... in each shard) and group_cut.

    Sizes are UTF-8 bytes of the text plus 8. Shards follow each other along k, and each ends where the running size
    comes nearest to its part of all bytes: a shard is off by no more than one record, or one group of equal texts
    where that is under a sixteenth of a shard. Larger groups are cut where shards end, and group_cut says so of each
    of their rows; copies of the others stand in one shard. Null texts have 8 bytes and checksum 0 and count
    as equal; null or repeated keys get slots of their own; an empty table gives no rows; a table of fewer documents
    than shards leaves shards empty.
    """
    body = F.col(text)
    group = F.shiftrightunsigned(F.xxhash64(body), 32)
    k = F.shiftleft(group, ID_BITS) + F.pmod(F.xxhash64(F.col(key)), F.lit(1 << ID_BITS))
    slim = settle(docs.select(F.col(key).alias("key"), (F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + 8).alias("size"), F.coalesce(F.crc32(body), F.lit(0)).cast("long").alias("crc"), k.cast("long").alias("k")), "shard-keys")
    bounds, stats, cut_groups = _ranges(slim, shards)
    total = max(1, sum(b for b, _ in stats))
    bytes_before, rows_before = ([0, *accumulate(x[i] for x in stats)] for i in (0, 1))
    by_key = Window.partitionBy("r").orderBy("k", "key", "size", "crc")
    by_group = Window.partitionBy("r").orderBy("g")
    placed = (
        slim.withColumn("r", _position(bounds, F.col("k")))
        .withColumn("g", F.shiftright("k", ID_BITS))
        .withColumn("i", F.row_number().over(by_key) - 1)
        .withColumn("upto", F.sum("size").over(by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("g_end", F.sum("size").over(by_group.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("g_start", F.coalesce(F.sum("size").over(by_group.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    )
    large = F.array_contains(_literal(cut_groups, "bigint"), F.col("g")) | ((F.col("g_end") - F.col("g_start")) > F.lit(WHOLE * total / shards))
    middle = F.when(large, F.col("upto") - F.col("size") / 2).otherwise((F.col("g_start") + F.col("g_end")) / 2)
    at = F.get(_literal(bytes_before, "bigint"), F.col("r")) + middle
    row = F.get(_literal(rows_before, "bigint"), F.col("r")) + F.col("i")
    cut = settle(placed.select("key", "size", "crc", "k", large.alias("group_cut"), F.least(F.lit(shards - 1), F.floor(at * shards / F.lit(float(total)))).cast("int").alias("shard"), row.alias("row")), "shard-rows")
    counts = {x["shard"]: x["n"] for x in cut.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    first = [0, *accumulate(counts.get(s, 0) for s in range(shards))]
    slot = (F.col("row") - F.get(_literal(first, "bigint"), F.col("shard"))).cast("long")
    return cut.select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "k", "shard", slot.alias("slot"), "group_cut")
