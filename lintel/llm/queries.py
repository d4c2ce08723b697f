"""The queries of the training-data operators: each derives its result columns from its operator over a whole table."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, edit_counts, jaccard, language, licenses, mixing, oracles, packing, pii, quality, sharding

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    profiles = language.learn(docs.where(fold != 2))
    judged = language.predict(docs, profiles)
    return judged.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_shard_by_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_cut")


def op3_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_tokens(_table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("quality")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.assess(docs).select("doc_id", q["n_words"].alias("n_words"), q["word_chars"].alias("word_chars"), q["n_symbols"].alias("n_symbols"), q["n_dup_lines"].alias("n_dup_lines"), q["n_repeat_words"].alias("n_repeat_words"), q["base_failed"].alias("base_failed"), q["kept"].alias("kept"), F.array_join(q["broken"], ",").alias("broken"))


def op7_deobfuscate_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(_table(spark, sf_dir, "documents"))
    plain = F.filter("spans", lambda s: s["plain"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(plain, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(listed(plain), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), (F.size("spans") - F.size(plain)).cast("long").alias("n_added"), (F.size("spans") > 0).alias("flagged"))


def _masks(text: str) -> list[edit_counts.Edit]:
    """Edits, none over another, that mask personal data and cut lines that stood before; overlapping data has the mask of its first, and data within a cut line none."""
    cut, seen, at = [], set(), 0
    lines = text.split("\n")
    for line in lines if len(set(lines)) < len(lines) else ():
        if line.strip() and line in seen:
            cut.append(edit_counts.Edit(at, at + len(line) + 1, ""))
        seen.add(line)
        at += len(line) + 1
    starts = [e.start for e in cut]

    def within(start: int, end: int) -> bool:
        i = bisect_right(starts, start) - 1
        return i >= 0 and end <= cut[i].end

    masks = [edit_counts.Edit(start, end, f"[{kind.upper()}]") for part in pii.find(text) for kind, start, end in part if not within(start, end)]
    made: list[edit_counts.Edit] = []
    for e in sorted([*masks, *cut], key=lambda e: (e.start, -e.end)):
        if made and e.start < made[-1].end:
            made[-1] = edit_counts.Edit(made[-1].start, max(made[-1].end, e.end), made[-1].put or e.put)
        else:
            made.append(e)
    return made


def op8_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts.count_edited(_table(spark, sf_dir, "documents"), _masks).drop("text_after")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (_table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    found = decontaminate.scan(docs.select("doc_id", "text"), benchmark)
    n_hit, n_words, items = F.col("n_hit"), F.col("n_words"), F.array_sort("items")
    return found.select(F.col("c0").alias("doc_id"), "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), decontaminate.contaminated(n_hit, n_words).alias("contaminated"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_identify_language, op2_shard_by_splitters, op3_pack_tokens, op4_license_scan, op5_ngram_jaccard_join, op6_quality_rules, op7_deobfuscate_pii, op8_edit_aware_counts, op9_decontaminate, op10_mix_sources)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
