"""License scan: ordered signature rules over normalised words; DataFrame functions only.

A text that holds no gate term is done after one look. For the rest, words are lower-cased (A-Z) and joined by single
spaces, keywords select the rules to run, and each rule's matches become intervals of word positions. A detection that
lies within another of the same or a higher priority is suppressed.
"""

from __future__ import annotations

import json
import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import GATE, GATE_SPLIT, Signature, signatures
from .shared import beside, let

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WORD_ANY_CASE = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
HIT = "array<struct<start:bigint,end:bigint,priority:int,order:int,label:string,weight:double,base:boolean>>"


def _spaces(s: Column) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit(" ")))).cast("long")


def _intervals(norm: Column, rule: Column) -> Column:
    """The matches of one rule as hits. Each word has one space before it, so spaces up to a match give its first word."""
    pattern = F.concat(F.lit(" (?:"), rule["pattern"], F.lit(")(?= )"))

    def located(found: Column) -> Column:
        def walk(between: Column) -> Column:
            def step(state: Column, k: Column) -> Column:
                start = state["at"] + _spaces(F.get(between, k))
                end = start + _spaces(F.get(found, k))
                hit = F.struct(start.alias("start"), end.alias("end"), rule["priority"].alias("priority"), rule["order"].alias("order"), rule["label"].alias("label"), rule["weight"].alias("weight"), rule["base"].alias("base"))
                return F.struct(end.alias("at"), F.concat(state["hits"], F.array(hit).cast(HIT)).alias("hits"))

            first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(HIT).alias("hits"))
            return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), first, step, lambda s: s["hits"])

        return F.when(F.size(found) == 0, F.array().cast(HIT)).otherwise(let(F.split(norm, pattern, -1), walk))

    return let(F.regexp_extract_all(norm, pattern, F.lit(0)), located)


def _unsuppressed(hits: Column, levels: int) -> Column:
    """Hits that lie within no other hit of the same or a higher priority.

    In order of start, with the longer, the more important and the earlier rule first, one pass needs only the farthest
    end seen of each priority: whatever holds a hit comes before it.
    """
    ordered = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("s"), (-h["end"]).alias("e"), (-h["priority"]).alias("p"), h["order"].alias("o"), h.alias("hit"))))

    def step(state: Column, x: Column) -> Column:
        h, ends = x["hit"], state["ends"]
        # ends[i] is the farthest end among priorities of i or more
        held = F.get(ends, h["priority"]) >= h["end"]
        farther = F.transform(ends, lambda e, i: F.when(i <= h["priority"], F.greatest(e, h["end"])).otherwise(e))
        return F.struct(farther.alias("ends"), F.when(held, state["kept"]).otherwise(F.concat(state["kept"], F.array(h).cast(HIT))).alias("kept"))

    first = F.struct(F.array_repeat(F.lit(-1).cast("long"), levels).alias("ends"), F.array().cast(HIT).alias("kept"))
    return F.aggregate(ordered, first, step, lambda s: s["kept"])


def scan(docs: DataFrame, text: str = "text", rules: list[Signature] | None = None) -> DataFrame:
    """docs with columns license_words (number of words), license_hits (all base places) and license_found (detections
    after suppression), each hit with first word, end, label, rule order, priority and weight.

    Null and empty texts have no words and no hits. Base phrases do not overlap themselves, so every place counts.
    Rows are handled one by one: repeated rows give repeated results, and further columns stay; one with the name of a
    column above, or of a step on the way (__license_...), gets _in behind it.
    """
    at = docs.columns.index(text)
    docs = docs.toDF(*beside(docs.columns, ("license_words", "license_hits", "license_found", "__license_low", "__license_norm", "__license_all")))
    text = docs.columns[at]
    rules = rules if rules is not None else signatures()
    table = F.from_json(F.lit(json.dumps([r.__dict__ for r in rules])), "array<struct<order:int,label:string,priority:int,weight:double,keyword:string,pattern:string,base:boolean>>")
    keywords = F.from_json(F.lit(json.dumps(sorted({r.keyword for r in rules}))), "array<string>")
    levels = max((r.priority for r in rules), default=0) + 1
    body = F.coalesce(F.col(text), F.lit(""))
    lowered = F.col("__license_low")
    terms = [lowered.contains(term) for term in GATE] + [lowered.contains(part) & lowered.rlike(words) for part, words in GATE_SPLIT]
    gate = reduce(lambda a, b: a | b, terms)
    norm = F.regexp_replace(F.concat(F.lit(" "), F.translate(body, string.ascii_uppercase, string.ascii_lowercase), F.lit(" ")), SEPARATORS, " ")
    one = docs.withColumn("license_words", F.regexp_count(body, F.lit(WORD_ANY_CASE)).cast("long")).withColumn("__license_low", F.lower(body)).withColumn("__license_norm", F.when(gate, norm)).drop("__license_low")
    words = F.col("__license_norm")
    present = F.filter(keywords, lambda k: words.contains(k))
    active = let(present, lambda have: F.filter(table, lambda r: F.array_contains(have, r["keyword"])))
    every = F.flatten(F.transform(active, lambda r: _intervals(words, r)))
    hits = F.when(words.isNotNull(), every).otherwise(F.array().cast(HIT))
    two = one.withColumn("__license_all", hits)
    found = F.when(F.size("__license_all") > 0, _unsuppressed(F.col("__license_all"), levels)).otherwise(F.array().cast(HIT))
    return two.withColumn("license_found", found).withColumn("license_hits", F.filter("__license_all", lambda h: h["base"])).drop("__license_all", "__license_norm")


def summary(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels and score of scanned rows."""
    base, found = F.col("license_hits"), F.col("license_found")
    labels = lambda *of: F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.transform(x, lambda h: h["label"]) for x in of)))), ",")
    return scanned.select(
        key,
        F.col("license_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda h: h["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda h: h["start"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(base, found).alias("labels"),
        F.coalesce(F.array_max(F.transform(found, lambda h: h["weight"])), F.lit(0.0)).alias("score"),
    )
