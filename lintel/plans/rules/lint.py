"""Checks of a rule document before it is used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import OPS, REQUIRED


def lint(documents: DataFrame, body: str = "body") -> DataFrame:
    """(rule_ord, rule_id, problem) of the rules of JSON rule documents: lacking keys, repeated ids, unknown operators, checks without type or operator."""
    rules = documents.select(F.posexplode(F.from_json(F.get_json_object(body, "$.rules"), "array<string>")).alias("rule_ord", "rule"))
    at = lambda path: F.get_json_object("rule", f"$.{path}")
    keys = F.json_object_keys("rule")
    rules = rules.select("rule_ord", "rule", at("rule_id").alias("rule_id"), keys.alias("keys"))
    lacking = rules.select("rule_ord", "rule_id", F.explode(F.array_except(F.array(*map(F.lit, REQUIRED)), "keys")).alias("key")).select("rule_ord", "rule_id", F.concat(F.lit("missing key "), "key").alias("problem"))
    twice = rules.groupBy("rule_id").agg(F.count("*").alias("n"), F.max("rule_ord").alias("rule_ord")).where("n > 1 and rule_id is not null").select("rule_ord", "rule_id", F.lit("repeated id").alias("problem"))
    ops = F.concat(F.coalesce(F.from_json(at("applies_when"), "array<struct<op:string>>"), F.array()), F.coalesce(F.from_json(at("check.filter"), "array<struct<op:string>>"), F.array()))
    used = F.concat(F.transform(ops, lambda c: F.coalesce(c["op"], F.lit("none"))), F.when(at("check.op").isNotNull(), F.array(at("check.op"))).otherwise(F.array()))
    unknown = rules.select("rule_ord", "rule_id", F.explode(F.array_except(used, F.array(*map(F.lit, OPS)))).alias("op")).select("rule_ord", "rule_id", F.concat(F.lit("unknown operator "), "op").alias("problem"))
    bare = rules.where(F.array_contains("keys", "check") & (at("check.type").isNull() | at("check.op").isNull())).select("rule_ord", "rule_id", F.lit("check without type or operator").alias("problem"))
    return lacking.unionByName(twice).unionByName(unknown).unionByName(bare)
