"""Rules as data: parsed from rule documents."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession

from .standard import STANDARD

OPS = ("eq", "ne", "lt", "le", "gt", "ge", "in", "not_in")
CHECKS = ("compare", "count", "sum_aggregate")
REQUIRED = ("rule_id", "name", "category", "target", "applies_when", "check", "mandatory", "severity", "source", "message")


class RuleError(ValueError):
    """A rule that cannot be compiled."""


@dataclass(frozen=True)
class Condition:
    path: str
    op: str
    value: Any


@dataclass(frozen=True)
class Check:
    kind: str
    op: str
    path: str
    threshold: Any = None
    threshold_path: str | None = None
    scale: float = 1
    divisor: float | None = None
    cap: float | None = None
    field: str | None = None
    where: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class Rule:
    rule_id: str
    target: str
    check: Check
    applies_when: tuple[Condition, ...] = ()
    name: str = ""
    category: str = ""
    mandatory: bool = True
    severity: str = "critical"
    source: str = ""
    message: str = ""


def _condition(c: dict) -> Condition:
    if c.get("op") not in OPS:
        raise RuleError(f"unknown operator {c.get('op')!r}")
    value = c.get("value")
    return Condition(c["path"], c["op"], tuple(value) if isinstance(value, list) else value)


def rule_of(spec: dict) -> Rule:
    """One rule of a rule document."""
    check = spec["check"]
    kind, op = check.get("type", "compare"), check.get("op")
    if kind not in CHECKS:
        raise RuleError(f"{spec['rule_id']}: unknown check type {kind!r}")
    if op not in OPS:
        raise RuleError(f"{spec['rule_id']}: unknown operator {op!r}")
    threshold = check.get("threshold")
    parsed = Check(
        kind, op, check["path" if kind == "compare" else "collection_path"], tuple(threshold) if isinstance(threshold, list) else threshold, check.get("threshold_path"),
        check.get("threshold_scale", 1), check.get("threshold_divisor"), check.get("threshold_cap"), check.get("field"), tuple(map(_condition, check.get("filter", []))),
    )
    return Rule(spec["rule_id"], spec["target"], parsed, tuple(map(_condition, spec["applies_when"])), spec["name"], spec["category"], spec["mandatory"], spec["severity"], spec["source"], spec["message"])


def parse_rules(document: str | dict) -> list[Rule]:
    """The rules of a rule document, in order."""
    spec = json.loads(document) if isinstance(document, str) else document
    return [rule_of(r) for r in spec["rules"]]


def load_rules(spark: SparkSession, path: str) -> list[Rule]:
    """The rules of a document anywhere that Spark reads; rule documents are driver-sized by nature."""
    return parse_rules(spark.read.text(path, wholetext=True).first()[0])


def default_rules() -> list[Rule]:
    """The standard rule set for metro stations."""
    return parse_rules(STANDARD)
