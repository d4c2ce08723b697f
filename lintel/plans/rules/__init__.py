"""The declarative rule language: model, compiler, evaluation and lint."""

from .compiler import evaluate_documents, evaluate_tables, findings_of
from .lint import lint
from .model import Check, Condition, Rule, RuleError, default_rules, load_rules, parse_rules

__all__ = ["Check", "Condition", "Rule", "RuleError", "default_rules", "evaluate_documents", "evaluate_tables", "findings_of", "lint", "load_rules", "parse_rules"]
