"""Rollups and report tables over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.base import lookup
from ..functions.text import contains_any, shortened
from ..vocab import EQUIPMENT_ROOMS
from .opinions import OPINIONS
from .rules.model import Condition, Rule


_SIGNS = {"le": "≤", "ge": "≥", "lt": "<", "gt": ">", "eq": "=", "ne": "≠", "in": "∈", "not_in": "∉"}


def _counts() -> list[Column]:
    return [F.count("*").alias("total"), F.count_if("passed").alias("pass"), F.count_if(~F.col("passed")).alias("fail"), F.count_if("review_required").alias("review")]


def summary(findings: DataFrame, *by: str) -> DataFrame:
    """total, pass, fail and review of all findings, or of each group of them."""
    return findings.groupBy(*by).agg(*_counts())


def batch(findings: DataFrame, by: str = "doc_id") -> DataFrame:
    """The counts of each drawing and, with `is_total`, of all of them."""
    rolled = findings.rollup(by).agg(*_counts(), F.grouping(by).alias("is_total"))
    return rolled.select(by, "total", "pass", "fail", "review", (F.col("is_total") == 1).alias("is_total"))


def outcome(findings: DataFrame) -> DataFrame:
    """(doc_id, verdict): fail before review before pass."""
    return findings.groupBy("doc_id").agg(F.when(F.count_if(~F.col("passed")) > 0, "fail").when(F.count_if("review_required") > 0, "review").otherwise("pass").alias("verdict"))


def opinion() -> Column:
    """The reviewer's sentence for a finding, or its message for rules without one, or with a field that findings lack."""
    template = lookup(OPINIONS, F.col("rule_id"))
    none = lambda c: F.coalesce(F.col(c), F.lit("None"))
    filled = template
    for name, column in (("tid", "target_id"), ("value", "value"), ("threshold", "threshold")):
        filled = F.replace(filled, F.lit(f"{{{name}}}"), none(column))
    return F.coalesce(F.when(~F.contains(template, F.lit("{target.")), filled), F.col("message"))


def fails_by_rule(findings: DataFrame, each: int = 10, by: str = "doc_id") -> DataFrame:
    """Fails of each drawing, rules with most of them first (of equals, the earlier), the first `each` of a rule, with seq and opinion."""
    fails = findings.where("not passed")
    of_rule = Window.partitionBy(by, "rule_id")
    ranked = fails.withColumn("n_rule", F.count("*").over(of_rule)).withColumn("first_ord", F.min("rule_ord").over(of_rule)).withColumn("at", F.row_number().over(of_rule.orderBy("target_ord"))).where(F.col("at") <= each)
    order = Window.partitionBy(by).orderBy(F.col("n_rule").desc(), "first_ord", "rule_ord", "at")
    return ranked.withColumn("seq", F.row_number().over(order)).select(by, "seq", "rule_id", "name", "n_rule", "target_id", "value", "threshold", opinion().alias("opinion"), "source")


def reviews(findings: DataFrame, most: int = 30, by: str = "doc_id") -> DataFrame:
    """The first findings to be reviewed of each drawing: a report's list, so it has a length."""
    order = Window.partitionBy(by).orderBy("rule_ord", "target_ord")
    return findings.where("review_required").withColumn("seq", F.row_number().over(order)).where(F.col("seq") <= most).select(by, "seq", "rule_id", "target_id", "reason", "message")


def markdown(findings: DataFrame, by: str = "doc_id") -> DataFrame:
    """(doc_id, text): a Markdown report of each drawing."""
    totals = findings.groupBy(by).agg(*_counts())
    rows = fails_by_rule(findings, by=by).withColumn("head", F.when(F.row_number().over(Window.partitionBy(by, "rule_id").orderBy("seq")) == 1, F.concat(F.lit("\n### "), "rule_id", F.lit(" "), "name", F.lit(" ×"), F.col("n_rule").cast("string"), F.lit("\n"))).otherwise(""))
    listed = rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.concat("head", F.lit("- "), "opinion").alias("line")))), lambda x: x["line"]), "\n").alias("fails"))
    head = F.format_string("# %s\n\n| total | pass | fail | review |\n|-|-|-|-|\n| %d | %d | %d | %d |\n", by, "total", "pass", "fail", "review")
    return totals.join(listed, by, "left").select(by, F.concat(head, F.coalesce("fails", F.lit(""))).alias("text"))


def check_table(findings: DataFrame, rules: list[Rule]) -> DataFrame:
    """Every finding with its requirement, written with the operator of its rule."""
    signs = lookup({r.rule_id: _SIGNS[r.check.op] for r in rules}, F.col("rule_id"))
    result = F.when(F.col("passed"), "pass").when(~F.col("passed"), "fail").otherwise("review")
    return findings.select("doc_id", "rule_id", "name", "target_id", F.concat(signs, "threshold").alias("requirement"), "value", result.alias("result"))


def marks(findings: DataFrame) -> DataFrame:
    """(doc_id, target_type, target_id, colour, rule_id, label): one mark for each target, a fail before a review before a pass; without a target, one for each drawing."""
    severity = F.when(~F.col("passed"), 0).when(F.col("review_required"), 1).otherwise(2)
    first = F.min(F.struct(severity.alias("s"), "rule_ord", "rule_id", "message"))
    marked = findings.groupBy("doc_id", "target_type", "target_id").agg(first.alias("m"))
    colour = F.element_at(F.array(*map(F.lit, ("red", "orange", "green"))), F.col("m.s") + 1)
    return marked.select("doc_id", "target_type", "target_id", colour.alias("colour"), F.col("m.rule_id").alias("rule_id"), shortened(F.col("m.message")).alias("label"))


def batch_markdown(findings: DataFrame, by: str = "doc_id") -> DataFrame:
    """(text): one Markdown report of a batch: the totals, and a line for each drawing, by name. It has a line for each drawing, so it is a report of a batch, not of an archive."""
    rows = batch(findings, by)
    total = F.max(F.when(F.col("is_total"), F.struct("total", "pass", "fail", "review")))
    line = F.when(~F.col("is_total"), F.struct(F.col(by).alias("k"), F.format_string("| %s | %d | %d | %d | %d |", by, "total", "pass", "fail", "review").alias("line")))
    held = rows.agg(total.alias("t"), F.array_sort(F.collect_list(line)).alias("lines"))
    head = F.format_string("# Batch review\n\nDrawings: %d\n\n| total | pass | fail | review |\n|-|-|-|-|\n| %d | %d | %d | %d |\n\n| drawing | total | pass | fail | review |\n|-|-|-|-|-|\n", F.size("lines"), "t.total", "t.pass", "t.fail", "t.review")
    return held.select(F.concat(head, F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("text"))


def findings_documents(findings: DataFrame, by: str = "doc_id") -> DataFrame:
    """(doc_id, body): the findings of each drawing in order as one JSON document, with their summary."""
    item = F.struct("rule_ord", "target_ord", F.to_json(F.struct("rule_id", "target_id", "passed", "review_required", "value", "threshold", "severity", "message"), {"ignoreNullFields": "false"}).alias("j"))
    held = findings.groupBy(by).agg(F.to_json(F.struct(*_counts())).alias("summary"), F.transform(F.array_sort(F.collect_list(item)), lambda x: x["j"]).alias("items"))
    return held.select(by, F.concat(F.lit('{"summary":'), "summary", F.lit(',"findings":['), F.array_join("items", ","), F.lit("]}")).alias("body"))


def label_counts(shapes: DataFrame, by: str = "doc_id") -> DataFrame:
    """(doc_id, label, n): how many shapes of each label a drawing has."""
    return shapes.groupBy(by, "label").agg(F.count("*").alias("n"))


def checklist(candidates: DataFrame, by: str = "doc_id", sure: float = 0.7) -> DataFrame:
    """(doc_id, total, to_review, zones, equipment_rooms, lacks_equipment_zone, by_label) of candidates (label, conf, zone_type, content)."""
    zone = F.col("label") == "fire_compartment"
    room = (F.col("label") == "room_title") & contains_any(F.col("content"), EQUIPMENT_ROOMS)
    typed = zone & F.coalesce(F.col("zone_type").isin("无人区", "有人值守区"), F.lit(False))
    counted = candidates.groupBy(by, "label").agg(F.count("*").alias("n"), F.count_if(F.col("conf") < sure).alias("unsure"), F.count_if(zone).alias("zones"), F.count_if(room).alias("rooms"), F.count_if(typed).alias("typed"))
    total = lambda c, name: F.sum(c).alias(name)
    return counted.groupBy(by).agg(
        total("n", "total"), total("unsure", "to_review"), total("zones", "zones"), total("rooms", "equipment_rooms"), ((F.sum("rooms") > 0) & (F.sum("typed") == 0)).alias("lacks_equipment_zone"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "label", F.col("n").cast("string")))), ", ").alias("by_label"),
    )


def checklist_text(candidates: DataFrame, by: str = "doc_id", sure: float = 0.7) -> DataFrame:
    """(doc_id, text): the checklist of a drawing's candidates as lines of text."""
    lines = F.array(
        F.format_string("To confirm: %d of %d", "to_review", "total"),
        F.when(F.col("zones") > 0, F.format_string("Zone types of %d compartments are guesses: confirm each", "zones")),
        F.when(F.col("lacks_equipment_zone"), F.format_string("%d equipment rooms, but no equipment zone: a compartment may be missing", "equipment_rooms")),
        F.concat(F.lit("By label: "), "by_label"),
    )
    return checklist(candidates, by, sure).select(by, F.array_join(F.array_compact(lines), "\n").alias("text"))


def browse(rules: DataFrame, category: str | None = None, words: str = "") -> DataFrame:
    """Rules (rule_id, name, category, source, ...) of a category whose id, name or source has the words, in any case."""
    found = rules if category is None else rules.where(F.col("category") == category)
    return found.where(F.contains(F.lower(F.concat_ws(" ", "rule_id", "name", "source")), F.lit(words.lower())))


def catalogue(rules: DataFrame) -> DataFrame:
    """(n, categories, mandatory) of a rule table."""
    return rules.agg(F.count("*").alias("n"), F.count_distinct("category").alias("categories"), F.count_if("mandatory").alias("mandatory"))


def _written(c: Condition) -> str:
    value = "{" + ", ".join(map(str, c.value)) + "}" if isinstance(c.value, tuple) else str(c.value)
    return f"{c.path} {_SIGNS[c.op]} {value}"


def describe(rule: Rule) -> str:
    """A rule's check in one line."""
    c = rule.check
    if c.threshold_path:
        limit = c.threshold_path + (f" / {c.divisor:g}" if c.divisor else f" × {c.scale:g}" if c.scale != 1 else "")
        limit = f"min({limit}, {c.cap:g})" if c.cap is not None else limit
    else:
        limit = str(c.threshold)
    subject = {"compare": c.path, "count": f"count({c.path})", "sum_aggregate": f"sum({c.path}.{c.field})"}[c.kind]
    chosen = f" where {' and '.join(map(_written, c.where))}" if c.where else ""
    return f"{subject}{chosen} {_SIGNS[c.op]} {limit}"


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rules as rows, with their conditions and checks written out, for browse() and catalogue()."""
    rows = [(i, r.rule_id, r.name, r.category, r.target, " and ".join(map(_written, r.applies_when)), describe(r), r.check.op, r.severity, r.mandatory, r.source) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_ord int, rule_id string, name string, category string, target string, applies string, requirement string, op string, severity string, mandatory boolean, source string")


#: The shapes that targets come from: label, geometry and the form of their ids.
_SHAPES = {"fire_compartment": ("fire_compartment", "polygon", "FC-%02d"), "door": ("fire_door", "box", "DR-%03d"), "shop": ("commercial_shop", "polygon", "SHOP-%02d"), "fire_shutter": ("fire_shutter", "box", "FS-%02d"), "evac_distance_line": ("evac_distance_line", "polyline", "EVAC-%02d"), "building_clearance": ("surrounding_building", "polygon", "BC-%02d")}


def marked_shapes(marked: DataFrame, shapes: DataFrame) -> DataFrame:
    """Marks with the geometry that they belong on: the shape of the target's label and number, by its own geometry."""
    out = None
    for target, (label, geom, form) in _SHAPES.items():
        least = 3 if geom == "polygon" and label != "commercial_shop" else 1
        own = shapes.where((F.col("label") == label) & (F.col("geom") == geom) & (F.size("points") >= least))
        numbered = own.select("doc_id", "ord", "points", F.lit(target).alias("target_type"), F.format_string(form, F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).alias("target_id"))
        out = numbered if out is None else out.unionByName(numbered)
    return marked.join(out, ["doc_id", "target_type", "target_id"])
