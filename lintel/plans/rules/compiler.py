"""Rules compiled to Columns.

A rule sees its target and its station through a view, which answers for a path: is it there, is it null, and its
value as a number, a text or a truth value. Views stand over typed structs, where every field is there, or over JSON
text, where a missing field and a null differ. All rules of a target type become one array of outcomes in one
projection, so targets are read once and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions.base import lookup
from .model import Check, Condition, Rule, RuleError

#: Target types in the order of a structured document.
TARGETS = ("station", "fire_compartment", "exit_pair", "door", "corridor", "evac_distance_line", "shop", "shop_pair", "vent_pair", "fire_shutter", "building_clearance")


@dataclass(frozen=True)
class Value:
    """A resolved path. num holds numbers and truth values as 0 and 1, as they compare in conditions."""

    present: Column
    null: Column
    num: Column
    text: Column
    kind: Column  # num, text, bool, list or other
    shown: Column

    @property
    def given(self) -> Column:
        return self.present & ~self.null


@dataclass(frozen=True)
class View:
    value: Callable[[str], Value]
    items: Callable[[str], tuple[Column, Callable[[Column], View]]]
    """The elements under a path, as an array, and the view of one of them."""


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _absent() -> Value:
    return Value(F.lit(False), F.lit(False), _none("double"), _none("string"), F.lit("other"), _none("string"))


def shown_number(x: Column) -> Column:
    """A double as text with the digits that Python prints, for sizes that drawings have."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), F.concat(x.cast("long").cast("string"), F.lit(".0"))).otherwise(x.cast("string"))


def typed_view(struct: Column, schema: T.StructType) -> View:
    """The view of a struct column. Fields of the schema are there, null or not; others are missing."""

    def find(path: str) -> tuple[Column, T.DataType] | None:
        column, kind = struct, schema
        for part in path.split("."):
            if not isinstance(kind, T.StructType) or part not in kind.names:
                return None
            column, kind = column[part], kind[part].dataType
        return column, kind

    def value(path: str) -> Value:
        found = find(path)
        if not found:
            return _absent()
        column, kind = found
        null = column.isNull()
        if isinstance(kind, T.BooleanType):
            return Value(F.lit(True), null, column.cast("double"), _none("string"), F.lit("bool"), F.when(column, "True").when(~column, "False"))
        if isinstance(kind, T.NumericType):
            return Value(F.lit(True), null, column.cast("double"), _none("string"), F.lit("num"), shown_number(column) if isinstance(kind, T.FractionalType) else column.cast("string"))
        if isinstance(kind, T.StringType):
            return Value(F.lit(True), null, _none("double"), column, F.lit("text"), column)
        return Value(F.lit(True), null, _none("double"), _none("string"), F.lit("list" if isinstance(kind, T.ArrayType) else "other"), F.to_json(column))

    def items(path: str) -> tuple[Column, Callable[[Column], View]]:
        found = find(path)
        if not found or not isinstance(found[1], T.ArrayType) or not isinstance(found[1].elementType, T.StructType):
            return _none("array<string>"), json_view
        inner = found[1].elementType
        return found[0], lambda item: typed_view(item, inner)

    return View(value, items)


def json_view(document: Column, parsed: Column | None = None) -> View:
    """The view of a column of JSON text, where missing and null differ; parsed is its variant, if there is one already."""
    parsed = F.try_parse_json(document) if parsed is None else parsed

    def value(path: str) -> Value:
        at = F.try_variant_get(parsed, f"$.{path}", "variant")
        kind = F.schema_of_variant(at)
        null = F.coalesce(F.is_variant_null(at), F.lit(False))
        # the text is not read again for what its variant lacks
        literal = F.when(at.isNotNull() | parsed.isNull(), F.get_json_object(document, f"$.{path}"))
        number, truth, text = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), kind == "BOOLEAN", kind == "STRING"
        flag = F.try_variant_get(at, "$", "boolean")
        return Value(
            at.isNotNull(),
            null,
            F.when(number, F.try_variant_get(at, "$", "double")).when(truth, flag.cast("double")),
            F.when(text, F.try_variant_get(at, "$", "string")),
            F.when(number, "num").when(truth, "bool").when(text, "text").when(kind.startswith("ARRAY"), "list").otherwise("other"),
            F.when(truth, F.when(flag, "True").otherwise("False")).otherwise(literal),
        )

    def items(path: str) -> tuple[Column, Callable[[Column], View]]:
        return F.from_json(F.get_json_object(document, f"$.{path}"), "array<string>"), json_view

    return View(value, items)


def _equal(v: Value, literal: Any) -> Column:
    """Equality across types is false; truth values equal 0 and 1."""
    if literal is None:
        return v.null
    if isinstance(literal, bool | int | float):
        return F.coalesce(v.given & (v.num == float(literal)), F.lit(False))
    if isinstance(literal, str):
        return F.coalesce(v.given & (v.text == literal), F.lit(False))
    raise RuleError(f"no equality with {literal!r}")


def _ordered(v: Value, op: str, literal: Any) -> Column:
    """Null where the types cannot be ordered."""
    side, other = (v.text, F.lit(literal)) if isinstance(literal, str) else (v.num, F.lit(float(literal)))
    return {"lt": side < other, "le": side <= other, "gt": side > other, "ge": side >= other}[op]


def _op(v: Value, op: str, literal: Any) -> Column:
    """The comparison of a value that is there; null where its type does not allow it."""
    if op in ("eq", "ne"):
        return _equal(v, literal) if op == "eq" else ~_equal(v, literal)
    if op in ("in", "not_in"):
        found = reduce(lambda a, b: a | b, (_equal(v, x) for x in literal), F.lit(False))
        return found if op == "in" else ~found
    return _ordered(v, op, literal)


def _root(path: str) -> tuple[str, str]:
    root, _, rest = path.partition(".")
    return root, rest


def condition(c: Condition, views: dict[str, View]) -> Column:
    """A missing path makes any condition false; a null is compared; what cannot be ordered is false."""
    root, rest = _root(c.path)
    if root not in views or not rest:
        return F.lit(False)
    v = views[root].value(rest)
    return v.present & F.coalesce(_op(v, c.op, c.value), F.lit(False))


def conditions(cs: tuple[Condition, ...], views: dict[str, View]) -> Column:
    return reduce(lambda a, b: a & b, (condition(c, views) for c in cs), F.lit(True))


OUTCOME = "struct<passed:boolean,value:string,value_num:double,threshold:string,threshold_num:double,reason:string>"


def _outcome(passed: Column, value: Column, value_num: Column, threshold: Column, threshold_num: Column, reason: Column) -> Column:
    names = ("passed", "value", "value_num", "threshold", "threshold_num", "reason")
    return F.struct(*(c.alias(n) for n, c in zip(names, (passed, value, value_num, threshold, threshold_num, reason), strict=True))).cast(OUTCOME)


def _shown(literal: Any) -> Column:
    return _none("string") if literal is None else F.lit(str(literal))


def _number(literal: Any) -> Column:
    return F.lit(float(literal)) if isinstance(literal, int | float) and not isinstance(literal, bool) else _none("double")


def _review(threshold: Column, threshold_num: Column, reason: Column, value: Column | None = None) -> Column:
    return _outcome(_none("boolean"), value if value is not None else _none("string"), _none("double"), threshold, threshold_num, reason)


def _compare(check: Check, views: dict[str, View]) -> Column:
    root, rest = _root(check.path)
    v = views[root].value(rest) if root in views and rest else _absent()
    missing = F.lit(f"缺少字段 {check.path}")
    if check.threshold_path is None:
        literal = check.threshold
        passed = _op(v, check.op, literal)
        fits = _outcome(passed, v.shown, v.num, _shown(literal), _number(literal), _none("string"))
        clash = _review(_shown(literal), _number(literal), F.lit("类型不匹配"), v.shown)
        return F.when(~v.given, _review(_shown(literal), _number(literal), missing)).when(passed.isNull(), clash).otherwise(fits)
    root, rest = _root(check.threshold_path)
    t = views[root].value(rest) if root in views and rest else _absent()
    scaled = F.try_divide(t.num, F.lit(float(check.divisor))) if check.divisor is not None else t.num * float(check.scale)
    limit = F.round(F.least(scaled, F.lit(float(check.cap))) if check.cap is not None else scaled, 3)
    shown = shown_number(limit) if check.cap is None else F.when(scaled > float(check.cap), str(check.cap)).otherwise(shown_number(limit))
    compared = {"lt": v.num < limit, "le": v.num <= limit, "gt": v.num > limit, "ge": v.num >= limit, "eq": F.coalesce(v.num == limit, F.lit(False)), "ne": ~F.coalesce(v.num == limit, F.lit(False))}
    if check.op not in compared:
        raise RuleError(f"a threshold path does not go with {check.op}")
    passed = compared[check.op]
    none, no_number = _none("string"), _none("double")
    return (
        F.when(~t.given, _review(none, no_number, F.lit(f"缺少阈值字段 {check.threshold_path}")))
        .when(limit.isNull(), _review(none, no_number, F.lit("阈值字段类型不匹配"), t.shown))
        .when(~v.given, _review(shown, limit, missing))
        .when(passed.isNull(), _review(shown, limit, F.lit("类型不匹配"), v.shown))
        .otherwise(_outcome(passed, v.shown, v.num, shown, limit, none))
    )


def _collection(check: Check, views: dict[str, View]) -> Column:
    root, rest = _root(check.path)
    literal = check.threshold
    threshold = (_shown(literal), _number(literal))
    v = views[root].value(rest) if root in views and rest else _absent()
    array, view = views[root].items(rest) if root in views and rest else (_none("array<string>"), json_view)
    kept = F.filter(array, lambda item: conditions(check.where, views | {"item": view(item)}))
    result = lambda n, shown: _outcome(_ordered_or_equal(n, check.op, literal), shown, n, *threshold, _none("string"))
    if check.kind == "count":
        n = F.size(kept)
        done = result(n.cast("double"), n.cast("string"))
    else:
        amount = lambda item: view(item).value(check.field)
        lacking = F.exists(kept, lambda item: ~amount(item).given | amount(item).num.isNull())
        total = F.round(F.aggregate(F.transform(kept, lambda item: amount(item).num), F.lit(0.0), lambda a, b: a + b), 2)
        whole = F.forall(kept, lambda item: ~F.coalesce(amount(item).shown, F.lit("")).contains("."))
        shown = F.when(whole, total.cast("long").cast("string")).otherwise(shown_number(total))
        done = F.when(lacking, _review(*threshold, F.lit(f"集合元素缺字段 {check.field}"))).otherwise(result(total, shown))
    return F.when(~v.given, _review(*threshold, F.lit(f"缺少集合 {check.path}"))).when(v.kind != "list", _review(*threshold, F.lit(f"{check.path} 不是数组"))).otherwise(done)


def _ordered_or_equal(n: Column, op: str, literal: Any) -> Column:
    value = Value(F.lit(True), F.lit(False), n, _none("string"), F.lit("num"), n.cast("string"))
    return _op(value, op, literal)


def outcome(rule: Rule, views: dict[str, View]) -> Column:
    """passed (null: to be reviewed), value, threshold and reason."""
    return _compare(rule.check, views) if rule.check.kind == "compare" else _collection(rule.check, views)


def render(template: str, target: View, value: Column, threshold: Column) -> Column:
    """The template with {value}, {threshold} and {target.path} filled in; other braces stay."""
    parts, at = [], 0
    none = lambda c: F.coalesce(c, F.lit("None"))
    for m in re.finditer(r"\{([\w.]+)\}", template):
        parts.append(F.lit(template[at : m.start()]))
        at, name = m.end(), m[1]
        if name in ("value", "threshold"):
            parts.append(none(value if name == "value" else threshold))
        elif name.startswith("target."):
            v = target.value(name.removeprefix("target."))
            parts.append(F.when(v.present, none(v.shown)).otherwise(F.lit(m[0])))
        else:
            parts.append(F.lit(m[0]))
    return F.concat(*parts, F.lit(template[at:]))


FINDING = ("doc_id", "rule_ord", "target_ord", "rule_id", "name", "category", "target_type", "target_id", "passed", "review_required", "value", "value_num", "threshold", "threshold_num", "reason", "severity", "mandatory", "source", "message")
#: What a rule says of itself, looked up by its place after its findings are told, and the columns that come from its outcome.
_OWN = {"rule_id": "rule_id", "name": "name", "category": "category", "target_type": "target", "severity": "severity", "mandatory": "mandatory", "source": "source"}
_OUTCOME = ("passed", "value", "value_num", "threshold", "threshold_num", "reason")


def _cell(order: int, rule: Rule, views: dict[str, View], fields: frozenset[str]) -> Column:
    """A struct of what changes from finding to finding of one rule, as far as wanted; null where the rule does not apply."""

    def finding(o: Column) -> Column:
        note = F.when(o["passed"].isNull(), F.concat(F.lit("  [待人工复核: "), o["reason"], F.lit("]"))).otherwise("")
        told = {"message": lambda: F.concat(render(rule.message, views["target"], o["value"], o["threshold"]), note), "target_id": lambda: views["target"].value("id").shown}
        return F.struct(F.lit(order).alias("rule_ord"), *(o[c].alias(c) for c in _OUTCOME if c in fields), *(make().alias(c) for c, make in told.items() if c in fields))

    once = F.element_at(F.transform(F.array(outcome(rule, views)), finding), 1)
    return F.when(conditions(rule.applies_when, views), once)


def _paths(rule: Rule) -> set[str]:
    """The paths of targets and stations that a rule reads, but for those of elements."""
    check = rule.check
    read = {c.path for c in rule.applies_when} | {check.path} | {"target." + m for m in re.findall(r"\{target\.([\w.]+)\}", rule.message)}
    return {p for p in read | ({check.threshold_path} if check.threshold_path else set()) if _root(p)[0] in ("target", "station") and _root(p)[1]}


_FIELDS = ("present", "null", "num", "text", "kind", "shown")


def _resolved(targets: DataFrame, rules: list[tuple[int, Rule]], views: dict[str, View]) -> tuple[DataFrame, dict[str, View]]:
    """targets with the values of all paths as columns, and views of those: a path that many rules read is resolved once."""
    paths = sorted({p for _, rule in rules for p in _paths(rule)} | {"target.id"})
    at = {p: f"__{i}" for i, p in enumerate(paths)}
    columns = [getattr(value, name).alias(f"{at[p]}_{name}") for p in paths for value in [views[_root(p)[0]].value(_root(p)[1])] for name in _FIELDS]

    def view(root: str, inner: View) -> View:
        def value(path: str) -> Value:
            column = at.get(f"{root}.{path}")
            return Value(*(F.col(f"{column}_{name}") for name in _FIELDS)) if column else inner.value(path)

        return View(value, inner.items)

    return targets.select("*", *columns), {root: view(root, inner) for root, inner in views.items()}


def findings_of(targets: DataFrame, rules: list[tuple[int, Rule]], target: View, station: View, fields: Sequence[str] = FINDING, kind: Column | None = None) -> DataFrame:
    """One row for each rule, given with its place, that applies to a row (doc_id, target_ord, ...) of targets.

    The optimizer does not look into arrays, so fields says which columns of a finding are built at all. Where targets
    of several types stand together, kind tells a row's type, and only the rules of that type are tried.
    """
    wanted = frozenset(fields) | ({"passed"} if "review_required" in fields else set())
    resolved, views = _resolved(targets, rules, {"target": target, "station": station})
    cells = lambda own: F.array_compact(F.array(*(_cell(order, rule, views, wanted) for order, rule in own)))
    if kind is None:
        told = cells(rules)
    else:
        typed = [F.when(kind == name, cells([(o, r) for o, r in rules if r.target == name])) for name in dict.fromkeys(r.target for _, r in rules)]
        told = F.coalesce(*typed)
    fired = resolved.select("doc_id", "target_ord", F.inline(told))
    own = {order: rule for order, rule in rules}
    said = lambda c: lookup({order: getattr(rule, _OWN[c]) for order, rule in own.items()}, F.col("rule_ord"))
    column = lambda c: said(c) if c in _OWN else F.col("passed").isNull() if c == "review_required" else F.col(c)
    return fired.select(*(column(c).alias(c) for c in FINDING if c in fields))


def _grouped(rules: list[Rule]) -> dict[str, list[tuple[int, Rule]]]:
    out: dict[str, list[tuple[int, Rule]]] = {}
    for order, rule in enumerate(rules):
        out.setdefault(rule.target, []).append((order, rule))
    return out


def evaluate_documents(documents: DataFrame, rules: list[Rule], body: str = "body", fields: Sequence[str] = FINDING) -> DataFrame:
    """Findings of JSON documents (doc_id, body): an object with a station and a list for each other target type.

    A null or empty station has no station findings; lists that are missing, null or no lists have no targets. The
    targets of all types stand in one table, so that documents are made and read once, however many types there are.
    """
    lists = [t for t in _grouped(rules) if t != "station"]
    schema = ", ".join(f"`{t}` {'string' if t == 'station' else 'array<string>'}" for t in ["station", *lists])
    read = documents.select("doc_id", F.from_json(F.col(body), schema).alias("d"))
    item = lambda name, at, target: F.struct(F.lit(name).alias("kind"), at.cast("int").alias("target_ord"), target.alias("target"))
    each = lambda t: F.transform(F.col(f"d.{t}"), lambda x, i: item(t, i, x))
    listed = [F.coalesce(each(t), F.array()) for t in lists]
    station = F.coalesce("d.station", F.lit("{}"))
    own = F.when(F.size(F.json_object_keys(station)) > 0, F.array(item("station", F.lit(0), F.col("d.station")))).otherwise(F.array())
    rows = read.select("doc_id", station.alias("station"), F.inline(F.concat(own, *listed))).select("*", F.try_parse_json("target").alias("target_v"), F.try_parse_json("station").alias("station_v"))
    return findings_of(rows, list(enumerate(rules)), json_view(F.col("target"), F.col("target_v")), json_view(F.col("station"), F.col("station_v")), fields, F.col("kind"))


def evaluate_tables(tables: dict[str, DataFrame], rules: list[Rule], fields: Sequence[str] = FINDING) -> DataFrame:
    """Findings of typed object tables, each with doc_id and ord; the station table has one row for each document."""
    station = tables["station"]
    kind = T.StructType([f for f in station.schema.fields if f.name != "doc_id"])
    stations = station.select("doc_id", F.struct(*(F.col(f.name) for f in kind.fields)).alias("station"))
    parts = []
    for target, own in _grouped(rules).items():
        if target not in tables:
            continue
        table = tables[target]
        own_kind = T.StructType([f for f in table.schema.fields if f.name not in ("doc_id", "ord")])
        row = F.struct(*(F.col(f.name) for f in own_kind.fields)).alias("target")
        if target == "station":
            rows = stations.select("doc_id", F.lit(0).alias("target_ord"), F.col("station").alias("target"), "station")
        else:
            rows = table.select("doc_id", F.col("ord").alias("target_ord"), row).join(stations, "doc_id", "left")
        parts.append(findings_of(rows, own, typed_view(F.col("target"), own_kind), typed_view(F.col("station"), kind), fields))
    return reduce(DataFrame.unionByName, parts)
