"""Text extraction, classification and naming as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocab import BUILDING_CATEGORIES, EQUIPMENT_ROOMS
from .base import any_of, first_match, lookup

_HAN = "\\x{4e00}-\\x{9fa5}"


def first_number(text: Column) -> Column:
    """The first number of a text, commas left out; null for none."""
    return F.regexp_extract(F.replace(F.coalesce(text, F.lit("")), F.lit(",")), "(\\d+(?:\\.\\d+)?)", 1).try_cast("double")


def numbers(text: Column, least: float | None = None, most: float | None = None) -> Column:
    """All numbers of a text, within bounds if given."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(\\d+(?:\\.\\d+)?)"), F.lit(1)), lambda s: s.try_cast("double"))
    return F.filter(found, lambda v: (F.lit(True) if least is None else v >= least) & (F.lit(True) if most is None else v <= most))


def length_metres(text: Column) -> Column:
    """A written length in metres: mm where said, or from 200 without a unit; null for areas and for what is not in (0, 200] m."""
    value, lower = first_number(text), F.lower(text)
    metres = F.when(F.contains(lower, F.lit("mm")) | ((value >= 200) & ~F.contains(lower, F.lit("m"))), value / 1000).otherwise(value)
    is_area = any_of([F.contains(text, F.lit(u)) for u in ("㎡", "m²", "平方")])
    return F.when(~is_area & (metres > 0) & (metres <= 200), metres)


def ratios(text: Column, least: int = 20, most: int = 2000) -> Column:
    """The N of all 1:N in a text, within bounds."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("1\\s*[:：]\\s*(\\d{2,4})"), F.lit(1)), lambda s: s.cast("int"))
    return F.filter(found, lambda n: n.between(least, most))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.coalesce(text, F.lit("")), w))


def zone_word(text: Column) -> Column:
    """The zone class of a written zone: public, equipment or unknown."""
    return first_match([(F.contains(text, F.lit("公共")), F.lit("public")), (contains_any(text, ("设备", "无人", "有人", "管理")), F.lit("equipment"))], F.lit("unknown"))


def sections(text: Column) -> Column:
    """Compartments written in a text: array of (seq, area_m2, zone_text, zone_type).

    Each heading with a Chinese ordinal takes the first number of the 40 characters after it as its area, and the
    first zone word from 4 characters before it to 45 after; headings without an area of 50 or more are left out.
    The text is cut before each heading, so a window reaches into later headings as it would in the text.
    """
    heading = "防火分区[（(]?([一二三四五六七八九十])"
    # places of headings: split lengths add up to them
    parts = F.split(text, heading, -1)
    found = F.regexp_extract_all(text, F.lit(heading), F.lit(0))

    def one(i: Column) -> Column:
        before = F.aggregate(F.slice(parts, F.lit(1), i + 1), F.lit(0), lambda n, s: n + F.length(s)) + F.aggregate(F.slice(found, F.lit(1), i), F.lit(0), lambda n, s: n + F.length(s))
        end = before + F.length(F.get(found, i))
        area = F.regexp_extract(F.substring(text, end + 1, F.lit(40)), "(\\d{2,5}(?:\\.\\d{1,2})?)", 1).try_cast("double")
        low = F.greatest(F.lit(0), before - 4)
        zone = F.regexp_extract(F.substring(text, low + 1, end + 45 - low), "(公共区|无人区|有人值守区|有人区|设备管理区|设备区|无人值守区)", 1)
        return F.struct(F.regexp_extract(F.get(found, i), heading, 1).alias("seq"), area.alias("area_m2"), zone.alias("zone_text"), zone_word(zone).alias("zone_type"))

    indices = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(indices, one), lambda s: s["area_m2"] >= 50)


#: Stations whose names are known, in order, and drawing kinds by pattern, in order.
STATIONS = ("明海", "珠光", "贝尔路", "黄君山", "上油松", "石龙", "侨社", "嘉宾", "欧洲城")
KINDS = (
    ("总平面图?", "总平面图"), ("站厅层(?:平面)?(?:示意)?(?:图)?", "站厅层"), ("站台层(?:平面)?(?:示意)?(?:图)?", "站台层"), ("建筑平面图", "平面图"),
    ("建筑平剖面图", "平剖面图"), ("建筑总平面图", "总平面图"), ("平面布置图", "平面布置图"), ("全局平面图", "全局平面图"),
)


def basename(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), "(?<=.)\\.[^.]*$", "")


def station_name(text: Column) -> Column:
    """A known station in order, else 2 to 5 Chinese characters before 站; null for none."""
    known = [(F.contains(text, F.lit(s)), F.lit(f"{s}站")) for s in STATIONS]
    found = F.regexp_extract(text, f"(?<![号车])([{_HAN}]{{2,5}}站)", 1)
    return first_match(known, F.when(~found.isin("", "车站"), found))


def drawing_kind(text: Column) -> Column:
    return first_match([(text.rlike(pattern), F.lit(kind)) for pattern, kind in KINDS])


def safe_name(text: Column, most: int = 80) -> Column:
    """A name for files: bad characters and blanks become one hyphen, ends are trimmed, and the length is cut."""
    out = F.regexp_replace(F.btrim(F.regexp_replace(text, '[\\\\/:*?"<>|╱╲\\s]+', "-"), F.lit("-_ ")), "-{2,}", "-")
    cut = F.when(F.length(out) > most, F.rtrim(F.substring(out, 1, most), F.lit("-_"))).otherwise(out)
    return F.when(cut == "", F.lit("unnamed")).otherwise(cut)


def product_stem(path: Column) -> Column:
    """Station and kind of a drawing's file, or what there is of them, or its safe name."""
    raw = stem(path)
    station, kind = station_name(raw), drawing_kind(raw)
    return F.coalesce(F.when(station.isNotNull() & kind.isNotNull(), F.concat_ws("-", station, kind)), station, kind, safe_name(raw, 60))


def normal_stem(path: Column) -> Column:
    """A stem without rendering suffixes, with plain slashes and single blanks."""
    s = F.regexp_replace(F.regexp_replace(stem(path), "000000000\\.jpeg-?\\d*$", ""), "\\.jpeg-?\\d*$", "")
    return F.trim(F.regexp_replace(F.translate(s, "╱╲", "/\\"), "\\s+", " "))


def match_score(candidate: Column, text: Column) -> Column:
    """1000 and the candidate's length where one holds the other, else how many of its characters the text has."""
    shared = F.size(F.filter(F.split(candidate, ""), lambda c: (c != "") & F.contains(text, c)))
    return F.when(F.contains(text, candidate) | F.contains(candidate, text), 1000 + F.length(candidate)).otherwise(shared)


def split_ids(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,，;；\\s]+"), lambda p: F.trim(p)), lambda p: p != "")


def sanitized_number(text: Column) -> Column:
    """The digits and points of a text as a number: 0 for none, null where they are no number."""
    kept = F.regexp_replace(text, "[^0-9.]", "")
    return F.when(kept == "", F.lit(0.0)).otherwise(kept.try_cast("double"))


def shortened(text: Column, most: int = 60) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 2), F.lit("…"))).otherwise(text)


#: Words that tell what a written text is about.
VENT_WORDS = ("风亭", "新风", "排风", "活塞", "冷却塔", "风口")
BUILDING_WORDS = ("层", "耐火", "住宅", "办公", "厂房", "商业", "酒店", "学校", "医院", "高层", "多层", "建筑")
ROOM_WORDS = ("室", "房", "间", "厅", "库", "厕", "卫生间", "机房", "泵房", "配电", "控制", "通信", "信号", "环控", "变电", "电缆", "票务", "站长")


def classify_text(content: Column, group: Column) -> Column:
    """(label, conf) of a text that was read off a drawing."""
    found = lambda label, conf: F.struct((label if isinstance(label, Column) else F.lit(label)).alias("label"), F.lit(conf).alias("conf"))
    site = group == "site"
    number = F.when(site, "dimension_val").otherwise("val_text")
    han = content.rlike(f"[{_HAN}]")
    return first_match(
        [
            (F.coalesce(content, F.lit("")) == "", found("val_text", 0.3)),
            (content.rlike("^[\\d.,]+\\s*(?:mm|m|㎡|m²)?$"), found(number, 0.75)),
            (han & contains_any(content, VENT_WORDS), found("vent_meta", 0.8)),
            (han & site & contains_any(content, BUILDING_WORDS), found("building_meta", 0.8)),
            (han & contains_any(content, ROOM_WORDS), found("room_title", 0.8)),
            (han, found(F.when(group == "hall", "room_title").otherwise("building_meta"), 0.5)),
        ],
        found("val_text", 0.5),
    )


def classify_region(area_ratio: Column, group: Column, inner: Column) -> Column:
    """(label, zone_type, conf) of a closed region."""
    made = lambda label, zone, conf: F.struct(F.lit(label).alias("label"), F.lit(zone).cast("string").alias("zone_type"), F.lit(conf).alias("conf"))
    return first_match(
        [
            ((group == "site") & (area_ratio > 0.01), made("surrounding_building", None, 0.55)),
            (group == "site", made("station_exit_ground", None, 0.45)),
            (contains_any(inner, EQUIPMENT_ROOMS), made("fire_compartment", "无人区", 0.6)),
        ],
        made("fire_compartment", "公共区", 0.5),
    )


def classify_line(blue: Column, length: Column, group: Column, page_width: Column) -> Column:
    """(label, conf) of a long line; blue ones gain 0.2, up to 0.85."""
    label = first_match([(group == "site", F.lit("fire_clearance_line")), (length > page_width * 0.18, F.lit("evac_distance_line"))], F.lit("width_dimension_line"))
    conf = F.when(label == "evac_distance_line", 0.45).otherwise(0.5)
    return F.struct(label.alias("label"), F.when(blue, F.least(F.lit(0.85), conf + 0.2)).otherwise(conf).alias("conf"))


def building_category(kind: Column, floors: Column, height: Column, meta: Column) -> Column:
    """The clearance category of a building: its type, else its height, its floors, or words of the text beside it."""
    high = lambda test: F.when(test, F.lit("高层民用")).when(~test, F.lit("多层民用"))
    by_height, by_floors = high(F.trim(height).try_cast("double") > 24), high(F.trim(floors).try_cast("double").cast("int") >= 8)
    words = first_match([(contains_any(meta, ("加油", "加气", "加氢")), F.lit("加油加气加氢站")), (F.contains(meta, F.lit("高层")), F.lit("高层民用"))], F.lit("多层民用"))
    typed = F.when(F.trim(kind) != "", F.coalesce(lookup(BUILDING_CATEGORIES, kind), kind))
    return F.coalesce(typed, by_height, by_floors, words)
