"""The annotation vocabulary as data."""

from __future__ import annotations

from typing import NamedTuple


class Label(NamedTuple):
    geom: str
    group: str
    attrs: tuple[str, ...]
    required: tuple[str, ...]


#: Geometry, drawing, attributes and required attributes of each label.
LABELS: dict[str, Label] = {
    "station_exit_ground": Label("polygon", "site", (), ()),
    "vent_group_ground": Label("polygon", "site", ("vent_function", "discharge_type", "name", "area_m2"), ()),
    "surrounding_building": Label("polygon", "site", ("name", "building_type", "fire_rating", "floors", "height_m"), ("name", "building_type", "fire_rating")),
    "fire_compartment": Label("polygon", "hall", ("zone_type", "area_m2_design"), ("zone_type",)),
    "public_area": Label("polygon", "hall", (), ()),
    "commercial_shop": Label("polygon", "hall", (), ()),
    "safety_exit": Label("box", "hall", ("pair_id",), ()),
    "stair_escalator": Label("box", "hall", (), ()),
    "gate": Label("box", "hall", (), ()),
    "fire_door": Label("box", "hall", ("class", "swing_dir", "text_content"), ("class", "swing_dir")),
    "fire_shutter": Label("box", "hall", (), ()),
    "draft_curtain": Label("box", "hall", (), ()),
    "building_meta": Label("box", "site", ("text_content",), ("text_content",)),
    "vent_meta": Label("box", "site", ("text_content",), ("text_content",)),
    "dimension_val": Label("box", "site", ("text_content",), ("text_content",)),
    "fire_clearance_line": Label("polyline", "site", ("text_content",), ()),
    "evac_distance_line": Label("polyline", "hall", ("text_content", "pair_id"), ()),
    "width_dimension_line": Label("polyline", "hall", ("width",), ()),
    "room_title": Label("box", "hall", ("text_content",), ("text_content",)),
    "val_text": Label("box", "hall", ("text_content",), ("text_content",)),
}

#: Allowed values of attributes.
ENUMS = {
    "zone_type": ("公共区", "无人区", "有人值守区"),
    "class": ("甲级", "乙级", "unknown"),
    "swing_dir": ("顺着疏散方向", "逆着疏散方向"),
    "vent_function": ("新风", "排风", "活塞风", "冷却塔风", "排烟"),
    "discharge_type": ("侧出", "敞口", "高风亭", "unknown"),
    "building_type": ("多层民用", "高层民用", "超高层民用", "丙类厂房", "丁戊类厂房", "甲乙类厂房库房", "加油加气加氢站", "其他", "unknown"),
    "fire_rating": ("一级", "二级", "三级", "四级", "unknown"),
}
#: Least counts of classes that a drawing must have, and most shops of an image.
MANDATORY = {"site": {"surrounding_building": 1}, "hall": {"fire_compartment": 2, "safety_exit": 1, "gate": 1, "evac_distance_line": 1}}
MOST_SHOPS = 3
#: Zone types in the rule language.
ZONES = {"公共区": "public", "无人区": "equipment_unmanned", "有人值守区": "equipment_staffed"}
#: Words that mark the title of an equipment room.
EQUIPMENT_ROOMS = ("机房", "泵房", "配电", "控制室", "通信", "信号", "环控", "气瓶", "变电", "电缆", "风室", "管理", "票务", "站长", "备品", "工具", "卫生间", "厕所")

#: English names of Chinese labels and attribute names.
ENGLISH: dict[str, str] = {
    "车站地面出入口": "station_exit_ground",
    "风亭实体": "vent_group_ground", "地面通风机组": "vent_group_ground",
    "周边建筑": "surrounding_building",
    "防火间距线": "fire_clearance_line", "防火间距尺寸线": "fire_clearance_line",
    "建筑属性文字": "building_meta",
    "风亭属性文字": "vent_meta", "通风设施属性文字": "vent_meta",
    "防火间距尺寸数字": "dimension_val",
    "防火分区": "fire_compartment",
    "站厅公共区": "public_area", "公共区": "public_area",
    "商铺": "commercial_shop",
    "安全出口": "safety_exit",
    "楼梯扶梯": "stair_escalator", "楼梯及自动扶梯": "stair_escalator",
    "闸机": "gate", "进出站闸机": "gate",
    "防火门": "fire_door",
    "防火卷帘": "fire_shutter", "特级防火卷帘": "fire_shutter",
    "挡烟垂壁": "draft_curtain",
    "疏散距离线": "evac_distance_line", "公共区最远疏散距离线": "evac_distance_line",
    "宽度控制线": "width_dimension_line", "控制通道宽度尺寸线": "width_dimension_line",
    "房间名称": "room_title",
    "数值及文本": "val_text",
    "区域类型": "zone_type",
    "分类": "class",
    "门扇开启方向": "swing_dir",
    "宽度": "width",
    "文字内容": "text_content", "尺寸": "text_content",
    "名称": "name", "建筑名称": "name", "风亭名称": "name",
    "建筑类型": "building_type",
    "耐火等级": "fire_rating",
    "层数": "floors",
    "建筑高度": "height_m", "高度": "height_m",
    "风亭功能": "vent_function", "通风功能": "vent_function", "风口功能": "vent_function",
    "出风方式": "discharge_type", "排放方式": "discharge_type", "出风形式": "discharge_type",
    "面积": "area_m2", "风口面积": "area_m2",
    "设计面积": "area_m2_design", "声称面积": "area_m2_design", "分区面积": "area_m2_design",
}

#: Training classes; a class's place is its id.
CLASSES = (
    "fire_compartment", "commercial_shop", "surrounding_building", "station_exit_ground", "vent_group_ground", "fire_door", "stair_escalator", "draft_curtain",
    "building_meta", "vent_meta", "dimension_val", "room_title", "val_text", "safety_exit", "gate", "fire_shutter",
)
#: Attributes that detections of a class get.
DETECTED_ATTRS = {
    "fire_door": {"class": "unknown", "swing_dir": "顺着疏散方向"},
    "fire_compartment": {"zone_type": "公共区"},
    "surrounding_building": {"name": "", "building_type": "unknown", "fire_rating": "unknown"},
    "vent_group_ground": {"vent_function": "", "discharge_type": "unknown"},
    **{label: {"text_content": ""} for label in ("room_title", "val_text", "dimension_val", "building_meta", "vent_meta")},
}
#: Building categories by type, and those with a clearance rule.
BUILDING_CATEGORIES = {"多层民用": "多层民用", "高层民用": "高层民用", "超高层民用": "高层民用", "加油加气加氢站": "加油加气加氢站"}
CLEARANCE_CATEGORIES = ("多层民用", "高层民用", "加油加气加氢站")
