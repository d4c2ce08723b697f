"""Sentences of review reports."""

from __future__ import annotations

#: The sentence of each rule.
OPINIONS: dict[str, str] = {
    "WIDTH-DOOR-EVAC-001": "{tid} 疏散门净宽 {value}m,不满足规范要求 ≥{threshold}m,应加大门洞宽度。",
    "DOOR-SWING-EVAC-001": "{tid} 疏散门未向疏散方向开启,不满足规范要求(向疏散方向开启),应调整门扇方向。",
    "DOOR-CLASS-FIREWALL-001": "{tid} 防火墙上防火门等级不是甲级,应改为甲级防火门。",
    "DOOR-CLASS-PROJECT-ALL-A-001": "{tid} 本工程承诺所有防火门均为甲级,此门等级不符,应修改。",
    "AREA-PUB-001": "{tid} 站厅公共区防火分区面积 {value}㎡,超规范上限 {threshold}㎡,应增设防火分隔。",
    "AREA-EQUIP-UG-001": "{tid} 地下设备区每防火分区面积 {value}㎡,超规范上限 {threshold}㎡。",
    "AREA-EQUIP-AG-001": "{tid} 地上设备区每防火分区面积 {value}㎡,超规范上限 {threshold}㎡。",
    "EXIT-NUM-PUB-001": "{tid} 公共区安全出口仅 {value} 个,不满足规范要求 ≥{threshold} 个,应增设。",
    "EXIT-NUM-EQUIP-001": "{tid} 设备区防火分区安全出口 {value} 个,不满足规范要求 ≥{threshold} 个(含相邻分区共用防火墙上的常开甲级防火门)。",
    "EXIT-NUM-EQUIP-STAFFED-001": "{tid} 有人值守的设备区防火分区,直通地面的安全出口 {value} 个,不满足规范要求 ≥{threshold} 个。",
    "EXIT-DIST-SAME-DIR-001": "{tid} 同方向两安全出口距离 {value}m,不满足规范要求 ≥{threshold}m。",
    "EXIT-DIST-ADJ-001": "{tid} 相邻两安全出口距离 {value}m,不满足规范要求 ≥{threshold}m。",
    "EVAC-DIST-ANY-001": "{tid} 任一点至安全出口疏散距离 {value}m,超规范上限 {threshold}m,应增设安全出口或调整布局。",
    "EVAC-DIST-EQUIP-BETWEEN-001": "{tid} 设备区房间门至安全出口距离 {value}m(位于两个出口之间),超规范上限 {threshold}m。",
    "EVAC-DIST-EQUIP-DEADEND-001": "{tid} 设备区房间门至安全出口距离 {value}m(袋形走道尽端),超规范上限 {threshold}m。",
    "WIDTH-CORR-EVAC-001": "{tid} 疏散走道净宽 {value}m,不满足规范要求 ≥{threshold}m。",
    "WIDTH-STAIR-EVAC-001": "{tid} 疏散楼梯净宽 {value}m,不满足规范要求 ≥{threshold}m。",
    "WIDTH-EQUIP-CORR-SINGLE-001": "{tid} 设备区单面布置走道净宽 {value}m,不满足规范要求 ≥{threshold}m。",
    "WIDTH-EQUIP-CORR-DOUBLE-001": "{tid} 设备区双面布置走道净宽 {value}m,不满足规范要求 ≥{threshold}m。",
    "LANDING-WIDTH-001": "{tid} 出地面楼梯平台净宽 {value}m,不满足规范要求 ≥{threshold}m。",
    "SHOP-COUNT-PUB-001": "公共区商铺数量 {value} 个,超规范上限 {threshold} 个。",
    "SHOP-AREA-EACH-001": "{tid} 单个商铺面积 {value}㎡,超规范上限 {threshold}㎡。",
    "SHOP-AREA-TOTAL-PUB-001": "公共区商铺总面积 {value}㎡,超规范上限 {threshold}㎡。",
    "SHOP-OPENING-DIST-001": "{tid} 商铺间洞口距离 {value}m,不满足规范要求 ≥{threshold}m。",
    "SHUTTER-WIDTH-LE30-001": "{tid} 防火卷帘宽度 {value}m,超规范上限(洞口宽/3 且 ≤20m)。",
    "SHUTTER-WIDTH-GT30-001": "{tid} 洞口宽 >30m 的防火卷帘宽度 {value}m,不满足规范要求。",
    "FIRE-CLEARANCE-MULTI-001": "{tid}({target.building_name}) 出入口/风亭与周边多层民用建筑(一二级)间距 {value}m,不满足规范 ≥{threshold}m。",
    "FIRE-CLEARANCE-HIGHRISE-001": "{tid}({target.building_name}) 出入口/风亭与周边高层民用建筑间距 {value}m,不满足规范 ≥{threshold}m。",
    "FIRE-CLEARANCE-GASSTATION-001": "{tid}({target.building_name}) 出入口与加油加气加氢站安全间距 {value}m,不满足规范 ≥{threshold}m。",
    "VENT-FRESH-DIST-001": "{tid} 新风口与排风/活塞风口距离 {value}m,不满足规范 ≥{threshold}m。",
    "VENT-HEIGHT-001": "{tid} 排风/活塞口未高于新风口,不满足规范要求。",
    "CORR-UG-ENTRANCE-LEN-001": "{tid} 地下出入口通道长度 {value}m,超规范上限 {threshold}m。",
}
