from __future__ import annotations

import pytest

from lintel.plans import qc
from lintel.sources import annotations

CLEAN = """<annotations><image id="0" name="站厅-a.jpg" width="2000" height="1000">
 <polygon label="fire_compartment" points="100,100;1100,100;1100,900;100,900"><attribute name="zone_type">公共区</attribute></polygon>
 <polygon label="fire_compartment" points="1100,100;1900,100;1900,900;1100,900"><attribute name="zone_type">无人区</attribute></polygon>
 <box label="safety_exit" xtl="190" ytl="190" xbr="210" ybr="210"><attribute name="pair_id">01，02</attribute></box>
 <box label="gate" xtl="300" ytl="480" xbr="320" ybr="520"/>
 <polyline label="width_dimension_line" points="300,500;330,500"/>
 <polyline label="evac_distance_line" points="200,200;200,500;500,500"><attribute name="pair_id">01</attribute><attribute name="text_content">48.6</attribute></polyline>
</image></annotations>"""

BAD = """<annotations><image id="0" name="站厅-b.jpg" width="1000" height="1000">
 <polygon label="fire_compartment" points="100,100;300,100;300,300;100,300"><attribute name="zone_type">公共</attribute></polygon>
 <polygon label="fire_compartment" points="1,1;2,2"/>
 <polygon label="fire_compartment" points=""/>
 <polygon label="unknown_thing" points="1,1;2,2;3,3"/>
 <polygon label="防火分区" points="1,1;2,2;3,3"/>
 <polygon label="public_area" points="-50,1;20,2;30,30"><attribute name="备注">x</attribute><attribute name="note">y</attribute></polygon>
 <box label="stair_escalator" xtl="5" ytl="5" xbr="5.2" ybr="50"/>
 <box label="draft_curtain" xtl="10" ytl="10" xbr="50" ybr="50"/>
 <box label="draft_curtain" xtl="11" ytl="10" xbr="50" ybr="50"/>
 <box label="safety_exit" xtl="150" ytl="150" xbr="160" ybr="160"><attribute name="pair_id">09</attribute></box>
 <box label="room_title" xtl="140" ytl="140" xbr="150" ybr="150"><attribute name="text_content">配电室</attribute></box>
 <box label="val_text" xtl="700" ytl="310" xbr="710" ybr="320"><attribute name="text_content">1</attribute></box>
 <box label="room_title" xtl="950" ytl="950" xbr="960" ybr="960"/>
 <polyline label="width_dimension_line" points="600,900;700,900"/>
 <polyline label="fire_clearance_line" points="600,600;700,600"/>
 <box label="dimension_val" xtl="10" ytl="900" xbr="20" ybr="910"/>
 <polyline label="evac_distance_line" points="200,200;200,500"><attribute name="pair_id">01</attribute><attribute name="text_content">480m</attribute></polyline>
 <polyline label="evac_distance_line" points="200,200"><attribute name="pair_id">01</attribute><attribute name="text_content">1.2.3</attribute></polyline>
 <polygon label="commercial_shop" points="1,1;9,1;9,9"/><polygon label="commercial_shop" points="1,1;9,1;9,9"/><polygon label="commercial_shop" points="1,1;9,1;9,9"/><polygon label="commercial_shop" points="1,1;9,1;9,9"/>
</image>
<image id="1" name="站厅-c.jpg" width="1000" height="1000"><box label="draft_curtain" xtl="10" ytl="10" xbr="50" ybr="50"/></image>
</annotations>"""


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("qc")
    (at / "clean.xml").write_text(CLEAN, encoding="utf-8")
    (at / "bad.xml").write_text(BAD, encoding="utf-8")
    images = annotations.read_images(spark, str(at)).cache()
    shapes = annotations.shapes_of(images).cache()
    items = qc.qc_items(shapes, images).cache()
    return images, shapes, items


def test_clean_drawing_passes(found):
    _, _, items = found
    assert [(r["code"], r["detail"]) for r in items.where("file like '%clean.xml'").collect()] == []


def test_codes(found):
    _, _, items = found
    codes = {}
    for r in items.where("file like '%bad.xml'").collect():
        codes.setdefault(r["code"], []).append((r["level"], r["detail"]))
    assert codes["BAD_LABEL"].__len__() == 2 and {v[0] for v in codes["BAD_LABEL"]} == {"ERROR", "WARN"}
    want = {
        "BAD_LABEL", "EMPTY_GEOM", "OUT_OF_BOUNDS", "BAD_POLYGON", "DEGENERATE_BOX", "JUNK_ATTR", "EXTRA_ATTR", "BAD_ENUM", "ATTR_ALL_BLANK", "ATTR_PARTIAL", "VAL_TEXT_NEAR_ORPHAN", "ROOM_TITLE_ORPHAN", "WIDTH_LINE_ORPHAN", "DIM_VAL_ORPHAN",
        "MISSING_CLASS", "SHOP_OVER", "NO_EVAC_LINE", "DUP_PAIR_ID", "NO_EXIT_PAIR", "EVAC_TEXT_RANGE", "EVAC_TEXT_NONNUM", "EVAC_TOO_SHORT", "EVAC_STRAIGHT", "NO_EQUIP_ZONE", "DUP_SHAPE",
    }
    assert set(codes) == want
    assert codes["MISSING_CLASS"] == [("ERROR", "gate 0/1")] and len(codes["DUP_SHAPE"]) == 1 and len(codes["NO_EXIT_PAIR"]) == 2


def test_duplicates_across_images(found):
    images, shapes, _ = found
    across = qc.qc_items(shapes, images, across_images=True).where("code = 'DUP_SHAPE'")
    assert across.count() == 2


def test_verdicts(found):
    images, _, items = found
    rows = {r["file"].rsplit("/", 1)[1]: r["verdict"] for r in qc.verdict(items, images).collect()}
    assert rows == {"clean.xml": "pass", "bad.xml": "fail"}
    levels = [r["level"] for r in qc.summary(items).collect()]
    assert levels == sorted(levels, key=["ERROR", "WARN", "INFO"].index)


def test_too_few_and_rooms_like_shops(spark, tmp_path):
    shops = '<polygon label="commercial_shop" points="1,1;9,1;9,9"/>' * 6 + '<box label="room_title" xtl="1" ytl="1" xbr="9" ybr="9"><attribute name="text_content">x</attribute></box>' * 6
    (tmp_path / "x.xml").write_text(f'<annotations><image id="0" name="hall" width="9" height="9"><polygon label="fire_compartment" points="1,1;9,1;9,9"><attribute name="zone_type">公共区</attribute></polygon>{shops}</image></annotations>', encoding="utf-8")
    images = annotations.read_images(spark, str(tmp_path))
    codes = {r["code"] for r in qc.qc_items(annotations.shapes_of(images), images).collect()}
    assert {"TOO_FEW", "SHOP_EQ_ROOM", "MISSING_CLASS"} <= codes
