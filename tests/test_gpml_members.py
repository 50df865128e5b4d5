"""Fields of feature members, read in one parse: prefixes without declarations, declarations, nested values, and what isn't there."""

from xml.etree.ElementTree import ParseError

import pytest

from chronoplate.sources import features


def test_fields_of_a_member():
    xml = """<gml:featureMember xmlns:gml="http://g"><gpml:Basin gml:id="b1"><gpml:identity>id &amp; 1</gpml:identity>
    <gpml:reconstructionPlateId><gpml:ConstantValue><gpml:value>101</gpml:value></gpml:ConstantValue></gpml:reconstructionPlateId>
    <gml:validTime><gml:begin><gml:timePosition frame="x:y">410.5</gml:timePosition></gml:begin></gml:validTime>
    <gpml:centerLineOf><gml:Polygon dimension="3"><gml:exterior><a:Ring xmlns:a="urn:a"><gml:posList>0 0 0</gml:posList></a:Ring></gml:exterior>
    <gml:interior><gml:posList>1 1</gml:posList></gml:interior><gml:interior><gml:posList>2 2</gml:posList></gml:interior></gml:Polygon></gpml:centerLineOf>
    <KeyValueDictionaryElement><key>K</key><value><deep><value>v</value></deep></value></KeyValueDictionaryElement></gpml:Basin></gml:featureMember>"""
    got = features.member_fields(xml)
    assert got["identity"] == "id & 1" and got["reconstructionPlateId"].strip() == "101" and got["begin"].strip() == "410.5" and got["end"] is None and got["name"] is None
    assert got["centre"] and (got["keys"], got["values"]) == (["K"], ["v"])
    assert got["polygons"] == [{"dimension": "3", "exterior": "0 0 0", "interiors": ["1 1", "2 2"]}]


def test_nothing_in_a_member_and_no_xml():
    assert features.member_fields("<featureMember/>")["polygons"] == []
    with pytest.raises(ParseError):
        features.member_fields("<featureMember><a></featureMember>")


def test_members_without_rows_or_text(spark):
    rows = spark.createDataFrame([(1, None), (2, "<gml:featureMember><gpml:Fault/></gml:featureMember>")], "member_index LONG, xml STRING")
    got = {r.member_index: r for r in features.parse_members(rows).collect()}
    assert set(got) == {2} and got[2].feature_id == "gpml-feature-2" and got[2].polygons == [] and got[2].attributes == {}
    assert features.parse_members(rows.limit(0)).count() == 0


def test_work_on_long_rings_is_in_proportion_to_their_points(spark):
    import time

    n = 20_000
    xml = "<gml:featureMember><gpml:Basin><gml:Polygon><gml:exterior><gml:posList>" + " ".join(f"{i % 60} {100 + i % 50}" for i in range(n)) + "</gml:posList></gml:exterior></gml:Polygon></gpml:Basin></gml:featureMember>"
    rows = spark.createDataFrame([(1, xml)], "member_index LONG, xml STRING").repartition(2)
    began = time.monotonic()
    (ring,) = (g["exterior"] for g in features.parse_members(rows).first().polygons)
    assert time.monotonic() - began < 60
    assert len(ring) == n + 1 and (ring[7].x, ring[7].y) == (107.0, 7.0)
