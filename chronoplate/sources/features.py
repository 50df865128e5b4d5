"""Feature files: GPML and its archives, the legacy JSON form, and GeoJSON outlines.

A GPML document is cut to its feature members by a pattern, and each member is parsed once by its local names, so that one large
file becomes many rows that are parsed in parallel.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from chronoplate.functions import scalars as S
from chronoplate.functions.geometry import closed, let
from chronoplate.operators.domains import DISTANT_FUTURE, DISTANT_PAST, intent

#: Element names of geometry properties.
GEOMETRY_NAMES = ["boundary", "centerLineOf", "outlineOf", "position", "unclassifiedGeometry"]
PLATE_KEYS = ("PLATEID", "PLATEID1", "RECON_PLATE_ID")

LEGACY = "array<struct<FeatureID: string, PlateID: string, ValidTime: struct<Begin: double, End: double>, Polygon: array<struct<PosList: array<struct<Latitude: double, Longitude: double>>>>>>"


def decode_archive(data: bytes) -> str:
    """Text of a file by its first bytes: gzip, zip (its first .gpml or .xml entry, else its first file) or plain UTF-8."""
    if data[:2] == b"\x1f\x8b":
        return gzip.decompress(data).decode("utf-8")
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = [i.filename for i in z.infolist() if not i.is_dir()]
            if not names:
                raise ValueError("the archive has no file")
            name = next((n for n in names if n.lower().endswith((".gpml", ".xml"))), names[0])
            return z.read(name).decode("utf-8")
    return data.decode("utf-8")


def decoded(files: DataFrame) -> DataFrame:
    """(path, text) of files (path, content) that may be compressed."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "text": [decode_archive(bytes(b)) for b in batch["content"]]})

    return files.select("path", "content").mapInPandas(decode, "path STRING, text STRING")


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, text) of files that may be compressed; only Spark reads them."""
    return decoded(spark.read.format("binaryFile").load(list(paths)))


def property_name(xml: Column) -> Column:
    """Name of the nearest known geometry property around a member's first polygon, else "geometry"; null without a polygon."""
    known = " or ".join(f'local-name()="{n}"' for n in GEOMETRY_NAMES)
    first = '(//*[local-name()="Polygon"])[1]'
    found = F.xpath_string(xml, F.lit(f"local-name({first}/ancestor::*[{known}][1])"))
    return F.when(F.xpath_int(xml, F.lit(f"count({first})")) > 0, F.coalesce(F.nullif(F.element_at(F.split(found, ":"), -1), F.lit("")), F.lit("geometry")))


def kind_of(path: Column, text: Column) -> Column:
    """json or gpml, by the extension without query and hash; for other names by the first character."""
    extension = F.lower(F.regexp_extract(F.regexp_replace(path, r"[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))
    head = F.left(F.regexp_replace(text, r"^\s+", ""), F.lit(1))
    return F.when(extension == "json", "json").when(extension.isin("gpml", "gpmlz", "xml"), "gpml").when(head.isin("{", "["), "json").when(head == "<", "gpml")


def _ring(text: Column, dimension: Column) -> Column:
    """Closed points of a position list, in the order of axes that its numbers show. Numbers and order are found once, not once a point."""
    return let(S.numbers(text), lambda values: let(S.is_lat_lon(values, dimension), lambda lat_lon: closed(S.positions(values, dimension, lat_lon))))


_MEMBER = r"(?s)<(?:[\w.-]+:)?featureMember\b[^>]*>.*?</(?:[\w.-]+:)?featureMember>"


def parse_gpml(files: DataFrame, text: str = "text", all_areas: bool = False) -> DataFrame:
    """Members of whole texts, as parse_members() gives them. Comments are taken out before a text is cut, so that tags in them don't count."""
    bare = F.regexp_replace(F.col(text), r"(?s)<!--.*?-->", "")
    rows = files.select(F.posexplode(F.regexp_extract_all(bare, F.lit(_MEMBER), F.lit(0))).alias("member_index", "xml"))
    return parse_members(rows, all_areas)


def read_members(spark: SparkSession, *paths: str, closing: str = "</gml:featureMember>") -> DataFrame:
    """(member_index, xml) of plain GPML files, however large: the closing tag ends a record, so that Spark splits a file among tasks. Indices ascend within a file, with gaps."""
    rows = spark.read.option("lineSep", closing).text(list(paths)).withColumn("member_index", F.monotonically_increasing_id())
    xml = F.regexp_extract(F.concat("value", F.lit(closing)), _MEMBER, 0)
    return rows.select("member_index", xml.alias("xml")).filter("xml <> ''")


#: What is read of a member, as text: fields by their local names, attributes, and polygons with their position lists.
_MEMBER_SCHEMA = (
    "identity string, name string, reconstructionPlateId string, conjugatePlateId string, begin string, end string, centre boolean, "
    "keys array<string>, values array<string>, polygons array<struct<dimension: string, exterior: string, interiors: array<string>>>"
)
_PREFIX = re.compile(r"[<\s/]([A-Za-z_][\w.-]*):[A-Za-z_]")
_DECLARED = re.compile(r"\sxmlns(:[\w.-]+)?\s*=\s*(\"[^\"]*\"|'[^']*')")


def member_fields(xml: str) -> dict:
    """The fields of _MEMBER_SCHEMA of one member. A fragment has left its document, so its prefixes are declared anew; names are local names. Text that is no XML raises ParseError."""
    bare = _DECLARED.sub("", xml)
    root = ElementTree.fromstring("<r " + " ".join(f'xmlns:{p}="{p}"' for p in {*_PREFIX.findall(bare)} - {"xml"}) + f">{bare}</r>")
    local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    below = lambda e, *names: (x for x in e.iter() if x is not e and local(x) in names)
    text = lambda e: None if e is None else "".join(e.itertext())
    direct = lambda e: [t for t in (e.text, *(c.tail for c in e)) if t]
    first = lambda e, name: None if e is None else next(below(e, name), None)
    entries = list(below(root, "KeyValueDictionaryElement"))
    time = first(root, "validTime")
    out = {name: text(first(root, name)) for name in ("identity", "name", "reconstructionPlateId", "conjugatePlateId")}
    out |= {name: text(first(time, name)) for name in ("begin", "end")}
    out["centre"] = first(root, "centerLineOf") is not None
    out["keys"] = [t for e in entries for k in e if local(k) == "key" for t in direct(k)]
    out["values"] = [t for e in entries for v in below(e, "value") for t in direct(v)]
    polygons = []
    for polygon in below(root, "Polygon"):
        sizes = (v for e in polygon.iter() for n, v in e.attrib.items() if n.rpartition("}")[2] == "dimension")
        inner = [t for i in below(polygon, "interior") for p in below(i, "posList") for t in direct(p)]
        polygons.append({"dimension": next(sizes, None), "exterior": text(first(first(polygon, "exterior"), "posList")), "interiors": inner})
    return out | {"polygons": polygons}


@F.pandas_udf(StringType())
def _member(xml: pd.Series) -> pd.Series:
    """Each member is parsed once, in Arrow batches."""
    return xml.map(lambda x: None if x is None else json.dumps(member_fields(x)))


def parse_members(rows: DataFrame, all_areas: bool = False) -> DataFrame:
    """A row for each feature member (member_index, xml) that has an element: feature_id, member_index, feature_type, name, plate_id, conjugate_plate_id, begin_age, end_age, attributes, polygons (rings of at least four points) and intent."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    # A generator: the planner doesn't repeat the parse for each field that is read from it.
    parsed = rows.select("member_index", "xml", F.inline(F.array(F.from_json(_member(F.col("xml")), _MEMBER_SCHEMA))))
    read = parsed.select(
        "member_index",
        F.regexp_extract("xml", r"(?s)featureMember\b[^>]*>\s*<(?:[\w.-]+:)?([\w.-]+)", 1).alias("feature_type"),
        F.coalesce(blank(F.col("identity")), F.nullif(F.regexp_extract("xml", r"(?s)featureMember\b[^>]*>\s*<[^>]*\bid=\"([^\"]*)\"", 1), F.lit("")), F.concat(F.lit("gpml-feature-"), F.col("member_index").cast("string"))).alias("feature_id"),
        *(blank(F.col(c)).alias(f"_{n}") for c, n in (("name", "name"), ("reconstructionPlateId", "plate"), ("conjugatePlateId", "conjugate"), ("begin", "begin"), ("end", "end"))),
        F.when(F.size("keys") == F.size("values"), S.last_by_key(F.col("keys"), F.col("values"))).otherwise(F.create_map().cast("map<string,string>")).alias("attributes"),
        F.col("centre").alias("_centre"),
        F.col("polygons").alias("_polygons"),
    )
    dimension = lambda p: F.coalesce(p["dimension"].cast("int"), F.lit(2))
    inner = lambda p: F.filter(F.transform(p["interiors"], lambda t: _ring(t, dimension(p))), lambda r: F.size(r) >= 4)
    polygons = F.filter(F.transform("_polygons", lambda p: F.struct(_ring(p["exterior"], dimension(p)).alias("exterior"), inner(p).alias("interiors"))), lambda g: F.size(g["exterior"]) >= 4)
    plate = lambda c: c.cast("bigint").cast("string")
    shaped = read.filter("feature_type <> ''").select("*", F.inline(F.array(F.struct(polygons.alias("polygons")))))
    attribute_type = S.attribute(F.col("attributes"), "GPGIM_TYPE")
    return shaped.select(
        "feature_id",
        "member_index",
        "feature_type",
        F.coalesce("_name", S.attribute(F.col("attributes"), "NAME")).alias("name"),
        plate(F.coalesce(S.first_number(F.col("_plate")), S.first_number(S.attribute(F.col("attributes"), *PLATE_KEYS)))).alias("plate_id"),
        plate(S.first_number(F.col("_conjugate"))).alias("conjugate_plate_id"),
        F.coalesce(S.geo_time(F.col("_begin")), F.lit(DISTANT_PAST)).alias("begin_age"),
        F.coalesce(S.geo_time(F.col("_end")), F.lit(DISTANT_FUTURE)).alias("end_age"),
        "attributes",
        "polygons",
        intent(F.when(F.col("_centre"), "centerLineOf"), F.col("feature_type"), attribute_type, F.size("polygons"), all_areas).alias("intent"),
    )


def parse_legacy_json(files: DataFrame, text: str = "text") -> DataFrame:
    """Features of the legacy JSON form: only the first polygon of each, all of them areas; features without one are left out."""
    items = files.select(F.posexplode(F.from_json(F.col(text), LEGACY)).alias("member_index", "f"))
    ring = F.transform(F.get("f.Polygon", F.lit(0))["PosList"], lambda p: F.struct(p["Longitude"].alias("x"), p["Latitude"].alias("y")))
    rows = items.select(F.col("f.FeatureID").alias("feature_id"), "member_index", F.col("f.PlateID").alias("plate_id"), F.col("f.ValidTime.Begin").alias("begin_age"), F.col("f.ValidTime.End").alias("end_age"), ring.alias("exterior"), F.lit("area").alias("intent"))
    return rows.filter(F.col("exterior").isNotNull())


def parse_geojson_rings(files: DataFrame, text: str = "text") -> DataFrame:
    """(ring_index, ring) of every Polygon and MultiPolygon ring of a collection, a feature or a bare geometry; rings are closed, and one with an invalid position is dropped whole."""
    v = F.try_parse_json(F.col(text))
    kind = F.try_variant_get(v, "$.type", "string")
    geometries = F.when(kind == "FeatureCollection", F.try_variant_get(v, "$.features", "array<variant>")).otherwise(F.array(v))
    rows = files.select(F.explode(geometries).alias("g")).select(F.when(F.try_variant_get("g", "$.geometry", "variant").isNotNull(), F.try_variant_get("g", "$.geometry", "variant")).otherwise(F.col("g")).alias("g"))
    shape = F.try_variant_get("g", "$.type", "string")
    rings = F.when(shape == "Polygon", F.try_variant_get("g", "$.coordinates", "array<variant>")).when(shape == "MultiPolygon", F.flatten(F.try_variant_get("g", "$.coordinates", "array<array<variant>>")))
    numbers = rows.select(F.explode(rings).alias("r")).select(F.try_variant_get("r", "$", "array<array<double>>").alias("r"))
    ok = F.forall("r", lambda p: (F.size(p) >= 2) & F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull())
    points = F.transform("r", lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return numbers.filter((F.size("r") >= 2) & ok).select(closed(points).alias("ring"))
