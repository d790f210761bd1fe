"""Readers: element lists, feature sequences, footprints, layers, placements and class planes.

Each format has a parser on a column and a reader on a path; the reader only
adds the scan.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import geo as P
from ..functions import tables as V


def c(name: str) -> Column:
    return F.col(name)


# ------------------------------------------------------------------- element lists
def parse_elements(elements: DataFrame) -> DataFrame:
    """Features (osm_id, kind, tags, rings) from a column `el` of element structs.

    Ways without points, members without geometry and nodes without a
    position are dropped.
    """
    el, blank = c("el"), F.create_map().cast(model.TAGS)
    has_pts = F.coalesce(F.size(el["geometry"]) > 0, F.lit(False))
    way = F.when(has_pts, F.array(F.struct(F.lit("outer").alias("role"), el["geometry"].alias("pts"))))
    node = F.when(el["lat"].isNotNull() & el["lon"].isNotNull(),
                  F.array(F.struct(F.lit("").alias("role"), F.array(F.struct(el["lat"].alias("lat"), el["lon"].alias("lon"))).alias("pts"))))
    members = F.filter(F.coalesce(el["members"], F.array()), lambda m: F.coalesce(F.size(m["geometry"]) > 0, F.lit(False)))
    rel = F.when(F.size(members) > 0, F.transform(members, lambda m: F.struct(F.coalesce(m["role"], F.lit("")).alias("role"), m["geometry"].alias("pts"))))
    rings = F.when(el["type"] == "way", way).when(el["type"] == "node", node).when(el["type"] == "relation", rel)
    return elements.select(el["id"].alias("osm_id"), el["type"].alias("kind"), F.coalesce(el["tags"], blank).alias("tags"), rings.alias("rings")).where("rings IS NOT NULL")


def scan_osm_elements(spark: SparkSession, path: str) -> DataFrame:
    """Whole payload files. Files are the unit of parallelism, as the format has no lines."""
    raw = spark.read.schema(model.ELEMENTS).json(path, multiLine=True)
    return parse_elements(raw.select(F.explode("elements").alias("el")))


# ------------------------------------------------------------------- feature sequences
_SEQ = "struct<type:string,id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"


def parse_geojsonseq(lines: DataFrame) -> DataFrame:
    """Features from a column `value` of one GeoJSON object per line; bad lines are skipped.

    Ids come from @id or id ("way/123"); lines without one get a negative id
    hashed from their text, the same on every run.
    """
    text = F.regexp_replace(c("value"), "^\\x1e", "")
    f = F.from_json(text, _SEQ)
    df = lines.select(text.alias("_text"), f.alias("f")).where(c("f.geometry.type").isNotNull())
    raw_id = F.coalesce(c("f.properties")["@id"], c("f.id"))
    number = F.regexp_extract(raw_id, r"(\d+)$", 1).try_cast("bigint")
    kind = F.lower(F.regexp_extract(raw_id, r"^(node|way|relation)", 1))
    # 62 bits of the text, below every number that is given out otherwise.
    own = -F.pmod(F.xxhash64("_text"), F.lit(1 << 62)) - F.lit(1 << 61)
    tags = F.map_filter(c("f.properties"), lambda k, _v: ~k.startswith("@"))
    g, coords = c("f.geometry.type"), c("f.geometry.coordinates")

    def pts(arr):
        return F.transform(arr, lambda p: F.struct(F.get(p, F.lit(1)).alias("lat"), F.get(p, F.lit(0)).alias("lon")))

    line = F.from_json(coords, "array<array<double>>")
    poly = F.from_json(coords, "array<array<array<double>>>")
    spot = F.from_json(coords, "array<double>")
    multi = F.from_json(coords, "array<array<array<array<double>>>>")

    def roles(rings):
        return F.transform(rings, lambda r, i: F.struct(F.when(i == 0, F.lit("outer")).otherwise(F.lit("inner")).alias("role"), pts(r).alias("pts")))

    rings = F.when(g == "Point", F.array(F.struct(F.lit("").alias("role"), pts(F.array(spot)).alias("pts")))) \
        .when(g == "LineString", F.array(F.struct(F.lit("outer").alias("role"), pts(line).alias("pts")))) \
        .when(g == "Polygon", roles(poly)).when(g == "MultiPolygon", F.flatten(F.transform(multi, roles)))
    holed = (g == "MultiPolygon") | ((g == "Polygon") & (F.size(poly) > 1))
    shape_kind = F.when(g == "Point", F.lit("node")).when(holed, F.lit("relation")).otherwise(F.lit("way"))
    return df.select(F.coalesce(number, own).alias("osm_id"), F.when(holed, F.lit("relation")).when(kind != "", kind).otherwise(shape_kind).alias("kind"),
                     tags.alias("tags"), rings.alias("rings")).where("rings IS NOT NULL AND size(rings) > 0")


def scan_geojsonseq(spark: SparkSession, path: str) -> DataFrame:
    return parse_geojsonseq(spark.read.text(path))


# ------------------------------------------------------------------- tables
def scan_feature_table(table: DataFrame, box: tuple[float, float, float, float], version: int = V.FILTERS_VERSION) -> DataFrame:
    """Cached features, only when stored for this filter version and this box."""
    same = c("filters_version") == version
    for name, v in zip(("s", "w", "n", "e"), box):
        same = same & (F.abs(c(f"box_{name}") - v) <= 1e-9)
    return table.where(same)


def scan_buildings_bbox(footprints: DataFrame, boxes: DataFrame | list[tuple[float, float, float, float]]) -> DataFrame:
    """Footprints whose bbox struct overlaps any box (xmin, ymin, xmax, ymax).

    A few literal boxes become pushed Parquet filters on the nested bbox; a
    table of boxes is joined by buckets behind a pushed hull.
    """
    b = c("bbox")
    if isinstance(boxes, list):
        any_box = F.lit(False)
        for x0, y0, x1, y1 in boxes:
            any_box = any_box | ((b["xmin"] <= x1) & (b["xmax"] >= x0) & (b["ymin"] <= y1) & (b["ymax"] >= y0))
        return footprints.where(any_box)
    from ..operators.bucket import bucket_join

    hull = boxes.agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).first()
    near = scan_buildings_bbox(footprints, [tuple(hull)]) if hull[0] is not None else footprints.limit(0)
    q = boxes.select(*[c(n).alias(f"q_{n}") for n in ("xmin", "ymin", "xmax", "ymax")])
    return bucket_join(near, q, (b["xmin"], b["ymin"], b["xmax"], b["ymax"]), ("q_xmin", "q_ymin", "q_xmax", "q_ymax"), 0.05,
                       how="left_semi", key=["id"], levels=(1, 64))


def files_in_extent(catalogue: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Catalogue rows whose extent (xmin, ymin, xmax, ymax) meets a box."""
    x0, y0, x1, y1 = box
    return catalogue.where((c("xmin") <= x1) & (c("xmax") >= x0) & (c("ymin") <= y1) & (c("ymax") >= y0))


def prune_files_by_extent(catalogue: DataFrame, box: tuple[float, float, float, float], most: int = 100_000) -> list[str]:
    """Paths of the files that a box meets: what a reader is given to open.

    Only paths come to the driver, which lists the files it reads in any case; a box that
    meets more than `most` of them is an error, not a list.
    """
    paths = [r.path for r in files_in_extent(catalogue, box).select("path").distinct().limit(most + 1).collect()]
    if len(paths) > most:
        raise ValueError(f"more than {most} files meet the box: read it in parts")
    return paths


def parse_extract_index(index: DataFrame) -> DataFrame:
    """Regions (id, name, parent, url, s, w, n, e, geometry) from feature structs in `f`.

    The box comes from `bbox`, else from the outline; rows without id, url or
    a valid box are dropped. `f.geometry` is GeoJSON text.
    """
    rings = P.flatten_rings(c("f.geometry"))
    pts = F.flatten(rings)
    out = F.struct(F.array_min(F.transform(pts, lambda p: p["x"])).alias("w"), F.array_min(F.transform(pts, lambda p: p["y"])).alias("s"),
                   F.array_max(F.transform(pts, lambda p: p["x"])).alias("e"), F.array_max(F.transform(pts, lambda p: p["y"])).alias("n"))
    df = index.withColumn("_o", out)
    box = c("f.bbox")
    pick = [F.coalesce(F.get(box, F.lit(i)), c(f"_o.{k}")).alias(k) for i, k in enumerate(("w", "s", "e", "n"))]
    return df.select(c("f.id").alias("id"), F.coalesce("f.name", "f.id").alias("name"), c("f.parent").alias("parent"), c("f.url").alias("url"), *pick, c("f.geometry").alias("geometry")) \
        .where("id IS NOT NULL AND url IS NOT NULL AND n > s AND e > w")


def scan_extract_index(spark: SparkSession, path: str) -> DataFrame:
    schema = "features array<struct<properties:struct<id:string,name:string,parent:string,urls:map<string,string>>,bbox:array<double>,geometry:string>>"
    raw = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("x"))
    f = F.struct(c("x.properties.id").alias("id"), c("x.properties.name").alias("name"), c("x.properties.parent").alias("parent"),
                 c("x.properties.urls")["pbf"].alias("url"), c("x.bbox").alias("bbox"), c("x.geometry").alias("geometry"))
    return parse_extract_index(raw.select(f.alias("f")))


def scan_layer(layers: dict[str, DataFrame]) -> DataFrame:
    """Several layers as one table with `layer` and `fid`."""
    out = None
    for name, df in layers.items():
        part = df.withColumn("layer", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def parse_placements(lines: DataFrame) -> DataFrame:
    """Placement rows from CSV lines, with the building a unit row belongs to and its unit number."""
    row = F.from_csv(c("value"), model.PLACEMENT.simpleString()[7:-1].replace(":", " ").replace(",", ", "), {"mode": "PERMISSIVE"})
    df = lines.select(row.alias("p")).select("p.*").where("tile_x IS NOT NULL")
    unit = F.regexp_extract("file", r"_(\d{2})(?:\.\w+)?$", 1)
    return df.withColumn("base", F.regexp_replace("file", r"_(\d{2})(\.\w+)?$", "$2")).withColumn("unit", F.when(unit != "", unit.cast("int")))


def scan_placements(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(~c("value").startswith("file,"))
    return parse_placements(lines)


def parse_class_planes(files: DataFrame, block: int = 1 << 20) -> DataFrame:
    """(path, ty, x0, x1, value) runs from planes with a 16-byte header: 8 mark bytes, width and height.

    `files` has path and content. A plane whose size does not match its
    header is skipped. Rows come out as runs, a file's rows in chunks.
    """
    def runs(batches):
        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content):
                w, h = (int(v) for v in np.frombuffer(content[8:16], dtype="<u4")) if len(content) >= 16 else (0, 0)
                if w <= 0 or h <= 0 or len(content) != 16 + w * h:
                    continue
                plane = np.frombuffer(content, dtype=np.uint8, offset=16).reshape(h, w)
                rows = max(1, block // w)
                for top in range(0, h, rows):
                    part = plane[top:top + rows]
                    edge = np.ones(part.shape, dtype=bool)
                    edge[:, 1:] = part[:, 1:] != part[:, :-1]
                    ys, xs = np.nonzero(edge)
                    nxt = np.append(xs[1:], w)
                    stop = np.where(np.append(ys[1:], -1) == ys, nxt, w)
                    yield pd.DataFrame({"path": path, "ty": ys + top, "x0": xs, "x1": stop, "value": part[ys, xs].astype(np.int32)})

    return files.select("path", "content").mapInPandas(runs, "path string, ty long, x0 long, x1 long, value int")


def scan_class_plane(spark: SparkSession, path: str) -> DataFrame:
    return parse_class_planes(spark.read.format("binaryFile").load(path))


def scan_feature_grid(grid: DataFrame, box: tuple[float, float, float, float], step: float, keys: list[str]) -> DataFrame:
    """Features of a partitioned grid that meet a box: touched cells plus wide ones, exact test, one row per key."""
    s, w, n, e = box
    lo_r, hi_r, lo_c, hi_c = int(s // step), int(n // step), int(w // step), int(e // step)
    cells = (c("row").between(lo_r, hi_r) & c("col").between(lo_c, hi_c)) | (c("row") == -1)
    hit = P.boxes_meet(c("s"), c("w"), c("n"), c("e"), F.lit(s), F.lit(w), F.lit(n), F.lit(e))
    return grid.where(cells & hit).drop("row", "col").dropDuplicates(keys)


