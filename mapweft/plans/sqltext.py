"""Pieces of oracle SQL that several queries share."""

from __future__ import annotations


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v)


def case_of(expr: str, table: dict, default=None) -> str:
    """A lookup table as a simple CASE."""
    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items())
    return f"CASE {expr} {arms} ELSE {lit(default)} END"


def among(expr: str, values) -> str:
    """Membership that is false for null."""
    return f"coalesce({expr} IN ({', '.join(lit(v) for v in values)}), FALSE)"


def clean(col: str) -> str:
    return f"lower(trim(coalesce({col}, '')))"


def measure(col: str) -> str:
    first = f"replace(trim(split_part(trim({col}), ';', 1)), ',', '.')"
    body = f"trim(regexp_replace(regexp_replace(regexp_replace({first}, '''+$', ''), 'ft$', ''), 'm$', ''))"
    return (f"CASE WHEN {first} LIKE '%''' OR {first} LIKE '%ft' THEN TRY_CAST({body} AS DOUBLE) * 0.3048 "
            f"ELSE TRY_CAST({body} AS DOUBLE) END")


def first_number(col: str) -> str:
    return f"TRY_CAST(replace(split_part(trim({col}), ' ', 1), ',', '.') AS DOUBLE)"


def draw(a: str, b: str, salt: int = 0) -> str:
    """A uniform number in [0, 1) keyed by two integers."""
    return f"((xor(xor({a} * 73856093, {b} * 19349663), CAST({salt * 83492791} AS BIGINT)) % 1000003) / 1000003.0)"


def ring_hits(points: str, outline: str, pid: str, key: str, x: str = "x", y: str = "y", reach: int = 0) -> str:
    """(pid, key, inside, distance) of points within `reach` of the boxes of outlines; ring-wise if the key says so."""
    t = "greatest(0, least(1, (({x} - ax) * (ex - ax) + ({y} - ay) * (ey - ay)) / ((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay))::DOUBLE))"
    t = t.replace("{x}", f"p.{x}").replace("{y}", f"p.{y}")
    return f"""(SELECT p.{pid}, {key},
   count(*) FILTER (WHERE (ay > p.{y}) <> (ey > p.{y}) AND p.{x} < ax + (p.{y} - ay) * (ex - ax) / (ey - ay)::DOUBLE) % 2 = 1
   AND NOT bool_or((ex - ax) * (p.{y} - ay) = (ey - ay) * (p.{x} - ax) AND p.{x} BETWEEN least(ax, ex) AND greatest(ax, ex) AND p.{y} BETWEEN least(ay, ey) AND greatest(ay, ey)) AS inside,
   min(sqrt(power(p.{x} - (ax + {t} * (ex - ax)), 2) + power(p.{y} - (ay + {t} * (ey - ay)), 2))) AS distance
 FROM {points} p JOIN (SELECT {key}, min(ax) - {reach} AS l, max(ax) + {reach} AS r, min(ay) - {reach} AS b, max(ay) + {reach} AS u FROM {outline} GROUP BY {key}) box
   ON p.{x} BETWEEN l AND r AND p.{y} BETWEEN b AND u JOIN {outline} USING ({key}) GROUP BY p.{pid}, {key})"""


def ring_area(outline: str, key: str) -> str:
    """(key, area): outer ring less holes."""
    return f"""(SELECT {key}, sum(CASE WHEN ring = 0 THEN a ELSE -a END) AS area
 FROM (SELECT {key}, ring, abs(sum(ax * ey - ex * ay)) / 2.0 AS a FROM {outline} GROUP BY {key}, ring) r GROUP BY {key})"""


def in_boxes(lat: str, lon: str, boxes) -> str:
    return "(" + " OR ".join(f"({lat} BETWEEN {s} AND {n} AND {lon} BETWEEN {w} AND {e})" for s, n, w, e in boxes) + ")"


# The category of a v_tagged row, from its tag columns. {area} is a boolean expression.
def category(area: str) -> str:
    from ..functions import tables as V

    def any_of(col, values):
        return among(col, values)

    military = "(coalesce(landuse = 'military', FALSE) OR coalesce(military, 'no') <> 'no')"
    paved, unpaved = any_of("surface", V.PAVED_SURFACES), any_of("surface", V.UNPAVED_SURFACES)
    return f"""CASE
 WHEN building IS NOT NULL THEN 'building'
 WHEN {any_of('tunnel', V.TUNNEL_VALUES)} AND NOT ({area} AND coalesce(tunnel = 'building_passage', FALSE)) THEN NULL
 WHEN amenity IN ('parking', 'bus_station') OR landuse = 'garages' THEN 'parking'
 WHEN coalesce(highway = 'pedestrian', FALSE) AND ({area} OR coalesce(area = 'yes', FALSE)) THEN 'plaza'
 WHEN highway IN ('motorway', 'trunk', 'primary', 'motorway_link', 'trunk_link', 'primary_link') THEN 'road_major'
 WHEN highway IN ('secondary', 'tertiary', 'secondary_link', 'tertiary_link') THEN 'road_medium'
 WHEN highway IN ('residential', 'unclassified', 'living_street') THEN 'road_minor'
 WHEN highway = 'pedestrian' THEN 'pedestrian'
 WHEN highway = 'service' THEN 'road_service'
 WHEN highway = 'track' THEN CASE WHEN {paved} THEN 'road_service' ELSE 'road_track' END
 WHEN highway IN ('path', 'footway', 'cycleway', 'bridleway', 'steps') THEN
   CASE WHEN {paved} THEN 'paved_path' WHEN {unpaved} THEN 'dirt_path'
        WHEN highway IN ('footway', 'cycleway', 'steps') THEN 'paved_path' ELSE 'dirt_path' END
 WHEN highway IS NOT NULL THEN 'road_minor'
 WHEN leisure = 'swimming_pool' THEN 'pool'
 WHEN "natural" = 'coastline' THEN 'coastline'
 WHEN man_made IN ('pier', 'breakwater', 'groyne') THEN 'pier'
 WHEN {any_of('railway', V.RAIL_TRACKS)} THEN 'railway'
 WHEN {any_of('aeroway', V.AIRPORT_GROUNDS + V.AIRPORT_PAVED)} AND NOT {military} THEN 'airport'
 WHEN coalesce(landuse = 'railway', FALSE) OR {any_of('railway', V.RAIL_GROUNDS)} THEN 'railway'
 WHEN coalesce("natural" = 'water', FALSE) OR {any_of('waterway', ['river', 'riverbank', 'canal', 'stream'])} THEN 'water'
 WHEN landuse IN ('reservoir', 'basin') THEN 'water'
 WHEN coalesce(landuse = 'forest', FALSE) OR coalesce("natural" = 'wood', FALSE) THEN 'forest'
 WHEN "natural" IN ('scrub', 'heath') THEN 'scrub'
 WHEN "natural" = 'wetland' THEN 'wetland'
 WHEN "natural" = 'tree' THEN 'tree_single'
 WHEN leisure = 'playground' THEN 'playground'
 WHEN leisure = 'track' THEN 'track'
 WHEN leisure IN ('sports_centre', 'stadium') THEN 'sports'
 WHEN leisure = 'park' THEN 'park'
 WHEN leisure IN ('garden', 'pitch') THEN 'grass'
 WHEN {any_of('landuse', ['grass', 'meadow', 'recreation_ground'])} OR coalesce("natural" = 'grassland', FALSE) THEN 'grass'
 WHEN landuse IN ('farmland', 'farmyard', 'allotments') THEN 'farmland'
 WHEN landuse IN ('orchard', 'vineyard') THEN 'orchard'
 WHEN coalesce(landuse = 'cemetery', FALSE) OR coalesce(amenity = 'grave_yard', FALSE) THEN 'cemetery'
 WHEN "natural" IN ('beach', 'sand') THEN 'sand'
 WHEN landuse IN ('brownfield', 'construction', 'quarry') THEN 'dirt'
 WHEN {any_of('amenity', V.SCHOOL_AMENITIES)} THEN 'schoolyard'
 WHEN amenity IN ('hospital', 'clinic') THEN 'hospital_grounds'
 WHEN coalesce(amenity = 'marketplace', FALSE) OR {any_of('landuse', ['commercial', 'retail'])} THEN 'commercial'
 WHEN landuse = 'industrial' THEN 'industrial'
 WHEN {military} THEN 'military'
 WHEN landuse = 'residential' THEN 'residential'
 WHEN amenity = 'place_of_worship' THEN 'worship_grounds'
 WHEN {any_of('barrier', V.FENCE_BARRIERS)} THEN 'fence'
 WHEN barrier = 'hedge' THEN 'hedge' END"""


def building_kind() -> str:
    """The special kind of a v_tagged row."""
    from ..functions import tables as V

    arms = []
    for key in V.KIND_KEYS:
        if key not in ("amenity", "shop", "healthcare", "leisure", "tourism", "office", "military", "historic", "building"):
            continue
        arms.append(case_of(clean(key), V.KIND_BY_VALUE))
        if key == "shop":
            arms.append(f"CASE WHEN {clean(key)} NOT IN ('', 'no', 'vacant') THEN 'shop' END")
        if key == "healthcare":
            arms.append(f"CASE WHEN {clean(key)} <> '' THEN 'medical' END")
        if key == "military":
            arms.append(f"CASE WHEN {clean(key)} NOT IN ('', 'no') THEN 'military' END")
    by_name = "CASE " + " ".join(f"WHEN contains(lower(coalesce(name, '')), {lit(n)}) THEN {lit(k)}" for n, k in V.KIND_BY_NAME) + " END"
    return "coalesce(" + ",\n ".join(arms + [by_name]) + ")"


def levels(max_levels: int = 6) -> str:
    """Storeys of a v_tagged row from its levels and height tags."""
    n, h = measure("levels"), measure("height")
    def clamp(v):
        return f"greatest(1, least({max_levels}, {v}))"
    return (f"coalesce(CASE WHEN {n} >= 1 THEN {clamp(f'CAST(floor({n}) AS INT)')} END, "
            f"CASE WHEN {h} > 0 THEN {clamp(f'CAST(floor(({h}) / 3.0) AS INT)')} END)")


def climate(lat: str, lon: str) -> str:
    from ..functions import tables as V

    return f"""CASE WHEN {in_boxes(lat, lon, V.ARID_BOXES)} THEN 'arid'
 WHEN {in_boxes(lat, lon, V.MEDITERRANEAN_BOXES)} THEN 'mediterranean'
 WHEN abs({lat}) >= 58 THEN 'boreal' WHEN abs({lat}) >= 46 THEN 'cool' WHEN abs({lat}) >= 32 THEN 'temperate'
 WHEN abs({lat}) >= 18 THEN 'subtropical' ELSE 'tropical' END"""


def way_width(cat: str) -> str:
    from ..functions import tables as V

    lanes = "TRY_CAST(trim(split_part(lanes, ';', 1)) AS INT)"
    by_lanes = f"greatest(1, least(8, {lanes})) * 3.2 + 1.0"
    return f"""coalesce(CASE WHEN {first_number('width')} IS NOT NULL THEN greatest(2.0, least(30.0, {first_number('width')})) END,
 CASE WHEN {lanes} IS NOT NULL THEN CASE WHEN oneway = 'yes' THEN greatest({by_lanes}, 3.5) ELSE {by_lanes} END END,
 {case_of(cat, V.ROAD_WIDTH_M)})"""
