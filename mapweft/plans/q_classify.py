"""Queries of the tag classifiers: projections and filters over tagged features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables as V
from ..functions import tags as G
from ..functions import text as X
from ..operators import rules
from . import sqltext as S
from .registry import query
from .views import TAG_COLUMNS, tagged, view

def T():
    return F.col("t")


def AREA():
    """Every fourth feature has an inside."""
    return F.col("id") % 4 == 0


AREA_SQL = "id % 4 = 0"
VT = ["v_tagged"]

# A point per feature, spread over the globe.
def LAT():
    return (F.col("id") * 7919 % 1700) / 10.0 - 85.0


def LON():
    return (F.col("id") * 104729 % 3590) / 10.0 - 179.0


LAT_SQL, LON_SQL = "((id * 7919 % 1700) / 10.0 - 85.0)", "((id * 104729 % 3590) / 10.0 - 179.0)"

HOUSE_STYLES = ["brick", "stucco", "render", "painted", "clapboard", "timber", "panel", "logs"]
SPECIAL_STYLES = {"church": ["church", "church_brick", "church_stucco"], "civic": ["civic", "civic~painted"],
                  "school": ["school"], "shop": ["shop", "shop~panel"]}


KIND_SQL = "CASE id % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END"


def KIND():
    return F.when(F.col("id") % 3 == 0, F.lit("node")).when(F.col("id") % 3 == 1, F.lit("way")).otherwise(F.lit("relation"))


_TAG_ROWS = " UNION ALL ".join(f"SELECT {KIND_SQL} AS kind, {S.lit('building:levels' if t == 'levels' else t)} AS key, \"{t}\" AS value FROM v_tagged WHERE \"{t}\" IS NOT NULL" for t in TAG_COLUMNS)


@query("tag_rules", f"""
WITH tag AS ({_TAG_ROWS}), r(kind, key, value, needs) AS (VALUES {", ".join(f"({S.lit(k)}, {S.lit(key)}, {S.lit(v)}, {S.lit(n)})" for k, key, v, n in rules.rule_rows())})
SELECT r.kind, r.key, r.value, r.needs, count(t.key) AS n FROM r LEFT JOIN tag t ON t.kind = r.kind AND t.key = r.key AND (r.value IS NULL OR t.value = r.value) AND r.needs IS NULL GROUP BY 1, 2, 3, 4""", VT)
def tag_rules(spark, d):
    """Every rule with the number of features it keeps; no feature here has a head count."""
    return rules.rule_matches(tagged(spark, d).withColumn("kind", KIND()), rules.rule_table(spark))


def _rule_hit_sql():
    parts = []
    for kind, key, value, _ in rules.rule_rows():
        if key not in ("highway", "building", "natural", "landuse", "amenity", "shop", "leisure", "tourism", "aeroway",
                       "railway", "barrier", "waterway", "man_made", "historic", "military", "office", "healthcare"):
            continue
        test = f'"{key}" IS NOT NULL' if value is None else f'"{key}" = {S.lit(value)}'
        parts.append(f"(kind = {S.lit(kind)} AND {test})")
    return " OR ".join(f"coalesce({p}, FALSE)" for p in parts)


@query("tag_rule_filter", f"""
SELECT id, kind FROM (SELECT *, {KIND_SQL} AS kind FROM v_tagged) q WHERE {_rule_hit_sql()}""", VT)
def tag_rule_filter(spark, d):
    return rules.tag_rule_filter(tagged(spark, d).withColumn("kind", KIND())).select("id", "kind")


@query("keep_referenced_ways", f"""
SELECT id FROM (SELECT *, 'way' AS kind FROM v_tagged) q
WHERE {_rule_hit_sql()}
   OR id IN (SELECT member FROM (SELECT o_orderkey, o_custkey, o_orderkey % 2000 AS member FROM orders) m
             WHERE o_custkey % 7 = 0)""", VT)
def keep_referenced_ways(spark, d):
    ways = tagged(spark, d).withColumn("kind", F.lit("way"))
    from .views import table

    members = table(spark, d, "orders").where("o_custkey % 7 = 0").select((F.col("o_orderkey") % 2000).alias("id"))
    return rules.keep_referenced_ways(ways, members).select("id")


def _flag(key, col, sql):
    query(key, f"SELECT id, {sql} AS flag FROM v_tagged", VT)(lambda spark, d: tagged(spark, d).select("id", col().alias("flag")))


def _value(key, col, sql, name="value"):
    query(key, f"SELECT id, {sql} AS {name} FROM v_tagged", VT)(lambda spark, d: tagged(spark, d).select("id", col().alias(name)))


_value("classify_category", lambda: G.classify_category(T(), AREA()), S.category(AREA_SQL), "category")

_flag("is_polygon", lambda: G.is_polygon(KIND(), T(), (F.col("id") % 5).cast("int"), F.col("id") % 2 == 0), f"""
 ({KIND_SQL} = 'relation' OR ({KIND_SQL} = 'way' AND id % 5 >= 3 AND id % 2 = 0
   AND (coalesce(area = 'yes', FALSE) OR NOT {S.among('junction', ['roundabout', 'circular'])})))""")

_TAG_COUNT = "len(list_filter([" + ", ".join(f'"{c}"' for c in ["highway", "building", "natural", "name"]) + "], lambda x: x IS NOT NULL)) > 0"
_flag("is_area_way", lambda: G.is_area_way(T(), F.col("id") % 2 == 0), f"""
 (id % 2 = 0 AND {_TAG_COUNT} AND CASE WHEN area = 'yes' THEN TRUE WHEN area = 'no' THEN FALSE
   WHEN {S.among('railway', V.RAIL_GROUNDS)} THEN TRUE WHEN "natural" = 'coastline' THEN FALSE
   WHEN highway IS NOT NULL OR railway IS NOT NULL OR barrier IS NOT NULL THEN FALSE
   WHEN {S.among('man_made', V.PIERS)} THEN FALSE WHEN {S.among('waterway', V.LINE_WATERWAYS)} THEN FALSE ELSE TRUE END)""")

_flag("is_rail_area", lambda: G.is_rail_area(T()), f"coalesce(landuse = 'railway', FALSE) OR {S.among('railway', V.RAIL_GROUNDS)}")
_flag("is_airport_area", lambda: G.is_airport_area(T()), S.among("aeroway", V.AIRPORT_AREAS))
_flag("is_airport_ground", lambda: G.is_airport_ground(T()), S.among("aeroway", V.AIRPORT_GROUNDS))
_value("building_kind", lambda: G.building_kind(T()), S.building_kind(), "kind")
_value("tower_kind", lambda: G.tower_kind(T()), """CASE WHEN man_made IN ('water_tower', 'lighthouse', 'windmill') THEN man_made
 WHEN coalesce(man_made, '') <> 'tower' AND building IN ('water_tower', 'lighthouse', 'windmill') THEN building END""", "kind")


@query("not_a_building", f"""
SELECT id, CASE WHEN {S.among('building', V.NOT_BUILDINGS)} THEN CASE WHEN building IN ('roof', 'canopy') THEN 'canopy' ELSE 'dropped' END
 ELSE 'building' END AS outcome FROM v_tagged WHERE building IS NOT NULL""", VT)
def not_a_building(spark, d):
    df = tagged(spark, d).where(G.has(T(), "building"))
    outcome = F.when(G.is_building(T()), F.lit("building")).when(G.is_canopy(T()), F.lit("canopy")).otherwise(F.lit("dropped"))
    return df.select("id", outcome.alias("outcome"))


_flag("is_shed", lambda: G.is_shed(T(), F.col("id") % 60), f"""
 {S.among('building', V.SHED_VALUES)} OR (coalesce(building, '') IN ('', 'yes') AND id % 60 <= 30)""")
_flag("is_notable", lambda: G.is_notable(T(), G.building_kind(T())), f"""
 {S.among(S.building_kind(), ['school', 'church', 'medical'])} OR {S.among('amenity', V.NOTABLE_AMENITY)}
 OR {S.among('tourism', ['museum', 'attraction'])} OR coalesce(historic, 'no') NOT IN ('', 'no')
 OR {S.among('building', ['government', 'public', 'civic', 'townhall'])}""")

_CUISINE = "trim(split_part(coalesce(cuisine, ''), ';', 1))"


def _use_sql(i):
    """Front (0) or back (1) room of a use."""
    kitchen = S.case_of(_CUISINE, V.KITCHEN_BY_CUISINE)
    own = S.case_of("amenity", {k: v[i] for k, v in V.AMENITY_USES.items()})
    dining = f"coalesce({S.case_of(_CUISINE, V.DINING_BY_CUISINE)}, {own})" if i == 0 else kitchen
    tables = [("shop", V.SHOP_USES), ("healthcare", V.HEALTHCARE_USES), ("leisure", V.LEISURE_USES), ("tourism", V.TOURISM_USES)]
    by = {k: S.case_of(k, {a: b[i] for a, b in t.items()}) for k, t in tables}
    general = ["'generalstore'", "'storage'"][i]
    return f"""coalesce(CASE WHEN amenity IN ('restaurant', 'fast_food', 'food_court') AND {kitchen} IS NOT NULL THEN {dining} END,
 {own}, {by['shop']}, CASE WHEN coalesce(shop, '') NOT IN ('', 'no', 'vacant', 'yes') THEN {general} END,
 {by['healthcare']}, {by['leisure']}, {by['tourism']}, CASE WHEN office IS NOT NULL THEN 'office' END)"""


@query("use_of_tags", f"SELECT id, {_use_sql(0)} AS front, {_use_sql(1)} AS back FROM v_tagged", VT)
def use_of_tags(spark, d):
    use = G.use_of_tags(T())
    return tagged(spark, d).select("id", use["front"].alias("front"), use["back"].alias("back"))


_flag("is_hotel", lambda: G.is_hotel(F.array(T())), f"{S.among('tourism', ['hotel', 'motel', 'hostel'])} OR coalesce(building = 'hotel', FALSE)")


@query("kind_for_area", f"""
SELECT aid, category, CASE WHEN category IN ('schoolyard', 'hospital_grounds') AND side < 120 THEN 'civic'
 ELSE {S.case_of('category', V.KIND_FOR_AREA)} END AS kind FROM v_area""", ["v_area"])
def kind_for_area(spark, d):
    return view(spark, d, "v_area").select("aid", "category", G.kind_for_area(F.col("category"), F.col("side")).alias("kind"))




def draw(a, b, salt=0):
    """The keyed uniform draw, identical in the SQL."""
    return F.pmod(G.spatial_hash(F.col(a), F.col(b)).bitwiseXOR(F.lit(salt * 83492791)), F.lit(1000003)) / 1000003.0


_flag("looks_like_apartment", lambda: G.looks_like_apartment(T(), F.col("id") % 400, draw("id", "id")), f"""
 CASE WHEN {S.levels()} >= 3 THEN TRUE WHEN {S.levels()} = 1 THEN FALSE WHEN id % 400 < 150 THEN FALSE
 WHEN building IN ('house', 'detached', 'bungalow') THEN FALSE ELSE {S.draw('id', 'id')} < 0.55 END""")
_value("levels_from_tags", lambda: G.levels_from_tags(T()), S.levels(), "levels")

_LO = {k: min(a, 6) for k, (a, _b) in V.DEFAULT_LEVELS.items()}
_HI = {k: min(b, 6) for k, (_a, b) in V.DEFAULT_LEVELS.items()}
_NEAR_SQL = "CASE WHEN id % 4 = 1 THEN CAST(id % 7 AS DOUBLE) + 0.5 END"


def _NEAR():
    return F.when(F.col("id") % 4 == 1, (F.col("id") % 7).cast("double") + 0.5)


@query("building_levels", f"""
SELECT id, CAST(coalesce({S.levels()},
  CASE WHEN near IS NOT NULL AND coalesce(kind, 'house') IN ('house', 'apartment', 'shop', 'civic', 'restaurant')
       THEN greatest(1, least(CASE WHEN kind IS NULL THEN 3 ELSE 6 END, CAST(round_even(near, 0) AS INT) + nudge)) END,
  CASE WHEN kind IS NULL THEN CASE WHEN u < 0.3 THEN 2 ELSE 1 END
       ELSE CAST(lo + floor(u * (hi - lo + 1)) AS INT) END) AS INT) AS levels
FROM (SELECT *, coalesce({S.case_of('kind', _LO)}, 1) AS lo, coalesce({S.case_of('kind', _HI)}, 2) AS hi FROM
  (SELECT *, {S.building_kind()} AS kind, {_NEAR_SQL} AS near, {S.draw('id', 'id', 1)} AS u, CAST(id % 3 - 1 AS INT) AS nudge FROM v_tagged) a) b""", VT)
def building_levels(spark, d):
    df = tagged(spark, d).withColumn("kind", G.building_kind(T()))
    return df.select("id", G.building_levels(T(), F.col("kind"), _NEAR(), draw("id", "id", 1), (F.col("id") % 3 - 1).cast("int")).alias("levels"))


def _style_sql():
    houses = "[" + ", ".join(S.lit(h) for h in HOUSE_STYLES) + "]"
    own = "(xor(x0 * 83492791, y0 * 297121507) & 2147483647)"
    fits = f"list_filter({houses}, lambda s: CASE WHEN s IN ('logs', 'trailer') THEN dens < 0.06 WHEN {S.among('s', V.NOT_DENSE_STYLES)} THEN dens < 0.28 ELSE TRUE END)"
    special = " ".join(
        f"WHEN borrowed = {S.lit(k)} THEN [{', '.join(S.lit(v) for v in vs)}][CAST(xor(x0 * 73856093, y0 * 19349663) % {len(vs)} AS INT) + 1]"
        for k, vs in SPECIAL_STYLES.items())
    return f"""SELECT fid, CASE {special} ELSE styles[CAST(CASE WHEN len(styles) > 1 AND {own} % 100 >= 55 THEN ({own} // 100) % len(styles)
  ELSE xor((x0 // 110) * 73856093, (y0 // 110) * 19349663) % len(styles) END AS INT) + 1] END AS style
FROM (SELECT *, {fits} AS styles, coalesce({S.case_of('kind', V.BORROWED_STYLE)}, kind) AS borrowed
      FROM (SELECT *, (fid % 50) / 100.0 AS dens FROM v_building) a) b"""


@query("pick_style", _style_sql(), ["v_building"])
def pick_style(spark, d):
    df = view(spark, d, "v_building")
    style = G.pick_style(F.col("kind"), F.col("x0"), F.col("y0"), (F.col("fid") % 50) / 100.0, HOUSE_STYLES, SPECIAL_STYLES)
    return df.select("fid", style.alias("style"))


_MEM = "historic IN ('monument', 'memorial')"
_value("monument_kind", lambda: G.monument_kind(T()), f"""CASE WHEN amenity = 'fountain' THEN 'fountain'
 WHEN man_made IN ('water_tower', 'lighthouse', 'windmill')
   OR (coalesce(man_made, '') <> 'tower' AND coalesce(building IN ('water_tower', 'lighthouse', 'windmill'), FALSE)) THEN 'tower'
 WHEN man_made = 'obelisk' THEN 'column'
 WHEN building = 'triumphal_arch' OR (coalesce({_MEM}, FALSE) AND contains(' ' || lower(name), ' arch')) THEN 'arch'
 WHEN {_MEM} THEN 'statue'
 WHEN tourism = 'artwork' AND leisure IS NULL AND landuse IS NULL THEN 'statue' END""", "kind")

_value("fence_style", lambda: G.fence_style(T(), G.classify_category(T(), AREA())), f"""CASE WHEN barrier = 'wall' THEN 'tall_concrete'
 WHEN fence_type = 'chain_link' THEN CASE WHEN {S.among(S.category(AREA_SQL), ['industrial', 'military', 'airport', 'railway'])}
   THEN 'tall_chainlink' ELSE 'short_chainlink' END
 WHEN fence_type = 'wood' THEN 'tall_wooden' WHEN fence_type = 'wire' THEN 'cattle' WHEN fence_type = 'brick' THEN 'tall_concrete'
 ELSE {S.case_of(S.category(AREA_SQL), V.FENCE_BY_AREA, 'short_wooden')} END""", "style")

_value("climate_band", lambda: G.climate_band(LAT(), LON()), S.climate(LAT_SQL, LON_SQL), "climate")


def _biome_sql():
    B = V.BIOME
    words = "string_split(trim(regexp_replace(replace(replace(lower(coalesce(wood, '')), ',', ' '), ';', ' '), ' +', ' ', 'g')), ' ')"
    pine = f"list_has_any({words}, [{', '.join(S.lit(p) for p in V.PINE_SPECIES)}])"
    birch = f"list_has_any({words}, [{', '.join(S.lit(p) for p in V.BIRCH_SPECIES)}])"
    leaf = "coalesce(leaf_type, '')"
    opened = S.case_of("climate", V.OPEN_BIOME)
    return f"""SELECT id, CASE
 WHEN category IN ('water', 'pool') THEN {B['water']} WHEN category = 'sand' THEN {B['dirt']} WHEN category = 'wetland' THEN {B['clay_lake']}
 WHEN {S.among('category', V.BARE_CATEGORIES)} THEN {B['dirt']} WHEN category = 'plaza' THEN {B['town']}
 WHEN category = 'airport' THEN {opened} WHEN category = 'residential' THEN {B['town']}
 WHEN {S.among('category', V.TOWN_CATEGORIES)} THEN {B['town']}
 WHEN category = 'farmland' THEN CASE WHEN landuse = 'farmyard' THEN {B['farm']} ELSE {B['farmland']} END
 WHEN category = 'orchard' THEN {B['farm_forest']} WHEN category = 'cemetery' THEN {B['farm_mix']}
 WHEN category IN ('grass', 'sports') THEN {opened}
 WHEN category = 'park' THEN CASE WHEN climate IN ('boreal', 'cool') THEN {B['birch']} WHEN climate IN ('arid', 'mediterranean') THEN {B['pine']} ELSE {B['hardwood']} END
 WHEN category = 'scrub' THEN CASE WHEN {pine} OR {leaf} = 'needleleaved' OR climate IN ('arid', 'mediterranean') THEN {B['pine']}
   WHEN climate IN ('boreal', 'cool') OR {birch} THEN {B['birch_mix']} ELSE {B['hardwood']} END
 WHEN category = 'forest' THEN CASE WHEN {pine} OR {leaf} = 'needleleaved' THEN {B['pine']}
   WHEN {birch} THEN CASE WHEN {leaf} <> 'mixed' AND climate = 'boreal' THEN {B['birch']} ELSE {B['birch_mix']} END
   WHEN climate IN ('arid', 'mediterranean') THEN {B['hardwood']}
   WHEN climate = 'boreal' THEN CASE WHEN {leaf} <> 'mixed' THEN {B['birch']} ELSE {B['birch_mix']} END
   WHEN climate = 'cool' THEN {B['birch_mix']}
   WHEN climate = 'temperate' AND {leaf} = 'mixed' THEN {B['birch_mix']} ELSE {B['primary']} END
 ELSE {opened} END AS biome
FROM (SELECT *, {S.category(AREA_SQL)} AS category, {S.climate(LAT_SQL, LON_SQL)} AS climate FROM v_tagged) q"""


@query("biome_of_feature", _biome_sql(), VT)
def biome_of_feature(spark, d):
    df = tagged(spark, d).withColumn("category", G.classify_category(T(), AREA())).withColumn("climate", G.climate_band(LAT(), LON()))
    return df.select("id", G.biome_of_feature(F.col("category"), T(), F.col("climate")).alias("biome"))


_flag("is_lake", lambda: G.is_lake(T()), f"{S.among('water', V.LAKE_WATER)} OR {S.among('landuse', ['reservoir', 'basin'])}")
_value("ground_class_of", lambda: G.ground_class_of(G.classify_category(T(), AREA()), T()), f"""
 CASE WHEN {S.category(AREA_SQL)} = 'road_track' AND {S.among('surface', V.DIRT_TRACK_SURFACES)} THEN 9
 ELSE {S.case_of(S.category(AREA_SQL), V.GROUND_CLASS)} END""", "ground")


@query("way_width_m", f"""SELECT id, category, {S.way_width('category')} AS width
FROM (SELECT *, {S.category(AREA_SQL)} AS category FROM v_tagged) q WHERE {S.among('category', V.ROAD_WIDTH_M)}""", VT)
def way_width_m(spark, d):
    df = tagged(spark, d).withColumn("category", G.classify_category(T(), AREA())).where(F.col("category").isin(list(V.ROAD_WIDTH_M)))
    return df.select("id", "category", G.way_width_m(T(), F.col("category")).alias("width"))


@query("aeroway_width_m", f"""SELECT id, CASE WHEN {S.first_number('width')} IS NOT NULL THEN greatest(4.0, least(cap, {S.first_number('width')})) ELSE base END AS width
FROM (SELECT *, CASE aeroway WHEN 'runway' THEN 45.0 WHEN 'taxiway' THEN 18.0 ELSE 23.0 END::DOUBLE AS base,
 CASE aeroway WHEN 'runway' THEN 90.0 WHEN 'taxiway' THEN 45.0 ELSE 60.0 END::DOUBLE AS cap FROM v_tagged) q WHERE aeroway IS NOT NULL""", VT)
def aeroway_width_m(spark, d):
    return tagged(spark, d).where(G.has(T(), "aeroway")).select("id", G.aeroway_width_m(T()).alias("width"))


_value("bridge_level", lambda: G.bridge_level(T()), """greatest(0, least(2, CASE WHEN bridge IS NOT NULL AND bridge <> 'no'
 THEN greatest(coalesce(TRY_CAST(split_part(layer, ';', 1) AS INT), 0), 1) ELSE coalesce(TRY_CAST(split_part(layer, ';', 1) AS INT), 0) END))""", "level")
_value("control_direction", lambda: G.control_direction(T()), "coalesce(direction, 'both')", "facing")
_value("crossing_style", lambda: G.crossing_style(T()), """CASE WHEN crossing = 'unmarked' THEN 'unmarked'
 WHEN crossing = 'traffic_signals' OR highway = 'traffic_signals' THEN 'signals' ELSE 'marked' END""", "style")
_flag("oneway_allows", lambda: G.oneway_allows(T()["oneway"], F.when(F.col("id") % 2 == 0, F.lit(1)).otherwise(F.lit(-1))),
      "CASE WHEN oneway = 'yes' THEN id % 2 = 0 ELSE TRUE END")


@query("through_road_filter", f"""SELECT id, category, category IN ('road_major', 'road_medium') AS carries_on
FROM (SELECT *, {S.category(AREA_SQL)} AS category FROM v_tagged) q
WHERE {S.among('category', V.ROAD_CATEGORIES)} AND (category IN ('road_major', 'road_medium') OR id % 2 = 0)""", VT)
def through_road_filter(spark, d):
    df = tagged(spark, d).withColumn("category", G.classify_category(T(), AREA())).where(F.col("category").isin(V.ROAD_CATEGORIES))
    inside = F.col("id") % 2 == 0
    return df.where(G.is_through_road(F.col("category")) | inside).select("id", "category", G.is_through_road(F.col("category")).alias("carries_on"))


@query("property_whitelist", """SELECT id, key, value FROM (
 SELECT id, 'landuse' AS key, landuse AS value FROM v_tagged UNION ALL SELECT id, 'amenity', amenity FROM v_tagged
 UNION ALL SELECT id, 'leisure', leisure FROM v_tagged UNION ALL SELECT id, 'aeroway', aeroway FROM v_tagged
 UNION ALL SELECT id, 'railway', railway FROM v_tagged UNION ALL SELECT id, 'name', name FROM v_tagged) q WHERE value IS NOT NULL""", VT)
def property_whitelist(spark, d):
    return tagged(spark, d).select("id", F.explode(G.keep_keys(T(), V.AREA_TAGS)))


@query("address_points", "SELECT id FROM v_tagged WHERE id % 6 = 0 AND building IS NULL", VT)
def address_points(spark, d):
    number = F.when(F.col("id") % 6 == 0, F.create_map(F.lit("addr:housenumber"), F.col("id").cast("string"))) \
        .otherwise(F.create_map().cast("map<string,string>"))
    return tagged(spark, d).where(G.is_address_point(F.map_concat(T(), number))).select("id")


@query("use_points", """SELECT id FROM v_tagged WHERE amenity IS NOT NULL OR shop IS NOT NULL OR healthcare IS NOT NULL
 OR leisure IS NOT NULL OR tourism IS NOT NULL OR office IS NOT NULL""", VT)
def use_points(spark, d):
    return tagged(spark, d).where(G.is_use_point(T())).select("id")


@query("control_nodes", f"SELECT id, highway FROM v_tagged WHERE {S.among('highway', V.CONTROL_VALUES)}", VT)
def control_nodes(spark, d):
    return tagged(spark, d).where(G.is_control(T())).select("id", T()["highway"].alias("highway"))


@query("zone_layer_filter", f"""SELECT id, category FROM (SELECT *, {S.category(AREA_SQL)} AS category FROM v_tagged) q
WHERE id % 2 = 0 AND {S.among('category', V.ZONE_CATEGORIES)}
 AND CASE category WHEN 'airport' THEN {S.among('aeroway', V.AIRPORT_AREAS)}
     WHEN 'railway' THEN coalesce(landuse = 'railway', FALSE) OR {S.among('railway', V.RAIL_GROUNDS)} ELSE TRUE END""", VT)
def zone_layer_filter(spark, d):
    df = tagged(spark, d).withColumn("category", G.classify_category(T(), AREA()))
    return df.where(G.is_zone_area(F.col("category"), T(), F.col("id") % 2 == 0)).select("id", "category")


@query("named_grounds", f"""SELECT id, category, name FROM (SELECT *, {S.category(AREA_SQL)} AS category FROM v_tagged) q
WHERE {S.among('category', V.LABEL_GROUNDS)} OR (category = 'airport' AND {S.among('aeroway', V.AIRPORT_GROUNDS)})
 OR (category = 'railway' AND (coalesce(landuse = 'railway', FALSE) OR {S.among('railway', V.RAIL_GROUNDS)}))""", VT)
def named_grounds(spark, d):
    df = tagged(spark, d).withColumn("category", G.classify_category(T(), AREA()))
    return df.where(G.is_named_ground(F.col("category"), T())).select("id", "category", T()["name"].alias("name"))


@query("fenced_sites", """SELECT aid, side * side AS tiles FROM (SELECT *, CASE WHEN aid % 7 = 0 THEN 'military' ELSE category END AS use_cat FROM v_area) q
WHERE use_cat = 'military' AND side * side >= 400""", ["v_area"])
def fenced_sites(spark, d):
    use = F.when(F.col("aid") % 7 == 0, F.lit("military")).otherwise(F.col("category"))
    tiles = F.col("side") * F.col("side")
    least = X.lookup(use, V.FENCED_SITES)
    return view(spark, d, "v_area").where(tiles >= least).select("aid", tiles.alias("tiles"))


@query("retag_category", f"""SELECT aid, category, {S.case_of('category', {k: a for k, (a, b) in V.TAGS_FOR_CATEGORY.items()})} AS key,
 {S.case_of('category', {k: b for k, (a, b) in V.TAGS_FOR_CATEGORY.items()})} AS value, category AS again FROM v_area""", ["v_area"])
def retag_category(spark, d):
    df = view(spark, d, "v_area").withColumn("t", G.retag(F.col("category")))
    return df.select("aid", "category", F.map_keys("t")[0].alias("key"), F.map_values("t")[0].alias("value"),
                     G.classify_category(T(), F.lit(True)).alias("again"))


_REG = dict(c="CASE n_nationkey % 3 WHEN 0 THEN 'boundary' WHEN 1 THEN 'place' ELSE 'highway' END",
            p="CASE n_nationkey % 4 WHEN 0 THEN 'administrative' WHEN 1 THEN 'city' WHEN 2 THEN 'hamlet' ELSE 'town' END",
            a="CASE n_nationkey % 5 WHEN 0 THEN 'county' WHEN 1 THEN 'state' WHEN 2 THEN 'road' ELSE '' END",
            l="CASE WHEN n_nationkey % 6 < 5 THEN CAST(n_nationkey % 6 * 2 + 1 AS VARCHAR) END")


@query("region_type", f"""SELECT n_nationkey, CASE WHEN (c = 'boundary' AND p = 'administrative') OR {S.among('a', V.REGION_TYPES)}
  OR (c IN ('place', 'boundary') AND {S.among('p', V.REGION_TYPES + ['administrative'])} AND (coalesce(l, '') <> '' OR p <> 'administrative'))
 THEN coalesce({S.case_of("CASE WHEN a = '' THEN p ELSE a END", V.REGION_LABELS)}, CASE WHEN l IS NULL THEN 'Administrative region'
   WHEN CAST(l AS INT) <= 2 THEN 'Country' WHEN CAST(l AS INT) <= 4 THEN 'State / region' WHEN CAST(l AS INT) <= 6 THEN 'Council / county'
   WHEN CAST(l AS INT) <= 8 THEN 'City / municipality' ELSE 'Town / district' END) ELSE '' END AS label
FROM (SELECT n_nationkey, {_REG['c']} AS c, {_REG['p']} AS p, {_REG['a']} AS a, {_REG['l']} AS l FROM nation) q""")
def region_type(spark, d):
    from .views import table

    df = table(spark, d, "nation").selectExpr("n_nationkey", *[f"{v.replace('VARCHAR', 'STRING')} AS {k}" for k, v in _REG.items()])
    return df.select("n_nationkey", G.region_type(F.col("c"), F.col("p"), F.col("a"), F.col("l")).alias("label"))
