"""Classification of features by their tags. `t` is always a tag map column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as V
from .text import clean, first_word_number, lookup, parse_measure, species_tokens, to_double


def isin(col: Column, values) -> Column:
    """Membership test that is false, not null, for a missing value."""
    return F.coalesce(col.isin(list(values)), F.lit(False))


def is_(t: Column, key: str, *values: str) -> Column:
    return isin(t.getItem(key), values)


def has(t: Column, key: str) -> Column:
    return t.getItem(key).isNotNull()


def case(*branches, default=None) -> Column:
    """First matching (condition, value) pair."""
    out = None
    for cond, value in branches:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(F.lit(default) if not isinstance(default, Column) else default)


# ------------------------------------------------------------------- categories
def is_rail_area(t: Column) -> Column:
    return is_(t, "landuse", "railway") | isin(t.getItem("railway"), V.RAIL_GROUNDS)


def is_airport_ground(t: Column) -> Column:
    return isin(t.getItem("aeroway"), V.AIRPORT_GROUNDS)


def is_airport_area(t: Column) -> Column:
    return isin(t.getItem("aeroway"), V.AIRPORT_AREAS)


def _land_category(t: Column, military: Column) -> Column:
    """The first land rule that matches.

    Each key's values map to "order + category" text and the smallest wins, so
    the whole rule list is a dozen lookups instead of a long CASE.
    """
    by_key: dict[str, dict[str, str]] = {}
    candidates = []
    for order, (key, values, category) in enumerate(V.LAND_RULES):
        mark = f"{order:02d}{category}"
        if key == "*military":
            candidates.append(F.when(military, F.lit(mark)))
        for value in values:
            by_key.setdefault(key, {}).setdefault(value, mark)
    for key, table in by_key.items():
        hit = lookup(t[key.rstrip("!")], table)
        candidates.append(F.when(~military, hit) if key.endswith("!") else hit)
    return F.substring(F.least(*candidates), 3, 40)


def classify_category(t: Column, area: Column) -> Column:
    """One of about 45 categories, null for features that are not drawn."""
    surface = F.lower(F.coalesce(t["surface"], F.lit("")))
    paved, unpaved = isin(surface, V.PAVED_SURFACES), isin(surface, V.UNPAVED_SURFACES)
    arcade = area & is_(t, "tunnel", "building_passage")
    below = (isin(t["tunnel"], V.TUNNEL_VALUES) & ~arcade) | is_(t, "location", "underground") \
        | is_(t, "parking", "underground")
    military = is_(t, "landuse", "military") | ~isin(F.coalesce(F.nullif(t["military"], F.lit("")), F.lit("no")), ["no"])
    highway = t["highway"]
    square = is_(t, "place", "square") | has(t, "area:highway") \
        | (isin(highway, ["pedestrian"]) & (area | is_(t, "area", "yes"))) \
        | (area & isin(highway, ["footway"]) & is_(t, "covered", "colonnade", "arcade", "yes"))
    walked = isin(highway, ["footway", "cycleway", "steps"])
    foot = F.when(paved | (walked & ~unpaved), F.lit("paved_path")).otherwise(F.lit("dirt_path"))
    road = case(
        (isin(highway, ["track"]), F.when(paved, F.lit("road_service")).otherwise(F.lit("road_track"))),
        (walked | isin(highway, ["path", "bridleway"]), foot),
        default=F.coalesce(lookup(highway, V.ROAD_BY_HIGHWAY), F.lit("road_minor")))
    return case(
        (has(t, "building"), "building"),
        (below, None),
        (is_(t, "amenity", "parking", "bus_station") | is_(t, "landuse", "garages"), "parking"),
        (square, "plaza"),
        (F.length(F.coalesce(highway, F.lit(""))) > 0, road),
        (is_(t, "leisure", "swimming_pool") & ~is_(t, "indoor", "yes", "covered"), "pool"),
        default=_land_category(t, military))


def is_polygon(kind: Column, t: Column, n_points: Column, closed: Column) -> Column:
    """Relations and closed ways are areas, but a closed roundabout is a road."""
    ring = (kind == "way") & (n_points >= 3) & closed
    return (kind == "relation") | (ring & (is_(t, "area", "yes") | ~is_(t, "junction", "roundabout", "circular")))


def is_area_way(t: Column, closed: Column) -> Column:
    """The stricter rule used when reading extracts: what a closed way is."""
    tagged = F.coalesce(F.size(t) > 0, F.lit(False))
    lines = F.lit(False)
    for key in V.LINE_KEYS:
        lines = lines | has(t, key)
    return closed & tagged & case(
        (is_(t, "area", "yes"), True), (is_(t, "area", "no"), False),
        (isin(t["railway"], V.RAIL_GROUNDS), True),
        (is_(t, "natural", "coastline"), False), (lines, False),
        (isin(t["man_made"], V.PIERS), False),
        (isin(t["waterway"], V.LINE_WATERWAYS), False), default=True)


# ------------------------------------------------------------------- buildings
def building_kind(t: Column) -> Column:
    """The special kind of a building from its tags, then from its name."""
    tests = []
    for key in V.KIND_KEYS:
        value = clean(t[key])
        known = lookup(value, V.KIND_BY_VALUE)
        if key == "shop":
            known = F.coalesce(known, F.when(~value.isin("", "no", "vacant"), F.lit("shop")))
        elif key == "healthcare":
            known = F.coalesce(known, F.when(value != "", F.lit("medical")))
        elif key == "military":
            known = F.coalesce(known, F.when(~value.isin("", "no"), F.lit("military")))
        tests.append(known)
    name = F.lower(F.coalesce(t["name"], F.lit("")))
    by_name = case(*[(name.contains(needle), kind) for needle, kind in V.KIND_BY_NAME])
    return F.coalesce(*tests, by_name)


def is_building(t: Column) -> Column:
    return has(t, "building") & ~isin(clean(t["building"]), V.NOT_BUILDINGS)


def is_canopy(t: Column) -> Column:
    return isin(clean(t["building"]), ["roof", "canopy"])


def is_shed(t: Column, m2: Column) -> Column:
    value = clean(t["building"])
    return isin(value, V.SHED_VALUES) | (isin(value, ["", "yes"]) & (m2 <= V.SHED_MAX_M2))


def is_notable(t: Column, kind: Column) -> Column:
    historic = F.coalesce(t["historic"], F.lit(""))
    return isin(kind, ["school", "church", "medical"]) | isin(t["amenity"], V.NOTABLE_AMENITY) \
        | is_(t, "tourism", "museum", "attraction") | ~historic.isin("", "no") \
        | is_(t, "building", "government", "public", "civic", "townhall") | has(t, "wikidata") | has(t, "wikipedia")


def kind_for_area(category: Column, tiles: Column) -> Column:
    """The building kind a land category implies; small institutions are outbuildings."""
    kind = lookup(category, V.KIND_FOR_AREA)
    return F.when(isin(kind, ["school", "medical"]) & (tiles < V.OUTBUILDING_TILES), F.lit("civic")).otherwise(kind)


def levels_from_tags(t: Column, max_levels: int = 6) -> Column:
    """Storeys as mapped: counted levels plus roof levels, else height over three metres."""
    def clamp(v):
        return F.greatest(F.lit(1), F.least(F.lit(max_levels), v))

    roof = parse_measure(t["roof:levels"])
    extra = F.when(roof >= 1, F.floor(roof).cast("int")).otherwise(F.lit(0))
    counted = []
    for key in ("building:levels", "levels"):
        n = parse_measure(t[key])
        counted.append(F.when(n >= 1, clamp(F.floor(n).cast("int") + extra)))
    base = F.coalesce(parse_measure(t["min_height"]), F.lit(0.0))
    tall = []
    for key in ("height", "building:height", "est_height"):
        h = parse_measure(t[key])
        usable = F.greatest(h - base, h * 0.5)
        tall.append(F.when(h > 0, clamp(F.floor(usable / 3.0).cast("int"))))
    return F.coalesce(*counted, *tall)


def looks_like_apartment(t: Column, tiles: Column, draw: Column, min_tiles: int = 150, chance: float = 0.55,
                         max_levels: int = 6) -> Column:
    """Whether an untagged building is a block of flats; `draw` is uniform in [0,1)."""
    measured = levels_from_tags(t, max_levels)
    small = isin(F.lower(F.coalesce(t["building"], F.lit(""))), ["house", "detached", "bungalow"])
    return case(
        (measured >= 3, True), (measured == 1, False), (tiles < min_tiles, False), (small, False),
        default=draw < chance)


def default_levels(kind: Column, draw: Column, max_levels: int = 6) -> Column:
    """Storeys for a building nobody counted, by kind and a uniform draw."""
    lo = F.coalesce(lookup(kind, {k: min(a, max_levels) for k, (a, _b) in V.DEFAULT_LEVELS.items()}), F.lit(1))
    hi = F.coalesce(lookup(kind, {k: min(b, max_levels) for k, (_a, b) in V.DEFAULT_LEVELS.items()}), F.lit(2))
    spread = (lo + F.floor(draw * (hi - lo + 1))).cast("int")
    house = F.when(draw < 0.3, F.lit(2)).otherwise(F.lit(1))
    return F.when(kind.isNull(), house).otherwise(spread)


def building_levels(t: Column, kind: Column, nearby: Column, draw: Column, nudge: Column, max_levels: int = 6) -> Column:
    """Measured storeys, else the neighbourhood's plus a nudge, else the default of the kind."""
    follows = nearby.isNotNull() & isin(F.coalesce(kind, F.lit("house")), V.FOLLOWS_NEIGHBOURS)
    top = F.when(kind.isNull(), F.lit(min(3, max_levels))).otherwise(F.lit(max_levels))
    near = F.greatest(F.lit(1), F.least(top, (F.rint(nearby) + nudge).cast("int")))
    return F.coalesce(levels_from_tags(t, max_levels), F.when(follows, near), default_levels(kind, draw, max_levels))


# ------------------------------------------------------------------- uses
def _pair(front: Column, back: Column) -> Column:
    return F.struct(front.alias("front"), back.alias("back"))


def _pair_lookup(value: Column, table: dict) -> Column:
    front = lookup(value, {k: a for k, (a, _b) in table.items()})
    back = lookup(value, {k: b for k, (_a, b) in table.items()})
    return F.when(front.isNotNull(), _pair(front, back))


def use_of_tags(t: Column) -> Column:
    """(front room, back room) of a use, null when the tags name none."""
    amenity, shop = clean(t["amenity"]), clean(t["shop"])
    cuisine = clean(F.split(F.coalesce(t["cuisine"], F.lit("")), ";").getItem(0))
    base = _pair_lookup(amenity, V.AMENITY_USES)
    kitchen = lookup(cuisine, V.KITCHEN_BY_CUISINE)
    dining = F.coalesce(lookup(cuisine, V.DINING_BY_CUISINE), base["front"])
    by_cuisine = F.when(amenity.isin([a for a in V.DINING_AMENITIES if a != "cafe"]) & kitchen.isNotNull(),
                        _pair(dining, kitchen))
    other_shop = F.when(~shop.isin("", "no", "vacant", "yes"), _pair(F.lit("generalstore"), F.lit("storage")))
    office = F.when((F.length(F.coalesce(t["office"], F.lit(""))) > 0) | (F.length(F.coalesce(t["craft"], F.lit(""))) > 0),
                    _pair(F.lit(V.OFFICE_USE[0]), F.lit(V.OFFICE_USE[1])))
    return F.coalesce(by_cuisine, base, _pair_lookup(shop, V.SHOP_USES), other_shop,
                      _pair_lookup(clean(t["healthcare"]), V.HEALTHCARE_USES),
                      _pair_lookup(clean(t["leisure"]), V.LEISURE_USES),
                      _pair_lookup(clean(t["tourism"]), V.TOURISM_USES), office)


def is_hotel(tag_sets: Column) -> Column:
    return F.exists(tag_sets, lambda t: is_(t, "tourism", "hotel", "motel", "hostel") | is_(t, "building", "hotel"))


def is_use_point(t: Column) -> Column:
    return F.coalesce(F.arrays_overlap(F.map_keys(t), F.array(*[F.lit(k) for k in V.USE_KEYS])), F.lit(False))


def is_address_point(t: Column) -> Column:
    return (F.length(F.coalesce(t["addr:housenumber"], F.lit(""))) > 0) & (F.length(F.coalesce(t["building"], F.lit(""))) == 0)


# ------------------------------------------------------------------- styles
def spatial_hash(x: Column, y: Column, a: int = 73856093, b: int = 19349663) -> Column:
    return (x.cast("bigint") * F.lit(a)).bitwiseXOR(y.cast("bigint") * F.lit(b))


def style_fits(style: Column, density: Column) -> Column:
    return case((isin(style, V.RURAL_ONLY_STYLES), density < V.SPARSE),
                (isin(style, V.NOT_DENSE_STYLES), density < V.DENSE), default=True)


def pick_style(kind: Column, x: Column, y: Column, density: Column, houses: list[str], special: dict[str, list[str]],
               block_tiles: int = 110, odd: Column | None = None) -> Column:
    """Wall style: by own position for special kinds, else the block's style among those that fit."""
    as_kind = F.coalesce(lookup(kind, V.BORROWED_STYLE), kind)
    size = F.lit(block_tiles)
    all_styles = F.array(*[F.lit(s) for s in houses])
    fits = F.filter(all_styles, lambda s: style_fits(s, density))
    styles = F.when(F.size(fits) > 0, fits).otherwise(all_styles)
    n = F.size(styles)
    block = F.pmod(spatial_hash(F.floor(x / size), F.floor(y / size)), n)
    own = spatial_hash(x, y, 83492791, 297121507).bitwiseAND(F.lit(0x7FFFFFFF))
    index = F.when((n > 1) & (own % 100 >= 55), F.pmod(F.floor(own / 100), n)).otherwise(block)
    if odd is not None:
        index = F.when((n > 1) & odd, F.pmod(index + 1, n)).otherwise(index)
    house = F.get(styles, index.cast("int"))
    out = house
    for name, variants in special.items():
        pick = F.get(F.array(*[F.lit(v) for v in variants]), F.pmod(spatial_hash(x, y), F.lit(len(variants))).cast("int"))
        out = F.when(as_kind == name, pick).otherwise(out)
    return out


# ------------------------------------------------------------------- structures
def tower_kind(t: Column) -> Column:
    made, built = F.lower(F.coalesce(t["man_made"], F.lit(""))), F.lower(F.coalesce(t["building"], F.lit("")))
    pick = F.when(made.isin(V.TOWER_MAN_MADE), made).when(built.isin(V.TOWER_MAN_MADE), built)
    plain = (pick == "tower") & ~isin(F.lower(F.coalesce(t["tower:type"], F.lit(""))), V.TOWER_TYPES)
    return F.when(plain, F.lit(None)).otherwise(pick)


def monument_kind(t: Column) -> Column:
    memorial = F.lower(F.coalesce(F.nullif(t["memorial"], F.lit("")), t["monument"], F.lit("")))
    art = F.lower(F.coalesce(t["artwork_type"], F.lit("")))
    name = F.lower(F.coalesce(t["name"], F.lit("")))
    marked = is_(t, "historic", "monument", "memorial")
    arch_name = F.array_contains(F.split(name, r"\s+"), "arch") | name.contains(" arch")
    on_land = (F.length(F.coalesce(t["leisure"], F.lit(""))) > 0) | (F.length(F.coalesce(t["landuse"], F.lit(""))) > 0)
    return case(
        (is_(t, "amenity", "fountain"), "fountain"),
        (tower_kind(t).isNotNull(), "tower"),
        (is_(t, "man_made", "obelisk") | isin(memorial, ["obelisk", "column"]), "column"),
        (is_(t, "building", "triumphal_arch") | (memorial == "arch") | (marked & arch_name), "arch"),
        (marked & isin(memorial, V.NOT_MONUMENT_MEMORIALS), None),
        (marked & isin(memorial, ["statue", "bust", "sculpture"]), "statue"),
        (marked & isin(memorial, ["stone", "war_memorial", "stele", "cross"]), "stone"),
        (marked, "statue"),
        (is_(t, "tourism", "artwork") & isin(art, ["statue", "bust", "sculpture", "stone", ""]) & ~on_land,
         F.when(art == "stone", F.lit("stone")).otherwise(F.lit("statue"))),
    )


def fence_style(t: Column, area: Column) -> Column:
    kind = F.lower(F.coalesce(F.nullif(t["fence_type"], F.lit("")), t["material"], F.lit("")))
    by_material = [(isin(kind, values), style) for values, style in V.FENCE_BY_MATERIAL]
    return case(
        (is_(t, "barrier", "wall", "retaining_wall", "city_wall"), "tall_concrete"),
        (isin(kind, ["chain_link", "chain", "mesh"]),
         F.when(isin(area, ["industrial", "military", "airport", "railway"]), F.lit("tall_chainlink"))
         .otherwise(F.lit("short_chainlink"))),
        *by_material,
        default=F.coalesce(lookup(area, V.FENCE_BY_AREA), F.lit("short_wooden")))


def bridge_level(t: Column) -> Column:
    """Storeys above ground, 0 to 2, from layer and bridge tags."""
    layer = F.coalesce(to_double(F.split(F.coalesce(t["layer"], F.lit("0")), ";").getItem(0)).cast("int"), F.lit(0))
    bridged = has(t, "bridge") & ~is_(t, "bridge", "no")
    layer = F.when(bridged, F.greatest(layer, F.lit(1))).otherwise(layer)
    return F.greatest(F.lit(0), F.least(F.lit(V.MAX_BRIDGE_LEVEL), layer))


def storeys_from_height(t: Column, default: int) -> Column:
    metres = to_double(F.split(F.trim(F.coalesce(t["height"], F.lit(""))), r"\s+").getItem(0))
    return F.coalesce(F.greatest(F.lit(1), F.least(F.lit(8), F.rint(metres / 3.0).cast("int"))), F.lit(default))


# ------------------------------------------------------------------- roads
def way_width_m(t: Column, category: Column) -> Column:
    """Carriageway width: its own width tag, else lanes, else the class default."""
    raw = F.coalesce(F.nullif(t["width"], F.lit("")), F.nullif(t["est_width"], F.lit("")))
    number = first_word_number(raw)
    tagged = F.when(number.isNotNull(), F.greatest(F.lit(2.0), F.least(F.lit(30.0), number)))
    lanes_text = F.trim(F.split(t["lanes"], ";").getItem(0))
    lanes = F.when(lanes_text.rlike(r"^[+-]?\d+$"), lanes_text.try_cast("int"))
    n = F.greatest(F.lit(1), F.least(F.lit(8), lanes))
    by_lanes = n * 3.2 + 1.0
    by_lanes = F.when(is_(t, "oneway", "yes"), F.greatest(by_lanes, F.lit(3.5))).otherwise(by_lanes)
    return F.coalesce(tagged, F.when(lanes.isNotNull(), by_lanes), lookup(category, V.ROAD_WIDTH_M))


def aeroway_width_m(t: Column) -> Column:
    kind = t["aeroway"]
    base = F.coalesce(lookup(kind, {k: a for k, (a, _b) in V.AEROWAY_WIDTH_M.items()}), F.lit(V.AEROWAY_OTHER_M[0]))
    cap = F.coalesce(lookup(kind, {k: b for k, (_a, b) in V.AEROWAY_WIDTH_M.items()}), F.lit(V.AEROWAY_OTHER_M[1]))
    raw = F.coalesce(F.nullif(t["width"], F.lit("")), F.nullif(t["est_width"], F.lit("")))
    number = first_word_number(raw)
    return F.when(number.isNotNull(), F.greatest(F.lit(4.0), F.least(cap, number))).otherwise(base)


def ground_class_of(category: Column, t: Column) -> Column:
    dirt = (category == "road_track") & isin(F.lower(F.coalesce(t["surface"], F.lit(""))), V.DIRT_TRACK_SURFACES)
    return F.when(dirt, F.lit(V.GROUND_DIRT)).otherwise(lookup(category, V.GROUND_CLASS))


def is_control(t: Column) -> Column:
    return isin(t["highway"], V.CONTROL_VALUES)


def control_direction(t: Column) -> Column:
    specific = case(*[(is_(t, "highway", k), F.lower(t[f"{k}:direction"])) for k in ("traffic_signals", "stop", "give_way")],
                    default=F.lit(None).cast("string"))
    words = ["forward", "backward", "both"]
    general = F.lower(t["direction"])
    return case((isin(specific, words), specific), (isin(general, words), general), default="both")


def crossing_style(t: Column) -> Column:
    return case((is_(t, "crossing", "unmarked") | is_(t, "crossing:markings", "no"), "unmarked"),
                (is_(t, "crossing", "traffic_signals") | is_(t, "highway", "traffic_signals"), "signals"),
                default="marked")


def oneway_allows(oneway: Column, step: Column) -> Column:
    return case((isin(oneway, ["yes", "1"]), step == 1), (isin(oneway, ["-1", "reverse"]), step == -1), default=True)


def is_through_road(category: Column) -> Column:
    return isin(category, V.THROUGH_ROADS)


# ------------------------------------------------------------------- climate and biome
def _in_boxes(lat: Column, lon: Column, boxes) -> Column:
    out = F.lit(False)
    for s, n, w, e in boxes:
        out = out | (lat.between(s, n) & lon.between(w, e))
    return out


def climate_band(lat: Column, lon: Column) -> Column:
    bands = [(F.abs(lat) >= least, name) for least, name in V.LATITUDE_BANDS]
    return case((_in_boxes(lat, lon, V.ARID_BOXES), "arid"),
                (_in_boxes(lat, lon, V.MEDITERRANEAN_BOXES), "mediterranean"), *bands, default="tropical")


def _species(t: Column, group: list[str]) -> Column:
    raw = F.coalesce(F.nullif(t["wood"], F.lit("")), t["trees"])
    return F.arrays_overlap(species_tokens(raw), F.array(*[F.lit(s) for s in group]))


def open_biome(climate: Column) -> Column:
    return F.coalesce(lookup(climate, V.OPEN_BIOME), F.lit(V.BIOME["farm_mix"]))


def park_biome(climate: Column) -> Column:
    return case((isin(climate, ["boreal", "cool"]), V.BIOME["birch"]),
                (isin(climate, ["arid", "mediterranean"]), V.BIOME["pine"]), default=V.BIOME["hardwood"])


def forest_biome(t: Column, climate: Column) -> Column:
    B = V.BIOME
    leaf = F.lower(F.coalesce(t["leaf_type"], F.lit("")))
    boreal = F.when(leaf != "mixed", F.lit(B["birch"])).otherwise(F.lit(B["birch_mix"]))
    return case(
        (_species(t, V.PINE_SPECIES) | (leaf == "needleleaved"), B["pine"]),
        (_species(t, V.BIRCH_SPECIES),
         F.when((leaf != "mixed") & (climate == "boreal"), F.lit(B["birch"])).otherwise(F.lit(B["birch_mix"]))),
        (isin(climate, ["arid", "mediterranean"]), B["hardwood"]),
        (climate == "boreal", boreal),
        (climate == "cool", B["birch_mix"]),
        ((climate == "temperate") & (leaf == "mixed"), B["birch_mix"]),
        ((climate == "temperate") & (F.lower(F.coalesce(t["leaf_cycle"], F.lit(""))) == "deciduous"), B["organic"]),
        (isin(climate, ["temperate", "subtropical", "tropical"]), B["primary"]),
        default=B["organic"])


def scrub_biome(t: Column, climate: Column) -> Column:
    B = V.BIOME
    leaf = F.lower(F.coalesce(t["leaf_type"], F.lit("")))
    return case(
        (_species(t, V.PINE_SPECIES) | (leaf == "needleleaved") | isin(climate, ["arid", "mediterranean"]), B["pine"]),
        (isin(climate, ["boreal", "cool"]) | _species(t, V.BIRCH_SPECIES), B["birch_mix"]), default=B["hardwood"])


def biome_of_feature(category: Column, t: Column, climate: Column) -> Column:
    B = V.BIOME
    return case(
        (isin(category, ["water", "pool"]), B["water"]),
        (category == "sand", B["dirt"]),
        (category == "wetland", B["clay_lake"]),
        (isin(category, V.BARE_CATEGORIES), B["dirt"]),
        (category == "plaza", B["town"]),
        (category == "airport", open_biome(climate)),
        ((category == "residential") & isin(t["residential"], V.TRAILER_VALUES), B["trailer"]),
        (isin(category, ["residential"] + V.TOWN_CATEGORIES), B["town"]),
        ((category == "farmland") & is_(t, "landuse", "farmyard"), B["farm"]),
        (category == "farmland", B["farmland"]),
        (category == "orchard", B["farm_forest"]),
        (category == "cemetery", B["farm_mix"]),
        (isin(category, ["grass", "sports"]), open_biome(climate)),
        (category == "park", park_biome(climate)),
        (category == "scrub", scrub_biome(t, climate)),
        (category == "forest", forest_biome(t, climate)),
        default=open_biome(climate))


def is_lake(t: Column) -> Column:
    return isin(t["water"], V.LAKE_WATER) | is_(t, "landuse", "reservoir", "basin")


# ------------------------------------------------------------------- places and layers
def is_region(category: Column, place_type: Column, address_type: Column, admin_level: Column) -> Column:
    c, p, a = F.lower(category), F.lower(place_type), F.lower(address_type)
    return ((c == "boundary") & (p == "administrative")) | isin(a, V.REGION_TYPES) \
        | (isin(c, ["place", "boundary"]) & isin(p, V.REGION_TYPES + ["administrative"])
           & ((F.length(F.coalesce(admin_level, F.lit(""))) > 0) | (p != "administrative")))


def region_label(place_type: Column, address_type: Column, admin_level: Column) -> Column:
    kind = F.lower(F.coalesce(F.nullif(address_type, F.lit("")), place_type))
    level = admin_level.try_cast("int")
    return F.coalesce(lookup(kind, V.REGION_LABELS), case(
        (level.isNull(), "Administrative region"), (level <= 2, "Country"), (level <= 4, "State / region"),
        (level <= 6, "Council / county"), (level <= 8, "City / municipality"), default="Town / district"))


def region_type(category: Column, place_type: Column, address_type: Column, admin_level: Column) -> Column:
    return F.when(is_region(category, place_type, address_type, admin_level),
                  region_label(place_type, address_type, admin_level)).otherwise(F.lit(""))


def is_named_ground(category: Column, t: Column) -> Column:
    return case((isin(category, V.LABEL_GROUNDS), True), (category == "airport", is_airport_ground(t)),
                (category == "railway", is_rail_area(t)), default=False)


def is_zone_area(category: Column, t: Column, polygon: Column) -> Column:
    """Areas exported as zones: polygons of a zone category that are not strips or track."""
    return polygon & isin(category, V.ZONE_CATEGORIES) & case(
        (category == "airport", is_airport_area(t)), (category == "railway", is_rail_area(t)), default=True)


def notability(kind: Column, value: Column, t: Column) -> Column:
    wiki = F.when(has(t, "wikidata") | has(t, "wikipedia"), F.lit(4)).otherwise(F.lit(0))
    return F.coalesce(lookup(kind, V.KEY_WEIGHT), F.lit(0)) + F.coalesce(lookup(value, V.VALUE_WEIGHT), F.lit(0)) + wiki


def retag(category: Column) -> Column:
    """The canonical tags of a category."""
    key = lookup(category, {k: a for k, (a, _b) in V.TAGS_FOR_CATEGORY.items()})
    value = lookup(category, {k: b for k, (_a, b) in V.TAGS_FOR_CATEGORY.items()})
    return F.when(key.isNotNull(), F.create_map(key, value))


def keep_keys(t: Column, keys: list[str]) -> Column:
    return F.map_filter(t, lambda k, _v: k.isin(keys))


def tag_rule_match(kind: Column, t: Column, rules=None) -> Column:
    """Whether any rule of the feature's kind matches; one generated boolean, no join."""
    merged: dict[tuple[str, str, bool], list[str] | None] = {}
    for rule_kind, key, values in rules or V.TAG_RULES:
        counted = key == "place" and rule_kind == "node"
        for k in ("node", "way", "relation") if rule_kind == "nwr" else (rule_kind,):
            old = merged.get((k, key, counted), [])
            merged[(k, key, counted)] = None if values is None or old is None else old + values
    by_kind = {}
    for (k, key, counted), values in merged.items():
        hit = has(t, key) if values is None else isin(t[key], values)
        if counted:
            # Settlements count only with a head count on them.
            hit = hit & has(t, "population")
        by_kind[k] = by_kind[k] | hit if k in by_kind else hit
    return case(*[(kind == k, hit) for k, hit in by_kind.items()], default=False)
