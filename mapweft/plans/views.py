"""Map-shaped views over the star-schema tables.

Plain SQL that Spark and DuckDB both accept, in integer arithmetic, so both
see identical rows. The world is laid out as towns of 1600 x 1600 tiles, one
per 2,000 buildings: the map grows with the data and its density does not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import tasks_for

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

TOWN, TOWNS_WIDE = 1600, 64


def _town(key: str, per_town: int) -> tuple[str, str]:
    """Tile origin of the town a key belongs to."""
    t = f"CAST(floor({key} / {per_town}) AS BIGINT)"
    return f"{TOWN} * ({t} % {TOWNS_WIDE})", f"{TOWN} * CAST(floor({t} / {TOWNS_WIDE}) AS BIGINT)"


def pick(expr: str, values: list[str | None]) -> str:
    """A CASE that picks a value by index."""
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None)
    return f"CASE {expr} {arms} END"


_bx, _by = _town("p_partkey", 2000)
_px, _py = _town("c_custkey", 1500)
_ax, _ay = _town("s_suppkey", 100)
_rx, _ry = _town("o_orderkey", 15000)

# Outlines of boxes by id % 4: a rectangle, a slanted quad, an L, a rectangle with a hole. Offsets from the box's corner.
_OUTLINE_X = {0: ["0", "w", "w", "0"], 1: ["0", "w - p", "w", "p"], 2: ["0", "w", "w", "v", "v", "0"], 3: ["0", "w", "w", "0", "u", "u", "w - u", "w - u"]}
_OUTLINE_Y = {0: ["0", "0", "h", "h"], 1: ["q", "0", "h - q", "h"], 2: ["0", "0", "m", "m", "h", "h"], 3: ["0", "0", "h", "h", "t", "h - t", "h - t", "t"]}


def _corner(offsets: dict[int, list[str]], k: str) -> str:
    def arms(values: list[str]) -> str:
        return " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))

    return "CASE shape " + " ".join(f"WHEN {shape} THEN CASE {k} {arms(values)} END" for shape, values in offsets.items()) + " END"


def outline(boxes: str, key: str, w: str = "w", h: str = "h") -> str:
    """The edges of an outline for each box: key, ring (0, holes from 1), pos, from (ax, ay) to (ex, ey)."""
    part = lambda side, n: f"CAST(floor({side} / {n}) AS BIGINT)"
    return f"""
SELECT {key}, CASE WHEN pos > 3 AND shape = 3 THEN 1 ELSE 0 END AS ring, pos,
       x0 + {_corner(_OUTLINE_X, "pos")} AS ax, y0 + {_corner(_OUTLINE_Y, "pos")} AS ay,
       x0 + {_corner(_OUTLINE_X, "nxt")} AS ex, y0 + {_corner(_OUTLINE_Y, "nxt")} AS ey
FROM (SELECT {key}, x0, y0, {w} AS w, {h} AS h, {key} % 4 AS shape, pos,
             {part(w, 3)} AS p, {part(h, 3)} AS q, {part(w, 2)} AS v, {part(h, 2)} AS m, {part(w, 4)} AS u, {part(h, 4)} AS t,
             CASE WHEN {key} % 4 = 2 THEN (pos + 1) % 6 WHEN pos > 3 THEN 4 + (pos + 1) % 4 ELSE (pos + 1) % 4 END AS nxt
      FROM ({boxes.strip()}) box CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) AS corner(pos)
      WHERE pos < CASE {key} % 4 WHEN 2 THEN 6 WHEN 3 THEN 8 ELSE 4 END) o"""


VIEWS = {
    # Building footprints, axis-aligned, half-open in tiles.
    "v_building": f"""
SELECT p_partkey AS fid,
       {_bx} + (p_partkey * 7919) % 1571 AS x0, {_by} + (p_partkey * 104729) % 1559 AS y0,
       CAST(4 + p_size % 20 AS BIGINT) AS w, CAST(4 + p_size % 13 AS BIGINT) AS h,
       CASE WHEN p_partkey % 3 = 0 THEN CAST(1 + p_size % 6 AS BIGINT) END AS levels,
       CASE p_type WHEN 'PROMO' THEN 'shop' WHEN 'ECONOMY' THEN 'house' WHEN 'MEDIUM' THEN 'apartment'
                   WHEN 'SMALL' THEN 'shed' WHEN 'LARGE' THEN 'industrial' ELSE 'school' END AS kind,
       p_name AS name
FROM part""",
    # Mapped uses and address points.
    "v_point": f"""
SELECT c_custkey AS pid, {_px} + (c_custkey * 6151) % 1567 AS x, {_py} + (c_custkey * 12289) % 1579 AS y,
       lower(c_mktsegment) AS use_value, c_name AS name, c_acctbal > 5000 AS wiki
FROM customer""",
    # Nested land-use squares.
    "v_area": f"""
SELECT s_suppkey AS aid, {_ax} + (s_suppkey * 3571) % 1399 AS x0, {_ay} + (s_suppkey * 7451) % 1381 AS y0,
       CAST(40 + (s_suppkey % 5) * 40 AS BIGINT) AS side,
       CASE s_nationkey % 5 WHEN 0 THEN 'industrial' WHEN 1 THEN 'commercial' WHEN 2 THEN 'schoolyard'
                            WHEN 3 THEN 'cemetery' ELSE 'residential' END AS category,
       s_name AS name
FROM supplier""",
    # Ordered road vertices on a jittered street lattice, shared between roads by vkey.
    "v_vertex": f"""
SELECT way_id, pos, gx * 10000000 + gy AS vkey,
       8 * gx + (gx * 5 + gy * 3) % 4 AS x, 8 * gy + (gx * 3 + gy * 7) % 4 AS y, category, street_no
FROM (SELECT way_id, pos, category, street_no,
             CAST(ox / 8 AS BIGINT) + (way_id * 7919) % 199 + CASE WHEN way_id % 2 = 0 THEN pos - 1 ELSE 0 END AS gx,
             CAST(oy / 8 AS BIGINT) + (way_id * 104729) % 197 + CASE WHEN way_id % 2 = 1 THEN pos - 1 ELSE 0 END AS gy
      FROM (SELECT o_orderkey AS way_id, {_rx} AS ox, {_ry} AS oy,
                   CAST(row_number() OVER (PARTITION BY o_orderkey
                        ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS pos,
                   CASE o_orderstatus WHEN 'F' THEN 'road_minor' WHEN 'O' THEN 'road_medium' ELSE 'road_major' END AS category,
                   o_custkey % 50 AS street_no
            FROM orders JOIN lineitem ON l_orderkey = o_orderkey) q) r""",
    # Control nodes: one per event, on the first vertex of a road or just beside it.
    "v_control": f"""
SELECT event_id AS node_id, 8 * gx + (gx * 5 + gy * 3) % 4 + event_id % 3 AS x,
       8 * gy + (gx * 3 + gy * 7) % 4 + event_id % 2 AS y,
       gx * 10000000 + gy AS near_key, event_id % 3 + event_id % 2 = 0 AS on_vertex,
       CASE event_type WHEN 'click' THEN 'traffic_signals' WHEN 'purchase' THEN 'stop' WHEN 'error' THEN 'give_way'
                       WHEN 'signup' THEN 'crossing' ELSE 'mini_roundabout' END AS highway
FROM (SELECT event_id, event_type,
             CAST({_town("event_id", 10000)[0]} / 8 AS BIGINT) + (event_id * 7919) % 199 + event_id % 3 AS gx,
             CAST({_town("event_id", 10000)[1]} / 8 AS BIGINT) + (event_id * 104729) % 197 AS gy
      FROM events) e""",
    # Timed edit patches.
    "v_patch": """
SELECT event_id AS seq, ts, user_id AS id, CAST(event_id % 3 AS INT) AS field_no,
       CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS BIGINT) END AS val
FROM events""",
    # Tagged features for the classifiers: every tag is picked from the values that matter.
    "v_tagged": f"""
SELECT p_partkey AS id,
       {pick("p_partkey % 23", ["motorway", "primary_link", "secondary", "residential", "living_street", "pedestrian",
             "service", "track", "path", "footway", "cycleway", "steps", "traffic_signals", "stop"])} AS highway,
       {pick("p_partkey % 29", ["yes", "house", "roof", "shed", "garage", "government", "hotel", "tower", "terrace",
             "triumphal_arch", "retail"])} AS building,
       {pick("p_partkey % 31", ["coastline", "water", "wood", "scrub", "wetland", "tree", "grassland", "beach"])} AS "natural",
       {pick("p_partkey % 37", ["forest", "reservoir", "meadow", "farmyard", "orchard", "cemetery", "quarry", "retail",
             "industrial", "military", "residential", "railway", "garages", "grass"])} AS landuse,
       {pick("p_partkey % 19", ["parking", "school", "hospital", "marketplace", "place_of_worship", "restaurant", "cafe",
             "bank", "fountain", "fuel", "pharmacy"])} AS amenity,
       {pick("p_partkey % 17", ["supermarket", "bakery", "mall", "vacant", "yes", "clothes", "hats"])} AS shop,
       {pick("p_partkey % 41", ["park", "playground", "track", "stadium", "swimming_pool", "garden", "fitness_centre"])} AS leisure,
       {pick("p_partkey % 43", ["hotel", "museum", "artwork", "attraction"])} AS tourism,
       {pick("p_partkey % 47", ["aerodrome", "runway", "apron", "taxiway", "hangar"])} AS aeroway,
       {pick("p_partkey % 11", ["rail", "station", "tram"])} AS railway,
       {pick("p_partkey % 13", ["fence", "wall", "hedge"])} AS barrier,
       {pick("p_partkey % 53", ["river", "stream", "ditch", "riverbank"])} AS waterway,
       {pick("p_partkey % 59", ["pier", "obelisk", "water_tower", "tower", "lighthouse"])} AS man_made,
       {pick("p_partkey % 61", ["monument", "memorial", "castle", "no"])} AS historic,
       {pick("p_partkey % 7", ["asphalt", "gravel", "dirt"])} AS surface,
       {pick("p_partkey % 5", ["yes", "no"])} AS area,
       {pick("p_partkey % 67", ["yes", "building_passage", "culvert"])} AS tunnel,
       {pick("p_partkey % 3", ["yes"])} AS oneway,
       {pick("p_partkey % 71", ["yes", "no", "barracks"])} AS military,
       {pick("p_partkey % 8", ["2", "4;3", "x", "12"])} AS lanes,
       {pick("p_partkey % 9", ["7,5", "6 m", "wide", "45"])} AS width,
       {pick("p_partkey % 10", ["12 m", "40''", "9,5", "3;4", "tall", "30ft"])} AS height,
       {pick("p_partkey % 12", ["2", "3.5", "0", "nine"])} AS levels,
       {pick("p_partkey % 14", ["pizza", "italian", "sushi;ramen", "kebab"])} AS cuisine,
       {pick("p_partkey % 15", ["pine;oak", "birch", "Spruce, fir"])} AS wood,
       {pick("p_partkey % 16", ["mixed", "needleleaved", "broadleaved"])} AS leaf_type,
       {pick("p_partkey % 18", ["chain_link", "wood", "brick", "wire"])} AS fence_type,
       {pick("p_partkey % 20", ["-1", "1", "2", "3;1", "a"])} AS layer,
       {pick("p_partkey % 21", ["yes", "no"])} AS bridge,
       {pick("p_partkey % 22", ["forward", "backward"])} AS direction,
       {pick("p_partkey % 24", ["unmarked", "traffic_signals", "zebra"])} AS crossing,
       {pick("p_partkey % 25", ["dentist", "clinic", "other"])} AS healthcare,
       {pick("p_partkey % 26", ["lake", "pond"])} AS water,
       {pick("p_partkey % 27", ["roundabout", "circular"])} AS junction,
       {pick("p_partkey % 28", ["company"])} AS office,
       p_name AS name
FROM part""",
}
# Outlines of the buildings and of the land-use areas.
VIEWS["v_outline"] = outline(VIEWS["v_building"], "fid")
VIEWS["v_ground"] = outline(VIEWS["v_area"], "aid", "side", "side")
# Every tag column of v_tagged; "levels" stands for building:levels.
TAG_COLUMNS = ["highway", "building", "natural", "landuse", "amenity", "shop", "leisure", "tourism", "aeroway", "railway",
               "barrier", "waterway", "man_made", "historic", "surface", "area", "tunnel", "oneway", "military", "lanes",
               "width", "height", "levels", "cuisine", "wood", "leaf_type", "fence_type", "layer", "bridge", "direction",
               "crossing", "healthcare", "water", "junction", "office", "name"]
USES_TABLE = {"v_building": ["part"], "v_point": ["customer"], "v_area": ["supplier"], "v_vertex": ["orders", "lineitem"],
              "v_control": ["events"], "v_patch": ["events"], "v_tagged": ["part"], "v_outline": ["part"], "v_ground": ["supplier"]}
# Tables that a view joins, dealt out by the key of the join into as many tasks as their size asks for; what follows along a road stays there.
DEALT_BY = {"v_vertex": {"orders": "o_orderkey", "lineitem": "l_orderkey"}}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame, through Spark SQL."""
    text = VIEWS[name].replace('"natural"', "`natural`").replace("''", "\\'")
    frames = {t: table(spark, sf_dir, t) for t in USES_TABLE[name]}
    if name in DEALT_BY:
        tasks = tasks_for(*frames.values())
        frames = {t: df.repartition(tasks, DEALT_BY[name][t]) for t, df in frames.items()}
    for t in frames:
        text = text.replace(f"FROM {t}", "FROM {" + t + "}").replace(f"JOIN {t}", "JOIN {" + t + "}")
    return spark.sql(text, **frames)


def outlines(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Edges of a view of outlines, as the ring operators take them."""
    return view(spark, sf_dir, name).withColumnsRenamed({"ex": "bx", "ey": "by"})


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_tagged with its tags gathered into a map column `t`."""
    from pyspark.sql import functions as F

    df = view(spark, sf_dir, "v_tagged")
    pairs = []
    for c in TAG_COLUMNS:
        pairs += [F.lit("building:levels" if c == "levels" else c), F.col(c)]
    tags = F.map_filter(F.create_map(*pairs), lambda _k, v: v.isNotNull())
    return df.select("id", tags.alias("t"))


def with_views(sql: str, *names: str) -> str:
    """Oracle SQL with the views it needs as common table expressions."""
    head = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    for start in ("WITH RECURSIVE ", "WITH "):
        if sql.lstrip().startswith(start):
            return f"{start}{head},\n{sql.strip()[len(start):]}"
    return f"WITH {head}\n{sql.strip()}"
