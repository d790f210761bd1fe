"""Schemas of the records that move between operators."""

from __future__ import annotations

from pyspark.sql import types as T

TAGS = T.MapType(T.StringType(), T.StringType())
LATLON = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
RING = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("pts", T.ArrayType(LATLON)),
])

FEATURE = T.StructType([
    T.StructField("osm_id", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("tags", TAGS),
    T.StructField("rings", T.ArrayType(RING)),
])

# The payload shape of an element list with inline geometry.
ELEMENTS = T.StructType([
    T.StructField("elements", T.ArrayType(T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("tags", TAGS),
        T.StructField("geometry", T.ArrayType(LATLON)),
        T.StructField("members", T.ArrayType(T.StructType([
            T.StructField("type", T.StringType()),
            T.StructField("ref", T.LongType()),
            T.StructField("role", T.StringType()),
            T.StructField("geometry", T.ArrayType(LATLON)),
        ]))),
    ]))),
])

FOOTPRINT_ROW = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("height", T.DoubleType()),
    T.StructField("num_floors", T.IntegerType()),
    T.StructField("class", T.StringType()),
    T.StructField("bbox", T.StructType([
        T.StructField(n, T.DoubleType()) for n in ("xmin", "xmax", "ymin", "ymax")
    ])),
    T.StructField("geometry", T.StringType()),
])

PLACEMENT = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("tile_x", T.IntegerType()), T.StructField("tile_y", T.IntegerType()),
    T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
    T.StructField("cell_x", T.IntegerType()), T.StructField("cell_y", T.IntegerType()),
    T.StructField("offset_x", T.IntegerType()), T.StructField("offset_y", T.IntegerType()),
    T.StructField("levels", T.IntegerType()), T.StructField("levels_from_osm", T.IntegerType()),
    T.StructField("rooms", T.IntegerType()), T.StructField("furniture", T.IntegerType()),
    T.StructField("commercial", T.IntegerType()), T.StructField("kind", T.StringType()),
    T.StructField("style", T.StringType()), T.StructField("shaped", T.IntegerType()),
    T.StructField("angle", T.DoubleType()),
])
