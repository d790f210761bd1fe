"""mapweft: open map data as Spark DataFrames.

Scans, tag classification, spatial joins, tile rasters, road graphs and a
population census, all declared with the DataFrame API so that the work is
partitioned by Spark.
"""

__version__ = "0.1.0"
