"""Dimensions: road classes, building types, land use, channels, scale tiers. All small and fixed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Road class, rank, first level of detail, lanes, width in m, steepest grade in percent.
ROAD_CLASSES = [
    ("expressway", 0, 0, 4, 18.0, 5.0),
    ("trunk", 1, 0, 4, 14.0, 6.0),
    ("primary", 2, 1, 2, 11.0, 8.0),
    ("secondary", 3, 1, 2, 9.0, 9.0),
    ("tertiary", 4, 2, 2, 7.0, 10.0),
    ("residential", 5, 2, 2, 5.5, 12.0),
    ("unclassified", 6, 2, 2, 5.0, 12.0),
    ("living_street", 7, 3, 1, 4.0, 12.0),
    ("service", 8, 3, 1, 3.5, 15.0),
    ("track", 9, 4, 1, 3.0, 20.0),
    ("path", 10, 4, 0, 1.5, 30.0),
    ("unknown", 99, 4, 1, 4.0, 12.0),
]
# Map tag -> road class.
HIGHWAYS = {
    "motorway": "expressway", "motorway_link": "expressway", "trunk": "trunk", "trunk_link": "trunk", "primary": "primary", "primary_link": "primary",
    "secondary": "secondary", "secondary_link": "secondary", "tertiary": "tertiary", "tertiary_link": "tertiary", "residential": "residential",
    "unclassified": "unclassified", "living_street": "living_street", "service": "service", "track": "track", "road": "unknown", "footway": "path",
    "path": "path", "cycleway": "path", "pedestrian": "path", "steps": "path",
}
# Fine building type -> coarse type.
FINE_TYPES = {
    "detached_house": "residential", "apartment": "residential", "shophouse": "residential", "mixed_apartment": "residential", "workshop_house": "residential",
    "office": "commercial", "retail": "commercial", "accommodation": "commercial", "commercial_mixed": "commercial", "factory": "industrial",
    "warehouse": "industrial", "government": "institutional", "education_welfare": "institutional", "defence": "institutional",
    "agricultural_facility": "agricultural", "utility": "infrastructure", "other": "other", "unknown": "unknown",
}
# Usage code -> fine building type.
USAGE_CODES = {
    "401": "office", "402": "retail", "403": "accommodation", "404": "commercial_mixed", "411": "detached_house", "412": "apartment", "413": "shophouse",
    "414": "mixed_apartment", "415": "workshop_house", "421": "government", "422": "education_welfare", "431": "warehouse", "441": "factory",
    "451": "agricultural_facility", "452": "utility", "453": "defence", "454": "other", "461": "unknown",
}
# Map tag of a building -> fine type.
BUILDING_TAGS = {
    "house": "detached_house", "detached": "detached_house", "residential": "detached_house", "apartments": "apartment", "terrace": "detached_house",
    "office": "office", "commercial": "retail", "retail": "retail", "shop": "retail", "supermarket": "retail", "hotel": "accommodation",
    "industrial": "factory", "factory": "factory", "warehouse": "warehouse", "school": "education_welfare", "university": "education_welfare",
    "hospital": "education_welfare", "kindergarten": "education_welfare", "civic": "government", "government": "government", "public": "government",
    "train_station": "other", "farm": "agricultural_facility", "farm_auxiliary": "agricultural_facility", "barn": "agricultural_facility",
    "greenhouse": "agricultural_facility", "yes": "unknown", "no": "unknown",
}
# Land-use code -> class, and class -> channel group.
LANDUSE_CODES = {
    "0100": "paddy", "0200": "agriculture", "0500": "forest", "0600": "wasteland", "0700": "built_up", "0901": "road", "0902": "railway",
    "1000": "other", "1100": "water", "1400": "beach", "1500": "sea", "1600": "golf",
}
LANDUSE_GROUPS = {
    "built_up": "landuse_built", "railway": "landuse_built", "paddy": "landuse_agricultural", "agriculture": "landuse_agricultural",
    "forest": "landuse_forest", "water": "landuse_water", "sea": "landuse_water", "beach": "landuse_water",
}
# Channel, source, normalisation, scale.
CHANNELS = [
    ("elevation", "terrain", "tile_relative", None),
    ("slope", "terrain", "scale", 50.0),
    ("aspect_sin", "terrain", "none", None),
    ("aspect_cos", "terrain", "none", None),
    ("roughness", "terrain", "scale", 10.0),
    ("building_mask", "buildings", "none", None),
    ("building_height", "buildings", "scale", 60.0),
    ("building_coarse_residential", "buildings", "none", None),
    ("building_coarse_commercial", "buildings", "none", None),
    ("building_coarse_industrial", "buildings", "none", None),
    ("landuse_built", "landuse", "none", None),
    ("landuse_agricultural", "landuse", "none", None),
    ("landuse_forest", "landuse", "none", None),
    ("landuse_water", "landuse", "none", None),
    ("valid", None, "none", None),
]
# Tier, resolution in m, extent in m.
SCALE_TIERS = [("micro", 1.0, 1512.0), ("neighbourhood", 8.0, 8000.0), ("regional", 64.0, 64000.0)]


def small(df: DataFrame) -> DataFrame:
    """A fixed dimension of at most a few dozen rows: always broadcast."""
    return F.broadcast(df)


def road_classes(spark: SparkSession) -> DataFrame:
    return small(spark.createDataFrame(ROAD_CLASSES, "road_class string, rank int, min_lod int, lanes int, width_m double, max_grade double"))


def mapping(spark: SparkSession, pairs: dict[str, str], key: str, value: str) -> DataFrame:
    return small(spark.createDataFrame(list(pairs.items()), f"{key} string, {value} string"))


def channels(spark: SparkSession) -> DataFrame:
    rows = [(i, *c) for i, c in enumerate(CHANNELS)]
    return small(spark.createDataFrame(rows, "ord int, channel string, source string, normalise string, scale double"))


def values_sql(rows: list[tuple], names: str) -> str:
    """The same rows as a SQL table, for oracles."""
    text = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + f") AS d({names})"


def plane_crs(zone) -> Column:
    """The plane coordinate system of a zone, 1 to 19; null for any other number."""
    return F.when(zone.between(1, 19), F.concat(F.lit("EPSG:"), (zone + 6668).cast("string")))
