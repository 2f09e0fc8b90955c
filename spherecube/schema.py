"""Column names and schemas shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# The observation key of every cube.
KEYS = ("geo", "time")

# Columns every indicator table has; all others are breakdown columns.
STABLE = ("code", "freq", "unit", "geo", "TIME_PERIOD", "values")

# Spheres of the feature catalogue, the sphere of uncatalogued features, and the log-scaled prefix.
SPHERES = ("atmo", "bio", "socio")
DEFAULT_SPHERE = "socio"
LOG_PREFIX = "nama_"

# Fixed value: what a stored cube holds where nothing was observed.
FILL_VALUE = 9.96921e36

# Letter of a country-study column -> domain.
DOMAINS = {"X": "Biosphere", "Y": "Atmosphere", "Z": "Socioeconomics"}
AXIS_COLUMNS = tuple(f"CC{d}{k}" for d in DOMAINS for k in (1, 2, 3))

# Drawing order of the point states.
POINT_STATES = ("normal", "current_country", "current_year", "current_point")

AXIS = T.StructType([T.StructField("label", T.StringType()), T.StructField("ord", T.IntegerType())])

FEATURES = T.StructType([
    T.StructField(c, T.StringType()) for c in ("sphere", "var_id", "label", "description")
])

REGIONS = T.StructType([T.StructField(c, T.StringType()) for c in ("geo3", "geo2", "geo1", "geo0")])

LEVELS = T.StructType([T.StructField("geo", T.StringType()), T.StructField("level", T.IntegerType())])

COUNTRY_AXES = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in AXIS_COLUMNS]
    + [T.StructField("Country Code", T.StringType()), T.StructField("year", T.DoubleType())]
)

EVENTS = T.StructType([
    T.StructField("from", T.IntegerType()),
    T.StructField("to", T.IntegerType()),
    T.StructField("event", T.StringType()),
    T.StructField("country", T.StringType()),
])

# Attributes read from a boundary file; the geometry itself is not modelled.
BOUNDARIES = T.StructType([
    T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("properties", T.StructType([
            T.StructField("NUTS_ID", T.StringType()),
            T.StructField("LEVL_CODE", T.IntegerType()),
        ])),
    ]))),
])


def features_of(cube, keys=KEYS):
    """Names of the feature columns of a wide cube."""
    return [c for c in cube.columns if c not in keys]
