"""Fixed schemas and fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Bit layout of a packed id, 6 bits period, 6 bits region, 52 bits index.
PERIOD_BITS = 6
REGION_BITS = 6
INDEX_BITS = 52
MAX_PERIODS = 1 << PERIOD_BITS
MAX_REGIONS = 1 << REGION_BITS

# Fixed value: marker of an unknown parent.
NO_PARENT = -1

# Names of the group shares of a region, in positional order.
GROUPS = (
    "european",
    "mena",
    "subsaharan",
    "south_asian",
    "east_asian",
    "southeast_asian",
    "amerindian",
    "pacific",
)

PERSON = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("birth_year", T.ShortType(), False),
        T.StructField("death_year", T.ShortType(), False),
        T.StructField("birth_region_idx", T.ByteType(), False),
        T.StructField("birth_lat", T.FloatType(), False),
        T.StructField("birth_lon", T.FloatType(), False),
        T.StructField("sex", T.ByteType(), False),
        T.StructField("parent1_id", T.LongType(), True),
        T.StructField("parent2_id", T.LongType(), True),
        T.StructField("birth_continent", T.StringType(), False),
        T.StructField("period_idx", T.IntegerType(), False),
    ]
)

MOVE = T.StructType(
    [
        T.StructField("person_id", T.LongType(), False),
        T.StructField("year", T.ShortType(), False),
        T.StructField("from_region_idx", T.ByteType(), False),
        T.StructField("to_region_idx", T.ByteType(), False),
        T.StructField("from_lat", T.FloatType(), False),
        T.StructField("from_lon", T.FloatType(), False),
        T.StructField("to_lat", T.FloatType(), False),
        T.StructField("to_lon", T.FloatType(), False),
        T.StructField("cause_id", T.IntegerType(), False),
        T.StructField("cause_label", T.StringType(), False),
        T.StructField("period_idx", T.IntegerType(), False),
    ]
)

REGION = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("lat", T.DoubleType(), False),
        T.StructField("lon", T.DoubleType(), False),
        T.StructField("pop_share", T.DoubleType(), False),
        T.StructField("continent", T.StringType(), False),
        T.StructField("ethno", T.ArrayType(T.DoubleType()), True),
        T.StructField("radius_deg", T.DoubleType(), True),
    ]
)

PULL = T.StructType(
    [
        T.StructField("from", T.StringType()),
        T.StructField("to", T.StringType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("reason", T.StringType()),
    ]
)

EVENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("mortality", T.DoubleType()),
        T.StructField("birth", T.DoubleType()),
        T.StructField("regions", T.ArrayType(T.StringType())),
        T.StructField("pulls", T.ArrayType(PULL)),
        T.StructField("description", T.StringType()),
    ]
)

DENSITY_TILE = T.StructType(
    [
        T.StructField("d", T.IntegerType()),
        T.StructField(
            "cells",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("h", T.StringType()),
                        T.StructField("p", T.LongType()),
                        T.StructField("c", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)

_PLACE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("cont", T.StringType()),
    ]
)

CORRIDOR_TILE = T.StructType(
    [
        T.StructField("d", T.IntegerType()),
        T.StructField("year", T.IntegerType()),
        T.StructField(
            "arcs",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("from", _PLACE),
                        T.StructField("to", _PLACE),
                        T.StructField("n", T.LongType()),
                        T.StructField("cause", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)
