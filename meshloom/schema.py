"""Table schemas and fixed vocabularies of cases and points."""
from __future__ import annotations

from pyspark.sql import types as T

# Channels, their groups and loss weights, and closed enumerations.
CHANNELS = ("ux", "uy", "uz", "cp", "k", "eps")
GROUPS = {"U": ("ux", "uy", "uz"), "Cp": ("cp",), "k": ("k",), "eps": ("eps",)}
WEIGHTS = {"ux": 1.0, "uy": 1.0, "uz": 1.0, "cp": 1.0, "k": 0.5, "eps": 0.5}
CLOSURES = ("laminar", "k-epsilon", "k-omega-sst", "spalart-allmaras", "les", "ddes", "other")
GROUNDS = ("none", "stationary", "moving", "slip")
PRIOR_KINDS = ("none", "coarse-twin", "potential", "mapped", "other")
SPLITS = ("train", "val", "test")

POINTS = T.StructType([
    T.StructField("case_id", T.StringType(), False), T.StructField("point_id", T.LongType(), False),
    *[T.StructField(c, T.DoubleType()) for c in ("x", "y", "z", "wall_dist", "nx", "ny", "nz", *CHANNELS)],
    *[T.StructField(f"p_{c}", T.DoubleType()) for c in CHANNELS],
    T.StructField("cell_size", T.DoubleType()), T.StructField("stratum", T.ByteType()),
])
MANIFEST = T.StructType([
    T.StructField("case_id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("split", T.StringType()),
    T.StructField("shard", T.StringType()), T.StructField("validated", T.BooleanType()), T.StructField("family", T.StringType()),
    T.StructField("tier", T.StringType()), T.StructField("error", T.StringType()),
])
SERIES = T.StructType([T.StructField("run_id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("it", T.DoubleType()), T.StructField("value", T.DoubleType())])
