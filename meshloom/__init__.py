"""meshloom: physics-field point clouds and their training data as Spark jobs.

Cases are plain DataFrames (one row per case, one row per mesh point); every
operator takes and returns DataFrames and leaves the physical plan to Catalyst.
"""
__version__ = "0.1.0"
