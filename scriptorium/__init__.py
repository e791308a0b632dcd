"""Scriptorium: a PySpark-native engine for analytics over prose corpora.

Sub-packages
------------
sources     readers and writers (parquet, csv, tsv, json, text, pages)
functions   column-level helpers that stay inside the JVM
operators   relational and text operators over DataFrames
plans       named queries (with their DuckDB counterparts) over the test tables
streaming   Structured Streaming forms of the incremental operators
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that a cluster needs no
# installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
