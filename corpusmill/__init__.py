"""Retrieval analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# executors get functions by value: they need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
