"""Grounded operational analysis on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# What is sent to executors carries its code: they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
