"""Structural similarity analytics on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# executors get this package's functions with the tasks, whether or not it is installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
