"""Spark-native analytics over logs of coding-agent sessions."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the executors by value: nothing needs to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
