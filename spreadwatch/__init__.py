"""Relationship analytics between time series on Spark."""

import sys

from pyspark import cloudpickle

# functions travel to the executors by value: workers need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
