"""Operators for preparing training data: search, mixing, filters, deduplication, packing, formatting."""

import sys

from pyspark import cloudpickle

# Executors get these functions by value, so they need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
