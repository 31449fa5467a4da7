"""Corpus analytics, hybrid retrieval and training-data preparation on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so these need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
