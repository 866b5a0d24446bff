"""Spark-native analytics over short messages, news text and day/region/user/word panels."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions for executors travel with the task, so that they needn't have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
