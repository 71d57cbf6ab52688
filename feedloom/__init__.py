"""A Spark-native engine for change-data streams."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run on executors travel with the job, so that they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
