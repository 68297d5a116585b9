"""A PySpark-native corpus analytics engine."""

import sys

from pyspark import cloudpickle

# Python kernels travel with their plans, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
