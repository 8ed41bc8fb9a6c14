"""Paired-cohort feature analytics as composable Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The Arrow UDFs travel to the executors by value, so no cluster node needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
