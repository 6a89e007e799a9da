"""loam: record-knowledge analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Python tasks get this package's functions with the plan, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
