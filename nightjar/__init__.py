"""Overnight-signal and cohort analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Arrow functions travel to the executors with their code, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
