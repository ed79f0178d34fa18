"""Spark-native analytics for telemetry from LLM agents."""

import sys

from pyspark import cloudpickle

# Ship the package's own task code with each job, so that executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
