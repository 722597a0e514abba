"""Reliability and connectivity analytics over long sample tables, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from reliaspan.config import EstimatorConfig

# The small Arrow kernels travel inside their tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["EstimatorConfig"]
