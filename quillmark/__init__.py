"""Spark-first analytics for usage cost accounting and forecast evaluation."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions of this package travel with the job, so executors need no copy of it on their path.
register_pickle_by_value(sys.modules[__name__])
