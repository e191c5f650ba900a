"""Spark-native text, code and metrics analytics."""

import sys

from pyspark import cloudpickle

# Python helpers travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from weftline.registry import all_queries, load_plans  # noqa: E402

__all__ = ["all_queries", "load_plans"]
