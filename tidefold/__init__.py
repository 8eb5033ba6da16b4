"""Durable-execution analytics on Spark: logs of commands, folds of them, and queries over the folded state."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
