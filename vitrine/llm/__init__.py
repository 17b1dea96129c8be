"""Operators of a training-data pipeline, each a DataFrame -> DataFrame function."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, broadcasts as plain data: executors need not import this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
