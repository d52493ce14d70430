"""Segment-level translation-memory analytics as plain PySpark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Functions of this package reach the Python workers by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
