"""Operators: DataFrame in, DataFrame out."""

import sys

from pyspark import cloudpickle

# Tasks get functions of this package by value: executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
