"""Quillon: text-pair and corpus analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package go to the workers by value, so a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
