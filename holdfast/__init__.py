"""Holdfast: container analytics on Spark.  Containers are tables of members; writing is the way back."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
