"""studylake: learning analytics and study-corpus preparation as Spark jobs."""

import sys

from pyspark import cloudpickle

from studylake.session import get_session

__all__ = ["get_session"]

# Functions and classes of this package go to the executors by value: they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
