"""Text-simplification data work as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions travel to the Python workers by value: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
