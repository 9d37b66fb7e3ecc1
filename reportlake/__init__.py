"""Clinical-report extraction, analytics and structuring as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
