"""Commerce analytics as Spark jobs. Functions that run inside tasks travel by value: executors need no copy of it."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
