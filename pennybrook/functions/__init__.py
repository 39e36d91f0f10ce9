"""Column expressions and Arrow-batched functions; the latter travel by value, so executors need no copy of the package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
