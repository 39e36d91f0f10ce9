"""Operators for large training-data corpora.  Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# functions run on executors travel by value: executors need no copy of this repository
cloudpickle.register_pickle_by_value(sys.modules[__name__])
