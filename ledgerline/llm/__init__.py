"""Training-data operators over document tables. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions go to Python workers by value, so executors need not have the library on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
