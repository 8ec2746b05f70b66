"""Column functions.

Those that run in Python workers go there by value, so executors need not have the library on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
