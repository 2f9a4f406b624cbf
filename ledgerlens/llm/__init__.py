"""Operators for preparing training data: extraction, search, counting, filtering, packing."""

import sys

from pyspark import cloudpickle

# What runs in tasks is sent with them, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
