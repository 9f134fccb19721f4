"""Operators for preparing training data; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Tasks get this subpackage's functions and classes by value: executors needn't have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
