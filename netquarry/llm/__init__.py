"""Operators for preparing training text at corpus scale; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so that workers need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
