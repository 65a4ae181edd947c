"""Operators that a training-data pipeline needs. Nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Functions of this folder travel to the workers as code, so the workers need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
