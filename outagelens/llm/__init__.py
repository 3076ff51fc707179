"""Operators for preparing language-model training data. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel whole, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
