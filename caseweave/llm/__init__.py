"""Operators for preparing training data, one module per operator.

Nothing else in the library imports this subpackage.  ``queries`` registers one
query per operator over the given tables.

Functions that run inside Spark tasks travel by value, so executors need no
copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
