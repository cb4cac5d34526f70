"""Operators for preparing training corpora. Nothing outside this package imports it.

Functions of this package travel to the executors by value, inside the tasks that
run them, so the cluster needs no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
