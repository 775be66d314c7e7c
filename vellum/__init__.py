"""Vellum: document governance and corpus preparation as Spark DataFrame plans.

Functions that run on executors are pickled by value, so workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
