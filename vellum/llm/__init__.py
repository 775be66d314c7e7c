"""Operators for preparing training corpora.

Nothing outside this subpackage imports it.  Functions that run on executors are
pickled by value, so a cluster needs no copy of this package on its workers.
"""

import sys

from pyspark import cloudpickle


def ship(module: str) -> None:
    """Pickle what `module` defines by value from now on."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)
