"""Operators of a training-data pipeline: near duplicates, quality, line and substring dedup, packing.

Nothing else in the library imports this subpackage.  ``queries`` holds the registered queries and
``oracles`` their DuckDB SQL where SQL can express them.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value, so a cluster needs no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
