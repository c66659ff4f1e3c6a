"""Spark-native analytics over annotated drawings, retrieval evaluation and corpus preparation.

Every public function takes DataFrames and returns DataFrames; nothing keeps a
global session and nothing collects a table whose size grows with the input.
"""

import sys

from pyspark import cloudpickle

#: Functions of this package travel to the executors by value, so that no node needs it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
