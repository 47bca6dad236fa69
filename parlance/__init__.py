"""Transcript analytics on PySpark: operators, sources, functions, plans and streaming.

Functions of the library travel to the executors by value, so that a cluster needs no copy of it on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
