"""Operators for training-data pipelines over tables of documents, pages and conversations.

Nothing else in the library imports this package.  Its helpers travel to the
executors with the tasks, so that a cluster needs no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
