"""Operators for training-data pipelines; nothing else in the library imports this package.

Functions of this package that run inside tasks travel with the task, so
executors need numpy and Arrow but no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
