"""Hondana: a PySpark-native engine that lints and prepares large text corpora.

The package registers itself with cloudpickle by value, so that functions shipped to
executors do not need the package on the workers' import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
