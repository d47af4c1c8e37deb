"""Operators for preparing training data; nothing outside this package imports it.

Functions that run inside Spark tasks travel with the job (pickled by value),
so executors need no copy of this package on their path."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
