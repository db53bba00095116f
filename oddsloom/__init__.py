"""Prediction-market analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python workers need not have this package installed: its functions and processors travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
