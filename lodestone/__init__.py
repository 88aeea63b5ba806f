"""Lodestone: analytics over collections of documents and their metadata, on Spark."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with their code: executors need no copy of this repository
cloudpickle.register_pickle_by_value(sys.modules[__name__])
