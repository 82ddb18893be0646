"""Spark-first analytics engine: intervals, nearest matches, coverage, sequences, spectra and graphs on DataFrames."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors with their code, so that a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
