"""Operators for building training corpora, each a Spark job over whole tables."""

from pyspark import cloudpickle

import episurv

# Functions that run in tasks travel with them: executors need not have the package.
cloudpickle.register_pickle_by_value(episurv)
