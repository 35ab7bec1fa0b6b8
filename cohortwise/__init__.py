"""Feature, vector, model and evaluation operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so executors need no install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
