"""Point-in-time analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions that run in executors travel with their code, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
