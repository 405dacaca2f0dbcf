"""Content-intelligence operators as DataFrame-in, DataFrame-out functions."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with the job, so that executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
