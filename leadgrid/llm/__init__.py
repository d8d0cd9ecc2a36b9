"""Operators that prepare text for training. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# task functions travel with the job, so executors need not have the package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
