"""Operators for preparing text corpora for training, and their registered queries."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel with the tasks, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
