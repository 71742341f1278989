"""Score, tier, mix, split and evaluate text corpora with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the plan, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
