"""Operators of a training-data pipeline: scoring, encoding, filtering, near-duplicates, search, packing, formatting.

Code that runs inside tasks travels with the plan (pickled by value), so executors need only the third-party
packages, not this one.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
