"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage. Each module holds one
operator; ``registry`` holds the driver queries and their oracle SQL.
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel whole, so the package needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
