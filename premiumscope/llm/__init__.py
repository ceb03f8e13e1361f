"""Operators of a training-data pipeline. Nothing else in the package imports this subpackage."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run in tasks travel with the plan, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
