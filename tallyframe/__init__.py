"""Survey and forecast analytics as Spark DataFrame operations."""

import sys

from pyspark import cloudpickle

from tallyframe.session import get_session, scratch_dir

# Functions of this package travel to the Python workers by value, so executors
# need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_session", "scratch_dir"]
