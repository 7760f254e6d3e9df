"""Evidence retrieval and quality analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run inside Python workers travel with the job, so executors
# need pyspark, pyarrow, pandas and numpy but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
