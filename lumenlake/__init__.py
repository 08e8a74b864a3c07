"""Analytics for explanation evaluation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the plan, so no machine but the driver needs this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
