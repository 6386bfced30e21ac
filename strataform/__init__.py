"""Structure discovery over collections of JSON-like documents, on Spark."""

import sys

from pyspark import cloudpickle

# Python workers need not have the package on their path: its functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
