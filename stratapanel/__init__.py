"""Analytics over date-by-instrument panels, expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in Python workers are shipped with the task, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
