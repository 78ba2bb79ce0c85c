"""tidyshelf: planning the upkeep of large archive libraries as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers go there by value, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
