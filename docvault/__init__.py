"""Private document retrieval and question answering as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions travel to executors by value, so a cluster needs no copy of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
