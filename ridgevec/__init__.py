"""ridgevec - vector search and training-data operators as Spark plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors need no copy of the package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
